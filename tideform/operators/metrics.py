"""Ledger metrics, drawdowns, robustness and multiple testing."""

import math

METRICS = """
SELECT symbol, count(*) AS n_trades, count_if(net_u > 0) AS wins, count_if(net_u < 0) AS losses, round(count_if(net_u > 0) * 1.0 / count(*), 6) AS win_rate, CAST(sum(net_u) AS BIGINT) AS net_u,
       CAST(sum(CASE WHEN net_u > 0 THEN net_u ELSE 0 END) AS BIGINT) AS gross_profit, CAST(sum(CASE WHEN net_u < 0 THEN -net_u ELSE 0 END) AS BIGINT) AS gross_loss,
       round(sum(CASE WHEN net_u > 0 THEN net_u ELSE 0 END) * 1.0 / nullif(sum(CASE WHEN net_u < 0 THEN -net_u ELSE 0 END), 0), 6) AS profit_factor,
       round(avg(net_u * 1.0 / risk_u), 6) AS expectancy_r, round(avg(net_u * 1.0 / risk_u) / nullif(stddev_samp(net_u * 1.0 / risk_u), 0), 6) AS trade_sharpe
FROM ledger GROUP BY symbol"""

#: A ledger is ordered by days: trades within a symbol's day, whose numbers, sums and peaks are carried over days.
_ORDER = "exit_seq, intent_id"
LEDGER_RUNS = ("ledger_runs", (f"""
SELECT symbol, session_day, intent_id, net_u, n, run, max(run) OVER (PARTITION BY symbol, session_day ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM (
  SELECT symbol, session_day, intent_id, net_u, row_number() OVER w AS n, CAST(sum(net_u) OVER w AS BIGINT) AS run FROM ledger WINDOW w AS (PARTITION BY symbol, session_day ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", None))
LEDGER_DAYS = ("ledger_days", ("""
SELECT symbol, session_day, n - own AS before_n, total - sum_u AS before_u, greatest(0, lag(greatest(0, high)) OVER (PARTITION BY symbol ORDER BY session_day)) AS before_peak FROM (
  SELECT symbol, session_day, own, sum_u, n, total, max(total - sum_u + top) OVER (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS high FROM (
    SELECT symbol, session_day, own, sum_u, top, sum(own) OVER w AS n, CAST(sum(sum_u) OVER w AS BIGINT) AS total FROM (
      SELECT symbol, session_day, count(*) AS own, CAST(sum(net_u) AS BIGINT) AS sum_u, max(top) AS top FROM ledger_runs GROUP BY symbol, session_day)
    WINDOW w AS (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""", None))
EQUITY_STEP = ("equity", (
    "SELECT r.symbol, r.n + d.before_n AS n, r.session_day, r.net_u, d.before_u + r.run AS eq, greatest(0, coalesce(d.before_peak, 0), d.before_u + r.top) AS peak FROM ledger_runs r JOIN ledger_days d ON d.symbol = r.symbol AND d.session_day = r.session_day",
    f"""
SELECT symbol, n, session_day, net_u, eq, greatest(0, max(eq) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS peak FROM (
  SELECT symbol, session_day, net_u, row_number() OVER w AS n, CAST(sum(net_u) OVER w AS BIGINT) AS eq FROM ledger
  WINDOW w AS (PARTITION BY symbol ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
))
EQUITY = (LEDGER_RUNS, LEDGER_DAYS, EQUITY_STEP)
DRAWDOWN = "SELECT symbol, max(peak - eq) AS max_drawdown_u, round(sqrt(avg((peak - eq) * 1.0 * (peak - eq))), 6) AS ulcer_u FROM equity GROUP BY symbol"


def islands(name: str, ends: str) -> tuple:
    """Steps that end in ``name``: the equity's rows with the number of rows up to them at which ``ends`` holds, carried over days."""
    flag = f"CASE WHEN {ends} THEN 1 ELSE 0 END"
    return (
        (f"{name}_days", (f"SELECT symbol, session_day, sum(own) OVER (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - own AS earlier FROM (SELECT symbol, session_day, sum({flag}) AS own FROM equity GROUP BY symbol, session_day)", None)),
        (name, (
            f"SELECT e.symbol, e.session_day, e.n, e.net_u, e.eq, e.peak, e.own + d.earlier AS island FROM (SELECT symbol, session_day, n, net_u, eq, peak, sum({flag}) OVER (PARTITION BY symbol, session_day ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM equity) e JOIN {name}_days d ON d.symbol = e.symbol AND d.session_day = e.session_day",
            f"SELECT symbol, session_day, n, net_u, eq, peak, sum({flag}) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM equity",
        )),
    )


WATER, LOST, WON = islands("water", "eq >= peak"), islands("since_loss", "net_u <= 0"), islands("since_win", "net_u > 0")
UNDERWATER = """
SELECT symbol, max(trades) AS longest_trades, max(days) AS longest_days FROM (
  SELECT symbol, island, count_if(eq < peak) AS trades, count(DISTINCT CASE WHEN eq < peak THEN session_day END) AS days FROM water GROUP BY symbol, island) GROUP BY symbol"""
#: Wins between two losses, and the reverse; checked by numbering wins and losses apart.
STREAKS = (
    """
SELECT symbol, nullif(max(wins), 0) AS longest_wins, nullif(max(losses), 0) AS longest_losses FROM (
  SELECT symbol, island, count_if(net_u > 0) AS wins, 0 AS losses FROM since_loss GROUP BY symbol, island UNION ALL SELECT symbol, island, 0, count_if(net_u <= 0) FROM since_win GROUP BY symbol, island) GROUP BY symbol""",
    """
SELECT symbol, max(CASE WHEN won = 1 THEN len END) AS longest_wins, max(CASE WHEN won = 0 THEN len END) AS longest_losses FROM (
  SELECT symbol, won, grp, count(*) AS len FROM (
    SELECT symbol, CASE WHEN net_u > 0 THEN 1 ELSE 0 END AS won, n - row_number() OVER (PARTITION BY symbol, CASE WHEN net_u > 0 THEN 1 ELSE 0 END ORDER BY n) AS grp FROM equity)
  GROUP BY symbol, won, grp) GROUP BY symbol""",
)

#: Every session day of a symbol, with the trades that it has; days without any count as zero.
DAILY = ("daily", """
SELECT s.symbol, s.session_day, row_number() OVER (PARTITION BY s.symbol ORDER BY s.session_day) AS d, coalesce(l.r, 0.0) AS r
FROM sessions s LEFT JOIN (SELECT symbol, session_day, sum(net_u * 1.0 / risk_u) AS r FROM ledger GROUP BY symbol, session_day) l ON l.symbol = s.symbol AND l.session_day = s.session_day""")
SHARPE = """
SELECT symbol, count(*) AS days, round(sqrt(252.0) * avg(r) / nullif(stddev_samp(r), 0), 6) AS sharpe,
       round(sqrt(252.0) * avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0.0 END)), 0), 6) AS sortino FROM daily GROUP BY symbol"""
#: Net result by year and by month, and each symbol's years above and below zero.
PERIODS = ("periods", """
SELECT symbol, kind, period, CAST(sum(net_u) AS BIGINT) AS net FROM (
  SELECT symbol, net_u, v.kind, CASE v.kind WHEN 'year' THEN session_day ~div~ 10000 ELSE session_day ~div~ 100 END AS period FROM ledger CROSS JOIN (VALUES ('year'), ('month')) AS v(kind)) GROUP BY symbol, kind, period""")
YEARS = "SELECT symbol, count(*) AS years, count_if(net > 0) AS positive, count_if(net < 0) AS negative, min(net) AS worst FROM periods WHERE kind = 'year' GROUP BY symbol"
#: The period with the largest share of all absolute results; of equals the later one.
CONCENTRATION = """
SELECT symbol, kind, period AS top_period, round(share, 6) AS top_share FROM (
  SELECT symbol, kind, period, abs(net) * 1.0 / nullif(sum(abs(net)) OVER (PARTITION BY symbol, kind), 0) AS share, row_number() OVER (PARTITION BY symbol, kind ORDER BY abs(net) DESC, period DESC) AS n FROM periods) WHERE n = 1"""
TAIL = """
SELECT d.symbol, round(max(q.var5), 6) AS var5, round(avg(CASE WHEN d.r <= q.var5 THEN d.r END), 6) AS cvar5 FROM daily d
JOIN (SELECT symbol, QUANTILE(r, 0.05) AS var5 FROM daily GROUP BY symbol) q ON q.symbol = d.symbol GROUP BY d.symbol"""

FOLDS = ("folds", "SELECT symbol, (d - 1) ~div~ 5 AS fold, sum(r) AS r, count(*) AS days FROM daily GROUP BY symbol, (d - 1) ~div~ 5")
WALK = """
SELECT symbol, fold, round(r, 6) AS out_r, round(before_r, 6) AS in_r, round((r / days) / nullif(before_r / before_days, 0), 6) + 0.0 AS wfe FROM (
  SELECT symbol, fold, r, days, sum(r) OVER w AS before_r, sum(days) OVER w AS before_days FROM folds WINDOW w AS (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE before_days IS NOT NULL"""
CPCV = """
SELECT a.symbol, a.fold AS fold_a, b.fold AS fold_b, round(a.r + b.r, 6) AS test_r, round(t.r - a.r - b.r, 6) AS train_r
FROM folds a JOIN folds b ON b.symbol = a.symbol AND b.fold > a.fold JOIN (SELECT symbol, sum(r) AS r FROM folds GROUP BY symbol) t ON t.symbol = a.symbol"""
LEAVE_OUT = "SELECT f.symbol, f.fold, round(t.r - f.r, 6) AS rest_r, t.r - f.r > 0 AS positive FROM folds f JOIN (SELECT symbol, sum(r) AS r FROM folds GROUP BY symbol) t ON t.symbol = f.symbol"
#: The best trades left out: counted by their values, of which a symbol has far fewer than trades; checked by ranking trades.
def _left(share: float) -> str:
    return f"CAST(sum(net_u * greatest(0, least(own, upto - CAST(ceil(total * {share}) AS BIGINT)))) AS BIGINT)"


TOP_REMOVED = (
    f"""
SELECT symbol, {_left(0.025)} AS without_2_5, {_left(0.05)} AS without_5 FROM (
  SELECT symbol, net_u, own, sum(own) OVER (PARTITION BY symbol ORDER BY net_u DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(own) OVER (PARTITION BY symbol) AS total
  FROM (SELECT symbol, net_u, count(*) AS own FROM ledger GROUP BY symbol, net_u)) GROUP BY symbol""",
    """
SELECT symbol, CAST(sum(CASE WHEN n > ceil(total * 0.025) THEN net_u ELSE 0 END) AS BIGINT) AS without_2_5, CAST(sum(CASE WHEN n > ceil(total * 0.05) THEN net_u ELSE 0 END) AS BIGINT) AS without_5
FROM (SELECT symbol, net_u, row_number() OVER (PARTITION BY symbol ORDER BY net_u DESC, intent_id) AS n, count(*) OVER (PARTITION BY symbol) AS total FROM ledger) GROUP BY symbol""",
)
SCREEN = "SELECT symbol, n_trades, profit_factor, n_trades >= 60 AND coalesce(profit_factor, 0) >= 1.0 AND net_u > 0 AS passes FROM metrics"

#: Newey-West t statistic with Bartlett weights; the lag follows the number of days.
HAC = ("hac", """
SELECT symbol, days, lag_n, mean, CASE WHEN v > 0 THEN mean / sqrt(v / days) END AS t FROM (
  SELECT c.symbol, c.days, c.lag_n, c.mean, sum(CASE WHEN c.k = 0 THEN 1.0 ELSE 2.0 * (1 - c.k * 1.0 / (c.lag_n + 1)) END * c.cov) AS v FROM (
    SELECT m.symbol, m.days, m.lag_n, m.mean, k.k, sum((a.r - m.mean) * (b.r - m.mean)) / m.days AS cov
    FROM (SELECT symbol, count(*) AS days, CAST(floor(4 * power(count(*) / 100.0, 2.0 / 9)) AS BIGINT) AS lag_n, avg(r) AS mean FROM daily GROUP BY symbol) m
    JOIN (SELECT symbol, SPAN(zero, lag_n) AS k FROM (SELECT symbol, 0 AS zero, CAST(floor(4 * power(count(*) / 100.0, 2.0 / 9)) AS BIGINT) AS lag_n FROM daily GROUP BY symbol)) k ON k.symbol = m.symbol
    JOIN daily a ON a.symbol = m.symbol JOIN daily b ON b.symbol = a.symbol AND b.d = a.d - k.k GROUP BY m.symbol, m.days, m.lag_n, m.mean, k.k) c GROUP BY c.symbol, c.days, c.lag_n, c.mean)""")
HAC_T = "SELECT symbol, days, lag_n, round(mean, 6) AS mean_r, round(t, 6) AS t FROM hac"
# A rational approximation of the complementary error function, within 1.5e-7.
ERFC_P, ERFC_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def upper_tail(t: str) -> str:
    """Upper tail of the normal distribution at ``t``."""
    k = f"(1.0 / (1.0 + {ERFC_P} * abs({t}) / 1.4142135623730951))"
    sum_ = "0.0"
    for a in reversed(ERFC_A):
        sum_ = f"({sum_} {'+' if a >= 0 else '-'} {abs(a)}) * {k}"
    half = f"0.5 * {sum_} * exp(-({t}) * ({t}) / 2.0)"
    return f"CASE WHEN {t} >= 0 THEN {half} ELSE 1.0 - {half} END"


HAC_P = f"SELECT symbol, days, lag_n, round(t, 6) AS t, round({upper_tail('t')}, 6) AS p FROM hac WHERE t IS NOT NULL"

#: One-sided tests of every symbol and weekday by a bound on the tail, for the step-up procedures.
TESTS = ("tests", """
SELECT symbol, weekday, least(1.0, 1.0 / (1.0 + greatest(0.0, t) * greatest(0.0, t))) AS p FROM (
  SELECT symbol, weekday, coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 0.0) AS t FROM (SELECT symbol, r, WEEKDAYOF(session_day) AS weekday FROM daily) GROUP BY symbol, weekday)""")
def harmonic(n: int) -> float:
    """Sum of 1/1 to 1/n; above a million by its expansion."""
    return math.fsum(1 / k for k in range(1, n + 1)) if n <= 1_000_000 else math.log(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n)


def adjusted(n_tests: int | None = None) -> str:
    """Step-up adjusted chances among ``n_tests`` tests, assuming independence (bh_q) and not (by_q).

    The family is the tests at hand, or a larger one that they are part of; fewer than there are is an error.
    """
    m = "count(*) OVER ()" if n_tests is None else f"CAST({n_tests} AS BIGINT)"
    h = "sum(1.0 / k) OVER ()" if n_tests is None else f"CAST({harmonic(n_tests)!r} AS DOUBLE)"
    few = "FALSE" if n_tests is None else f"count(*) OVER () > {n_tests}"
    return f"""
SELECT symbol, weekday, round(p, 9) AS p, round(least(1.0, min(p * m / k) OVER w), 9) AS bh_q, round(least(1.0, min(p * m * h / k) OVER w), 9) AS by_q FROM (
  SELECT symbol, weekday, p, k, {m} AS m, {h} AS h FROM (
    SELECT symbol, weekday, CASE WHEN {few} THEN CAST(FAILED('more tests than the family holds') AS DOUBLE) ELSE p END AS p, row_number() OVER (ORDER BY p, symbol, weekday) AS k FROM tests))
WINDOW w AS (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


ADJUSTED = adjusted()
REJECTED = """
SELECT symbol, weekday, k <= coalesce(last_k, 0) AS rejected FROM (
  SELECT symbol, weekday, k, max(CASE WHEN p <= 0.10 * k / (m * h) THEN k END) OVER () AS last_k FROM (
    SELECT t.symbol, t.weekday, t.p, row_number() OVER (ORDER BY t.p, t.symbol, t.weekday) AS k, c.m, c.h FROM tests t
    CROSS JOIN (SELECT count(*) AS m, sum(1.0 / k) AS h FROM (SELECT row_number() OVER (ORDER BY symbol, weekday) AS k FROM tests)) c))"""
#: Correlation of daily results over the union of two symbols' days, a missing day counting as zero: from each symbol's own
#: sums and those over the days that both have.
SUMS = ("sums", "SELECT symbol, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM daily GROUP BY symbol")
CORRELATION = (
    """
SELECT symbol_a, symbol_b, n AS days, round((n * sab - sa * sb) / nullif(sqrt(n * saa - sa * sa) * sqrt(n * sbb - sb * sb), 0), 6) AS correlation FROM (
  SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, a.n + b.n - coalesce(c.n, 0) AS n, a.s AS sa, b.s AS sb, a.ss AS saa, b.ss AS sbb, coalesce(c.sab, 0.0) AS sab
  FROM sums a JOIN sums b ON a.symbol < b.symbol LEFT JOIN (
    SELECT x.symbol AS sx, y.symbol AS sy, count(*) AS n, sum(x.r * y.r) AS sab FROM daily x JOIN daily y ON x.session_day = y.session_day AND x.symbol < y.symbol GROUP BY x.symbol, y.symbol) c
  ON c.sx = a.symbol AND c.sy = b.symbol)""",
    """
SELECT symbol_a, symbol_b, count(*) AS days, round(corr(ra, rb), 6) AS correlation FROM (
  SELECT u.symbol_a, u.symbol_b, u.session_day, coalesce(a.r, 0.0) AS ra, coalesce(b.r, 0.0) AS rb FROM (
    SELECT DISTINCT p.symbol AS symbol_a, q.symbol AS symbol_b, d.session_day FROM (SELECT DISTINCT symbol FROM daily) p JOIN (SELECT DISTINCT symbol FROM daily) q ON p.symbol < q.symbol
    JOIN daily d ON d.symbol IN (p.symbol, q.symbol)) u
  LEFT JOIN daily a ON a.symbol = u.symbol_a AND a.session_day = u.session_day LEFT JOIN daily b ON b.symbol = u.symbol_b AND b.session_day = u.session_day) GROUP BY symbol_a, symbol_b""",
)
