"""Rolling indicators as window steps; recurrences are folds (tideform.functions.folds)."""

from tideform.operators.contexts import order_context

TRUE_RANGE = ("tr", """
SELECT symbol, bar, open_u, high_u, low_u, close_u, prev_close, CASE WHEN prev_close IS NULL THEN high_u - low_u ELSE greatest(high_u - low_u, abs(high_u - prev_close), abs(low_u - prev_close)) END AS tr FROM nb""")

ATR = """
SELECT symbol, bar, tr, CASE WHEN count(*) OVER w = 14 THEN round(avg(tr) OVER w, 6) END AS atr14, CASE WHEN count(*) OVER w = 14 THEN CAST(sum(tr) OVER w AS BIGINT) END AS tr_sum14
FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""

ROC = """
SELECT symbol, bar, round((close_u - lag(close_u, 5) OVER w) * 100.0 / nullif(lag(close_u, 5) OVER w, 0), 6) AS roc5 FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar)"""

#: Mean absolute deviation is taken around each window's own mean: Spark gathers the window, the check joins it with its bars.
_TYPICAL = "(high_u + low_u + close_u) / 3.0"
CCI = (
    f"""
SELECT symbol, bar, CASE WHEN md = 0 THEN 0.0 ELSE round((typical - mean) / (0.015 * md), 6) END AS cci20 FROM (
  SELECT symbol, bar, typical, mean, aggregate(vs, CAST(0 AS DOUBLE), (a, x) -> a + abs(x - mean)) / 20 AS md FROM (
    SELECT symbol, bar, typical, avg(typical) OVER w AS mean, collect_list(typical) OVER w AS vs FROM (SELECT symbol, bar, {_TYPICAL} AS typical FROM nb)
    WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) WHERE bar >= 20)""",
    f"""
SELECT symbol, bar, CASE WHEN md = 0 THEN 0.0 ELSE round((typical - mean) / (0.015 * md), 6) END AS cci20 FROM (
  SELECT m.symbol, m.bar, max(m.typical) AS typical, max(m.mean) AS mean, avg(abs(x.typical - m.mean)) AS md FROM (
    SELECT symbol, bar, {_TYPICAL} AS typical, avg({_TYPICAL}) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean FROM nb) m
  JOIN (SELECT symbol, bar + k AS at_bar, {_TYPICAL} AS typical FROM nb CROSS JOIN (SELECT SERIES(0, 19) AS k) s) x ON x.symbol = m.symbol AND x.at_bar = m.bar
  WHERE m.bar >= 20 GROUP BY m.symbol, m.bar)""",
)

STOCHASTIC = """
SELECT symbol, bar, round(k, 6) AS k14, CASE WHEN bar >= 16 THEN round(avg(k) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) END AS d3 FROM (
  SELECT symbol, bar, CASE WHEN hh = ll THEN 50.0 ELSE 100.0 * (close_u - ll) / (hh - ll) END AS k FROM (
    SELECT symbol, bar, close_u, max(high_u) OVER w AS hh, min(low_u) OVER w AS ll FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) WHERE bar >= 14)"""

CONTEXT = order_context("tr", {"q20": 4, "q50": 10, "q80": 16}, source="tr", counted=True)

#: Moves of the middle are numbered and summed by days; the last 64 are the difference of two running sums, met by number.
MOVES = ("moves", ("""
SELECT symbol, session_day, seq, row_number() OVER w AS n, sum(CASE WHEN bid_u + ask_u > before_mid THEN 1 ELSE -1 END) OVER w AS total FROM mids WHERE before_mid <> bid_u + ask_u
WINDOW w AS (PARTITION BY symbol, session_day ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", None))
MOVE_DAYS = ("move_days", ("""
SELECT symbol, session_day, (sum(n) OVER w) - n AS n, (sum(total) OVER w) - total AS total FROM (SELECT symbol, session_day, max(n) AS n, max_by(total, n) AS total FROM moves GROUP BY symbol, session_day)
WINDOW w AS (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", None))
SUMMED = ("summed", ("SELECT m.symbol, m.seq, m.n + d.n AS n, m.total + d.total AS total FROM moves m JOIN move_days d ON d.symbol = m.symbol AND d.session_day = m.session_day", None))
IMBALANCE = (
    "SELECT a.symbol, a.seq, round((a.total - coalesce(b.total, 0)) * 1.0 / least(a.n, 64), 9) AS imbalance FROM summed a LEFT JOIN summed b ON b.symbol = a.symbol AND b.n = a.n - 64",
    """
SELECT symbol, seq, round(avg(sign) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 9) AS imbalance FROM (
  SELECT symbol, seq, CASE WHEN bid_u + ask_u > before_mid THEN 1.0 ELSE -1.0 END AS sign FROM mids WHERE before_mid <> bid_u + ask_u)""",
)


def clip01(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


def peak(x: str, left: float, top: float, right: float) -> str:
    """One at ``top``, falling to nought at ``left`` and ``right``, nought beyond."""
    return f"CASE WHEN {x} <= {left} OR {x} >= {right} THEN 0.0 WHEN {x} <= {top} THEN ({x} - {left}) / ({top} - {left}) ELSE ({right} - {x}) / ({right} - {top}) END"


def speed_ratio(back: str, back_s: str, out: str, out_s: str) -> str:
    """Half the speed of the way back over that of the way out, within 0 and 1."""
    return clip01(f"(({back}) / greatest({back_s}, 1e-6)) / greatest(({out}) / greatest({out_s}, 1e-6), 1e-12) / 2.0")


# Weights of displacement, efficiency, pullback, recovery, micro imbalance and spread in the two versions.
IPS_WEIGHTS = {1: (20.0, 15.0, 20.0, 20.0, 15.0, 10.0), 2: (15.0, 5.0, 10.0, 20.0, 30.0, 20.0)}
# Weights of depth, dwell, return velocity, micro reversal and spread.
FAES_WEIGHTS = (25.0, 20.0, 20.0, 20.0, 15.0)


def weighted(weights: tuple[float, ...], parts: tuple[str, ...]) -> str:
    return " + ".join(f"{w} * {p}" for w, p in zip(weights, parts, strict=True))


def ips(version: int) -> str:
    """Impulse persistence score of a confirmed impulse (columns of folds.impulses)."""
    parts = (
        clip01("(body_atr - 0.35) / 0.55"), clip01("(efficiency - 0.6) / 0.35"), peak("retracement", 0.15, 0.3, 0.5),
        speed_ratio("recovered", "recovery_s", "pulled", "pullback_s"), "micro", clip01("1.0 - spread / (2.0 * spread_p50)"),
    )
    return weighted(IPS_WEIGHTS[version], tuple(f"({p})" for p in parts))


#: Bar spread against the median of the 20 bars before, and the share of upward moves in the last 32 that moved.
SPREAD_P50 = ("spread_p50", order_context("spread_sum * 1.0 / n_ticks", {"p50": 10}))
MICRO = ("micro", """
SELECT symbol, bar, coalesce((ups * 1.0 / nullif(moved, 0) + 1.0) / 2.0, 0.5) AS up_share FROM (
  SELECT symbol, bar, sum(CASE WHEN close_u > prev_close THEN 1 WHEN close_u < prev_close THEN -1 ELSE 0 END) OVER w AS ups, sum(CASE WHEN close_u <> prev_close THEN 1 ELSE 0 END) OVER w AS moved
  FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 31 PRECEDING AND CURRENT ROW))""")

#: Failed auctions: a level is broken and reclaimed from outside; the trade goes against the break. Bars are the versions; the
#: time constant of the dwell is three bars.
AUCTIONS = ("auctions", """
SELECT k.symbol, k.level_id, k.side, k.bar, min(k.level) AS level, min(r.reclaim_bar) AS reclaim_bar,
       CASE WHEN k.side = 1 THEN max(b.high_u) ELSE min(b.low_u) END AS extreme, CASE WHEN k.side = 1 THEN max_by(b.bar, PAIROF(b.high_u, -b.bar)) ELSE min_by(b.bar, PAIROF(b.low_u, b.bar)) END AS extreme_bar
FROM broken k JOIN reclaimed r ON r.symbol = k.symbol AND r.side = k.side AND r.level_id = k.level_id JOIN inforce f ON f.symbol = k.symbol AND f.side = k.side AND f.level_id = k.level_id AND f.bar BETWEEN k.bar AND r.reclaim_bar
JOIN nb b ON b.symbol = f.symbol AND b.bar = f.bar GROUP BY k.symbol, k.level_id, k.side, k.bar""")
AUCTION_PARTS = ("auction_parts", """
SELECT a.symbol, a.side, a.bar, a.reclaim_bar, abs(a.extreme - a.level) / t.atr14 AS depth, (z.bucket - o.bucket) * 3600.0 AS dwell_s, abs(a.extreme - o.prev_close) * 1.0 AS out_u, (x.bucket - o.bucket) * 3600.0 AS out_s,
       abs(a.extreme - a.level) * 1.0 AS back_u, (z.bucket - x.bucket) * 3600.0 AS back_s, CASE WHEN a.side = 1 THEN 1.0 - m.up_share ELSE m.up_share END AS micro, z.spread_sum * 1.0 / z.n_ticks AS spread, p.p50
FROM auctions a JOIN nb o ON o.symbol = a.symbol AND o.bar = a.bar JOIN nb x ON x.symbol = a.symbol AND x.bar = a.extreme_bar JOIN nb z ON z.symbol = a.symbol AND z.bar = a.reclaim_bar
JOIN atrs t ON t.symbol = a.symbol AND t.bar = a.bar - 1 AND t.atr14 > 0 JOIN micro m ON m.symbol = a.symbol AND m.bar = a.reclaim_bar JOIN spread_p50 p ON p.symbol = a.symbol AND p.bar = a.reclaim_bar""")
FAES = f"""
SELECT symbol, side, bar, reclaim_bar, round({weighted(FAES_WEIGHTS, (f'({peak("depth", 0.03, 0.15, 0.5)})', "exp(-dwell_s / 10800.0)", speed_ratio("back_u", "back_s", "out_u", "out_s"), "micro", f"(CASE WHEN p50 > 0 THEN {clip01('1.0 - spread / (2.0 * p50)')} ELSE 0.0 END)"))}, 6) AS score
FROM auction_parts"""
