"""Signal families and filters with all their settings, gate rules, walk-forward and screens, parity and integrity of results.

Spark reads windows of bars where the checking text joins each bar with those before or after it, and the reverse.
"""

# Lengths of persistence, thresholds of a shock in tenths of the average range, and in hundredths of it.
LENGTHS = (1, 2, 3, 4, 5, 8)
SHOCK_PCT = (100, 125, 150, 175, 200, 250, 300, 350, 400)
#: Close beyond all closes before; closes that rise or fall each time (one step is the same as the first); close beyond extremes.
FAMILIES = {
    "closes": ("close_u > max(close_u) OVER p{n}", "close_u < min(close_u) OVER p{n}", "max(x.close_u) < min(b.close_u)", "min(x.close_u) > min(b.close_u)"),
    "steps": ("min(close_u - prev_close) OVER c{n} > 0", "max(close_u - prev_close) OVER c{n} < 0", None, None),
    "extremes": ("close_u > max(high_u) OVER p{n}", "close_u < min(low_u) OVER p{n}", "max(x.high_u) < min(b.close_u)", "min(x.low_u) > min(b.close_u)"),
}
_KINDS = [(f, n) for f in FAMILIES for n in LENGTHS if (f, n) != ("steps", 1)]
_WIDE = ", ".join(f"coalesce(bar > {n} AND {FAMILIES[f][k].format(n=n)}, FALSE) AS {side}_{f}{n}" for f, n in _KINDS for k, side in enumerate(("b", "s")))
_FRAMES = ", ".join(f"p{n} AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), c{n} AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in LENGTHS)
_VALUES = ", ".join(f"('{f}', {n})" for f, n in [*_KINDS, ("body", 1)])


def _case(side: str) -> str:
    body = "close_u > open_u" if side == "b" else "close_u < open_u"
    return "CASE " + " ".join(f"WHEN v.family = '{f}' AND v.n = {n} THEN {side}_{f}{n}" for f, n in _KINDS) + f" ELSE {body} END"


def _joined(f: str, n: int) -> str:
    if f == "steps":
        return f"SELECT b.symbol, b.bar, '{f}' AS family, {n} AS n, bool_and(x.close_u > x.prev_close) AS buy, bool_and(x.close_u < x.prev_close) AS sell FROM nb b JOIN nb x ON x.symbol = b.symbol AND x.bar BETWEEN b.bar - {n - 1} AND b.bar AND b.bar > {n} GROUP BY b.symbol, b.bar"
    return f"SELECT b.symbol, b.bar, '{f}' AS family, {n} AS n, {FAMILIES[f][2]} AS buy, {FAMILIES[f][3]} AS sell FROM nb b JOIN nb x ON x.symbol = b.symbol AND x.bar BETWEEN b.bar - {n} AND b.bar - 1 AND b.bar > {n} GROUP BY b.symbol, b.bar"


#: (symbol, bar, family, n, side) wherever a base of a family holds.
BASES = ("bases", (
    f"""
SELECT symbol, bar, family, n, CASE WHEN buy THEN 1 ELSE -1 END AS side FROM (
  SELECT symbol, bar, v.family, v.n, {_case('b')} AS buy, {_case('s')} AS sell FROM (SELECT symbol, bar, open_u, close_u, {_WIDE} FROM nb WINDOW {_FRAMES}) CROSS JOIN (VALUES {_VALUES}) AS v(family, n)) WHERE buy OR sell""",
    "SELECT symbol, bar, family, n, CASE WHEN buy THEN 1 ELSE -1 END AS side FROM (" + " UNION ALL ".join(_joined(f, n) for f, n in _KINDS) + " UNION ALL SELECT symbol, bar, 'body', 1, close_u > open_u, close_u < open_u FROM nb) WHERE buy OR sell",
))
PERSISTENCE = "SELECT symbol, family, n, side, count(*) AS bars, min(bar) AS first_bar, max(bar) AS last_bar FROM bases GROUP BY symbol, family, n, side"
#: Shocks by height over the average range, of the bar itself or of the one before, on weekdays.
SHOCKED = ("shocked", f"""
SELECT symbol, bar, timing, v.pct FROM (
  SELECT b.symbol, b.bar, t.timing, b.high_u - b.low_u AS height, CASE t.timing WHEN 'current' THEN a.atr14 ELSE z.atr14 END AS atr FROM nb b CROSS JOIN (VALUES ('current'), ('lagged')) AS t(timing)
  JOIN atrs a ON a.symbol = b.symbol AND a.bar = b.bar LEFT JOIN atrs z ON z.symbol = b.symbol AND z.bar = b.bar - 1 WHERE (b.bucket ~div~ 24 + 3) % 7 < 5)
CROSS JOIN (VALUES {", ".join(f"({p})" for p in SHOCK_PCT)}) AS v(pct) WHERE atr > 0 AND height * 100.0 >= atr * v.pct""")
SHOCK_FAMILIES = "SELECT s.symbol, s.timing, s.pct, b.family, b.n, b.side, count(*) AS signals, min(s.bar) AS first_bar FROM shocked s JOIN bases b ON b.symbol = s.symbol AND b.bar = s.bar GROUP BY s.symbol, s.timing, s.pct, b.family, b.n, b.side"

#: Where a bar closes within its range, and the wick against the side, each at three thresholds.
_SHAPES = [("loc50", 2, 1), ("loc33", 3, 2), ("loc25", 4, 3)]
_WICKS = [("wick50", 2), ("wick33", 3), ("wick20", 5)]
SHAPES = tuple(
    "SELECT symbol, bar, " + ", ".join([
        *(f"r > 0 AND {k} * (close_u - low_u) >= {m} * r AS {n}_buy, r > 0 AND {k} * (close_u - low_u) <= {k - m} * r AS {n}_sell" if spark else
          f"r > 0 AND (close_u - low_u) / CAST(r AS DOUBLE) >= {m}e0 / {k} AS {n}_buy, r > 0 AND (close_u - low_u) / CAST(r AS DOUBLE) <= {k - m}e0 / {k} AS {n}_sell" for n, k, m in _SHAPES),
        *(f"r > 0 AND {k} * (least(open_u, close_u) - low_u) <= r AS {n}_buy, r > 0 AND {k} * (high_u - greatest(open_u, close_u)) <= r AS {n}_sell" if spark else
          f"r > 0 AND (least(open_u, close_u) - low_u) / CAST(r AS DOUBLE) <= 1e0 / {k} AS {n}_buy, r > 0 AND (high_u - greatest(open_u, close_u)) / CAST(r AS DOUBLE) <= 1e0 / {k} AS {n}_sell" for n, k in _WICKS),
    ]) + " FROM (SELECT symbol, bar, open_u, high_u, low_u, close_u, high_u - low_u AS r FROM nb)" for spark in (True, False)
)

#: Confirmation of a shock within one to three bars without a gap: a close its way, a break of its extreme, or two bars that go on.
_STRIDES = "(VALUES ('close', 1), ('close', 2), ('close', 3), ('break', 1), ('break', 2), ('break', 3), ('two', 2), ('two', 3)) AS v(kind, width)"
_AHEAD = ", ".join(f"lead({c}, {j}) OVER w AS {c}{j}" for c in ("bucket", "open_u", "high_u", "low_u", "close_u") for j in (1, 2, 3))


def _holds(j: int) -> str:
    p = f"close_u{j - 1}" if j > 1 else "close_u"
    two = f"s.side * (b.close_u{j - 1} - b.open_u{j - 1}) > 0 AND s.side * (b.close_u{j} - b.open_u{j}) > 0 AND s.side * (b.close_u{j} - b.{p}) > 0 AND s.side * (b.close_u{j - 1} - b.close_u) > 0" if j > 1 else "FALSE"
    return f"b.bucket{j} = b.bucket + {j} AND v.width >= {j} AND CASE v.kind WHEN 'close' THEN s.side * (b.close_u{j} - b.open_u{j}) > 0 WHEN 'break' THEN CASE WHEN s.side = 1 THEN b.high_u{j} > b.high_u ELSE b.low_u{j} < b.low_u END ELSE {two} END"


CONFIRMED = (
    f"""
SELECT symbol, side, kind, width, bar, bar + j AS confirmed_bar FROM (
  SELECT s.symbol, s.side, v.kind, v.width, s.bar, CASE {" ".join(f"WHEN {_holds(j)} THEN {j}" for j in (1, 2, 3))} END AS j FROM (SELECT symbol, bar, side FROM shocks WHERE threshold = 10) s
  JOIN (SELECT symbol, bar, bucket, open_u, high_u, low_u, close_u, {_AHEAD} FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar)) b ON b.symbol = s.symbol AND b.bar = s.bar CROSS JOIN {_STRIDES}) WHERE j IS NOT NULL""",
    f"""
SELECT s.symbol, s.side, v.kind, v.width, s.bar, min(x.bar) AS confirmed_bar FROM (SELECT symbol, bar, side FROM shocks WHERE threshold = 10) s JOIN nb b ON b.symbol = s.symbol AND b.bar = s.bar CROSS JOIN {_STRIDES}
JOIN nb x ON x.symbol = s.symbol AND x.bar BETWEEN s.bar + 1 AND s.bar + v.width AND x.bucket - b.bucket = x.bar - b.bar JOIN nb y ON y.symbol = x.symbol AND y.bar = x.bar - 1
WHERE CASE v.kind WHEN 'close' THEN s.side * (x.close_u - x.open_u) > 0 WHEN 'break' THEN CASE WHEN s.side = 1 THEN x.high_u > b.high_u ELSE x.low_u < b.low_u END
  ELSE x.bar > s.bar + 1 AND s.side * (x.close_u - x.open_u) > 0 AND s.side * (y.close_u - y.open_u) > 0 AND s.side * (x.close_u - y.close_u) > 0 AND s.side * (y.close_u - b.close_u) > 0 END
GROUP BY s.symbol, s.side, v.kind, v.width, s.bar""",
)

#: Costs: half, and all, of both spreads over the risk; the two halves of a symbol's days; three screens and the one for holdouts.
COSTED = ("costed", """
SELECT l.symbol, l.session_day, l.intent_id, l.net_u * 1.0 / l.risk_u AS r, l.net_u * 1.0 / l.risk_u - 0.5 * (a.ask_u - a.bid_u + b.ask_u - b.bid_u) / l.risk_u AS half_r, l.net_u * 1.0 / l.risk_u - 1.0 * (a.ask_u - a.bid_u + b.ask_u - b.bid_u) / l.risk_u AS full_r
FROM ledger l JOIN ticks a ON a.symbol = l.symbol AND a.seq = l.entry_seq JOIN ticks b ON b.symbol = l.symbol AND b.seq = l.exit_seq""")
COST_SPREADS = "SELECT symbol, intent_id, round(r, 6) AS r, round(half_r, 6) AS conservative_r, round(full_r, 6) AS severe_r FROM costed"


def _pf(x: str) -> str:
    return f"sum(greatest({x}, 0.0)) / nullif(sum(greatest(-{x}, 0.0)), 0)"


#: Eight folds of a symbol's days in order; each is judged against the mean trade of all days before it.
FOLD_OF = ("fold_of", """
SELECT symbol, session_day, (d - 1) * 8 ~div~ days AS fold FROM (SELECT symbol, session_day, row_number() OVER (PARTITION BY symbol ORDER BY session_day) AS d, count(*) OVER (PARTITION BY symbol) AS days FROM sessions)""")
FOLDED = ("folded", (
    """
SELECT symbol, fold, n, net, sum(net) OVER w / sum(n) OVER w AS before_mean FROM (SELECT f.symbol, f.fold, count(c.half_r) AS n, coalesce(sum(c.half_r), 0.0) AS net FROM fold_of f LEFT JOIN costed c ON c.symbol = f.symbol AND c.session_day = f.session_day GROUP BY f.symbol, f.fold)
WINDOW w AS (PARTITION BY symbol ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    """
SELECT k.symbol, k.fold, (SELECT count(*) FROM costed c JOIN fold_of f ON f.symbol = c.symbol AND f.session_day = c.session_day WHERE c.symbol = k.symbol AND f.fold = k.fold) AS n,
  (SELECT coalesce(sum(c.half_r), 0.0) FROM costed c JOIN fold_of f ON f.symbol = c.symbol AND f.session_day = c.session_day WHERE c.symbol = k.symbol AND f.fold = k.fold) AS net,
  (SELECT avg(c.half_r) FROM costed c JOIN fold_of f ON f.symbol = c.symbol AND f.session_day = c.session_day WHERE c.symbol = k.symbol AND f.fold < k.fold) AS before_mean FROM (SELECT DISTINCT symbol, fold FROM fold_of) k""",
))
WALK_VERDICT = """
SELECT symbol, folds, positive, round(wfe, 6) AS wfe, coalesce(positive >= 6 AND wfe >= 0.5, FALSE) AS passes FROM (
  SELECT symbol, count(*) AS folds, count_if(net > 0) AS positive, CASE WHEN sum(CASE WHEN n > 0 THEN n * before_mean END) > 0 THEN sum(CASE WHEN n > 0 AND before_mean IS NOT NULL THEN net END) / sum(CASE WHEN n > 0 THEN n * before_mean END) END AS wfe FROM folded GROUP BY symbol)"""
SCREENS = f"""
SELECT symbol, n, round(pf, 6) AS pf, round(half_pf, 6) AS half_pf, round(full_pf, 6) AS full_pf, round(first_r, 6) AS first_r, round(second_r, 6) AS second_r, n >= 60 AND coalesce(pf, 0) >= 1.2 AND coalesce(half_pf, 0) >= 1.1 AND coalesce(full_pf, 0) >= 1.0 AS factors,
       total > 0 AND half_total > 0 AND full_total > 0 AS nets, first_r > 0 AND second_r > 0 AS halves, held_n >= 10 AND held_r > 0 AS held_out FROM (
  SELECT c.symbol, count(*) AS n, {_pf('c.r')} AS pf, {_pf('c.half_r')} AS half_pf, {_pf('c.full_r')} AS full_pf, sum(c.r) AS total, sum(c.half_r) AS half_total, sum(c.full_r) AS full_total,
         sum(CASE WHEN f.fold < 4 THEN c.r ELSE 0.0 END) AS first_r, sum(CASE WHEN f.fold >= 4 THEN c.r ELSE 0.0 END) AS second_r, count_if(f.fold = 7) AS held_n, sum(CASE WHEN f.fold = 7 THEN c.r ELSE 0.0 END) AS held_r
  FROM costed c JOIN fold_of f ON f.symbol = c.symbol AND f.session_day = c.session_day GROUP BY c.symbol)"""

#: Two tellings of a ledger position by position: what differs, by class. The second one lacks, shifts and changes some trades.
TOLD = ("told", "SELECT p.symbol, p.n, l.session_day, l.entry_seq, l.exit_seq, l.entry_ts_ns, l.exit_ts_ns, l.side, l.risk_u, l.entry_u, l.exit_u, l.net_u, l.reason FROM positions p JOIN ledger l ON l.symbol = p.symbol AND l.intent_id = p.intent_id")
TOLD_AGAIN = ("told_again", """
SELECT symbol, n, session_day, entry_seq, exit_seq + CASE WHEN n % 50 = 1 THEN 1 ELSE 0 END AS exit_seq, entry_ts_ns, exit_ts_ns, CASE WHEN n % 60 = 2 THEN -side ELSE side END AS side, risk_u, entry_u, exit_u + CASE WHEN n % 40 = 3 THEN 1 ELSE 0 END AS exit_u,
       net_u - CASE WHEN n % 30 = 4 THEN 2 ELSE 0 END AS net_u, CASE WHEN n % 45 = 5 THEN 'CLOSE' ELSE reason END AS reason FROM told WHERE n % 97 <> 0""")
PARITY_CLASSES = """
SELECT coalesce(a.symbol, b.symbol) AS symbol, count(*) AS positions, count_if(a.n IS NULL OR b.n IS NULL OR a.session_day <> b.session_day OR a.entry_seq <> b.entry_seq OR a.exit_seq <> b.exit_seq OR a.entry_ts_ns <> b.entry_ts_ns OR a.exit_ts_ns <> b.exit_ts_ns) AS data_diff,
       count_if(a.side <> b.side) + count_if(a.risk_u <> b.risk_u) AS signal_diff, count_if(a.entry_u <> b.entry_u OR a.exit_u <> b.exit_u) AS fill_diff, count_if(a.net_u <> b.net_u) AS cost_diff, count_if(a.reason <> b.reason) AS session_diff
FROM told a FULL OUTER JOIN told_again b ON b.symbol = a.symbol AND b.n = a.n GROUP BY coalesce(a.symbol, b.symbol)"""

#: Whole results: every trade once, months and years that add up to the total, costs that only lower a result.
INTEGRITY = """
SELECT t.symbol, t.trades, t.distinct_trades, t.net = y.net AND t.net = m.net AS adds_up, c.disordered FROM (SELECT symbol, count(*) AS trades, count(DISTINCT intent_id) AS distinct_trades, CAST(sum(net_u) AS BIGINT) AS net FROM ledger GROUP BY symbol) t
JOIN (SELECT symbol, CAST(sum(net) AS BIGINT) AS net FROM periods WHERE kind = 'year' GROUP BY symbol) y ON y.symbol = t.symbol JOIN (SELECT symbol, CAST(sum(net) AS BIGINT) AS net FROM periods WHERE kind = 'month' GROUP BY symbol) m ON m.symbol = t.symbol
JOIN (SELECT symbol, count_if(r < half_r OR half_r < full_r) AS disordered FROM costed GROUP BY symbol) c ON c.symbol = t.symbol"""

#: Brackets of sells read from every tick of the holding time, without looking at bars first: a second path to the same exits.
RAW_BRACKETS = (
    """
SELECT symbol, intent_id, coalesce(hit_seq, last_seq) AS exit_seq, CASE WHEN hit_seq IS NULL THEN last_u ELSE hit_u END AS exit_u FROM (
  SELECT h.symbol, h.intent_id, min(CASE WHEN t.ask_u >= h.entry_u + h.stop_u OR t.ask_u <= h.entry_u - h.target_u THEN t.seq END) AS hit_seq, min_by(t.ask_u, CASE WHEN t.ask_u >= h.entry_u + h.stop_u OR t.ask_u <= h.entry_u - h.target_u THEN t.seq END) AS hit_u, max(t.seq) AS last_seq, max_by(t.ask_u, t.seq) AS last_u
  FROM held h JOIN ticks t ON t.symbol = h.symbol AND t.session_day = h.session_day AND t.ts_ns ~div~ 3600000000000 = h.bucket
  WHERE h.side = -1 AND h.stop_u > 0 AND t.seq > h.entry_seq AND t.seq <= h.limit_seq AND t.ask_u > t.bid_u GROUP BY h.symbol, h.intent_id)""",
    """
SELECT e.symbol, e.intent_id, coalesce(min(CASE WHEN t.ask_u >= e.entry_u + e.stop_u OR t.ask_u <= e.entry_u - e.target_u THEN t.seq END), max(t.seq)) AS exit_seq,
  arg_min(t.ask_u, CASE WHEN t.ask_u >= e.entry_u + e.stop_u OR t.ask_u <= e.entry_u - e.target_u THEN t.seq ELSE 2000000000 - t.seq END) AS exit_u
FROM entered e JOIN ticks t ON t.symbol = e.symbol AND t.session_day = e.session_day AND t.seq > e.entry_seq AND t.seq <= e.limit_seq AND t.ask_u > t.bid_u WHERE e.side = -1 AND e.stop_u > 0 GROUP BY e.symbol, e.intent_id""",
)

#: Signals of all thresholds merged in the order of their ticks, then of their names, numbered within the day.
MERGED_SIGNALS = """
SELECT s.symbol, b.session_day, b.last_seq AS signal_seq, s.threshold, s.side, row_number() OVER (PARTITION BY s.symbol, b.session_day ORDER BY b.last_seq, s.threshold, s.side) AS ordinal FROM shocks s JOIN nb b ON b.symbol = s.symbol AND b.bar = s.bar"""

#: Each retelling misses a trade with a chance of one in sixteen: a digest of trade and block draws 64 retellings, one a digit.
BLOCKS = 157
_DRAWS = ", ".join(f"CAST(sum(CASE WHEN substring(draw, {k}, 1) = '0' THEN 0 ELSE net_u END) AS BIGINT) AS n{k}" for k in range(1, 65))
_ALL = ", ".join(f"n{k}" for k in range(1, 65))
_TOLD = f"""SELECT symbol, block, {_DRAWS} FROM (SELECT symbol, block, net_u, SHA(body) AS draw FROM (
    SELECT symbol, block, net_u, symbol || ':' || CAST(intent_id AS VARCHAR(20)) || ':' || CAST(block AS VARCHAR(9)) AS body FROM ledger CROSS JOIN (SELECT SERIES(0, {BLOCKS - 1}) AS block) x)) GROUP BY symbol, block"""
MISSED = tuple(
    f"SELECT symbol, count(*) AS reps, min(net) AS worst, QUANTILE(net, 0.05) AS q05, QUANTILE(net, 0.5) AS q50, max(net) AS best, count_if(net <= 0) AS not_positive FROM (SELECT symbol, {e} AS net FROM ({_TOLD})) GROUP BY symbol"
    for e in (f"explode(array({_ALL}))", f"unnest([{_ALL}])")
)
