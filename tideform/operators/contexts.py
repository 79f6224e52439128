"""Gates and contexts of bars: volatility, geometry, spread and tick intensity, gaps, and pairs of conditions."""

VOLATILITY = """
SELECT symbol, bar, round(atr14 / nullif(atr50, 0), 6) AS ratio, atr14 / nullif(atr50, 0) >= 1.1 AS expanding, atr14 / nullif(atr50, 0) <= 0.9 AS calm FROM atrs WHERE atr50 IS NOT NULL"""

#: Simple averages of the range over each period, in one pass over the bars, and the shocks against them.
PERIODS = (7, 10, 14, 20, 28, 50)
_MEANS = ", ".join(f"CASE WHEN bar >= {n} THEN avg(tr) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS a{n}" for n in PERIODS)
_BEFORE = ", ".join(f"lag(a{n}) OVER (PARTITION BY symbol ORDER BY bar) AS a{n}" for n in PERIODS)
SMOOTHING = f"""
SELECT symbol, v.period, count(CASE WHEN tr >= 1.5 * CASE v.period {" ".join(f"WHEN {n} THEN a{n}" for n in PERIODS)} END THEN 1 END) AS shocks, count(CASE v.period {" ".join(f"WHEN {n} THEN a{n}" for n in PERIODS)} END) AS bars
FROM (SELECT symbol, tr, {_BEFORE} FROM (SELECT symbol, bar, tr, {_MEANS} FROM tr)) CROSS JOIN (VALUES {", ".join(f"({n})" for n in PERIODS)}) AS v(period) GROUP BY symbol, v.period"""

#: What a shock may be measured by, against the range average before it.
NUMERATORS = """
SELECT symbol, kind, count(*) AS n, min(bar) AS first_bar FROM (
  SELECT t.symbol, t.bar, v.kind, lag(t.atr14) OVER (PARTITION BY t.symbol, v.kind ORDER BY t.bar) AS atr, CASE v.kind WHEN 'range' THEN b.high_u - b.low_u WHEN 'true_range' THEN t.tr WHEN 'close' THEN abs(b.close_u - b.prev_close) ELSE abs(b.close_u - b.open_u) END AS size
  FROM atrs t JOIN nb b ON b.symbol = t.symbol AND b.bar = t.bar CROSS JOIN (VALUES ('range'), ('true_range'), ('close'), ('body')) AS v(kind))
WHERE size * 10 >= 15 * atr GROUP BY symbol, kind"""


def order_context(value: str, ranks: dict[str, int], length: int = 20, source: str = "nb", counted: bool = False) -> tuple[str, str]:
    """Nearest-rank quantiles of a bar's value over t-length-1 .. t-2, beside the value of t-1.

    A window gathers and sorts the few values of each bar; checked by a join of each bar with the bars before it.
    """
    picks = ", ".join(f"element_at(vs, {r}) AS {n}" for n, r in ranks.items())
    plain = ", ".join(f"min(CASE WHEN rn = {r} THEN v END) AS {n}" for n, r in ranks.items())
    return (
        f"""
SELECT symbol, bar, reference, {"CAST(size(vs) AS BIGINT) AS n, " if counted else ""}{picks} FROM (
  SELECT symbol, bar, lag(v) OVER (PARTITION BY symbol ORDER BY bar) AS reference, array_sort(collect_list(v) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {length + 1} PRECEDING AND 2 PRECEDING)) AS vs
  FROM (SELECT symbol, bar, {value} AS v FROM {source}))
WHERE size(vs) = {length}""",
        f"""
SELECT symbol, bar, reference, {"count(*) AS n, " if counted else ""}{plain} FROM (
  SELECT m.symbol, m.bar, m.reference, x.v, row_number() OVER (PARTITION BY m.symbol, m.bar ORDER BY x.v, x.src) AS rn
  FROM (SELECT symbol, bar, lag({value}) OVER (PARTITION BY symbol ORDER BY bar) AS reference FROM {source}) m
  JOIN (SELECT symbol, bar AS src, bar + k AS at_bar, {value} AS v FROM {source} CROSS JOIN (SELECT SERIES(2, {length + 1}) AS k) s) x ON x.symbol = m.symbol AND x.at_bar = m.bar)
GROUP BY symbol, bar, reference HAVING count(*) = {length}""",
    )


SPREAD = order_context("spread_sum * 1.0 / n_ticks", {"q75": 15, "q90": 18})
INTENSITY = order_context("n_ticks", {"q20": 4, "q50": 10, "q80": 16})

#: Shocks by whether their bar reopens after a gap.
GAP_KINDS = """
SELECT s.symbol, s.threshold, count(*) AS every_n, count_if(b.prev_bucket IS NULL OR b.bucket - b.prev_bucket > 1) AS reopening, count_if(b.bucket - b.prev_bucket = 1) AS continuous
FROM shocks s JOIN nb b ON b.symbol = s.symbol AND b.bar = s.bar GROUP BY s.symbol, s.threshold"""

#: Conditions of a shock bar, one row for each that holds; pairs of them are counted by meeting on the bar.
CONDITIONS = ("conditions", """
SELECT s.symbol, s.bar, s.side, v.cond FROM (SELECT DISTINCT symbol, bar, side FROM shocks WHERE threshold = 10) s JOIN nb b ON b.symbol = s.symbol AND b.bar = s.bar JOIN atrs a ON a.symbol = s.symbol AND a.bar = s.bar
CROSS JOIN (VALUES ('body'), ('close_third'), ('continuous'), ('expanding'), ('weekday')) AS v(cond)
WHERE CASE v.cond WHEN 'body' THEN s.side * (b.close_u - b.open_u) > 0
  WHEN 'close_third' THEN CASE WHEN s.side = 1 THEN (b.close_u - b.low_u) * 3 >= 2 * (b.high_u - b.low_u) ELSE (b.high_u - b.close_u) * 3 >= 2 * (b.high_u - b.low_u) END
  WHEN 'continuous' THEN b.bucket - b.prev_bucket = 1 WHEN 'expanding' THEN a.atr14 > a.atr50 ELSE (b.bucket ~div~ 24 + 3) % 7 < 5 END""")
INTERACTIONS = """
SELECT a.symbol, a.side, a.cond AS cond_a, b.cond AS cond_b, count(*) AS n, min(a.bar) AS first_bar FROM conditions a JOIN conditions b ON b.symbol = a.symbol AND b.bar = a.bar AND b.side = a.side AND a.cond < b.cond
GROUP BY a.symbol, a.side, a.cond, b.cond"""
#: Signed marks of each pair of conditions, a mask for each symbol and pair.
PAIR_MARKS = """
SELECT a.symbol, a.cond || '&' || b.cond AS config, a.bar * a.side AS number FROM conditions a JOIN conditions b ON b.symbol = a.symbol AND b.bar = a.bar AND b.side = a.side AND a.cond < b.cond"""

#: Identities of breaks, in shards by their first two characters.
IDENTITIES = "SELECT id, substring(id, 1, 2) AS shard FROM (SELECT SHA(body) AS id FROM (SELECT symbol || ':' || CAST(bar AS VARCHAR(20)) || ':' || CAST(side AS VARCHAR(20)) AS body FROM breaks))"
