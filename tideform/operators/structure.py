"""Fractals, level breaks, boxes and reclaim events over bars."""

#: A high pivot tops both neighbours' halves (strictly on the right); it is known one bar after its window closes.
FRACTALS = ("fractals", """
SELECT symbol, bar, high_u, low_u, bar + 3 AS known_at,
       bar >= 3 AND count(*) OVER r = 2 AND high_u >= max(high_u) OVER l AND high_u > max(high_u) OVER r AS is_high,
       bar >= 3 AND count(*) OVER r = 2 AND low_u <= min(low_u) OVER l AND low_u < min(low_u) OVER r AS is_low
FROM nb WINDOW l AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)""")
PIVOTS = "SELECT symbol, bar, high_u, low_u, known_at, is_high, is_low FROM fractals WHERE is_high OR is_low"

#: Level in force at each bar: the last pivot that is known.
LEVELS = ("levels", """
SELECT symbol, bar, close_u, prev_close, LASTKNOWN(hi) OVER w AS high_level, LASTKNOWN(hi_bar) OVER w AS high_id, LASTKNOWN(lo) OVER w AS low_level, LASTKNOWN(lo_bar) OVER w AS low_id FROM (
  SELECT b.symbol, b.bar, b.close_u, b.prev_close, CASE WHEN f.is_high THEN f.high_u END AS hi, CASE WHEN f.is_high THEN f.bar END AS hi_bar, CASE WHEN f.is_low THEN f.low_u END AS lo, CASE WHEN f.is_low THEN f.bar END AS lo_bar
  FROM nb b LEFT JOIN fractals f ON f.symbol = b.symbol AND f.known_at = b.bar)
WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")

#: First close beyond each level: a level is used up by its first break.
BREAKS = ("breaks", """
SELECT symbol, bar, level_id, side FROM (
  SELECT symbol, bar, level_id, side, row_number() OVER (PARTITION BY symbol, side, level_id ORDER BY bar) AS n FROM (
    SELECT symbol, bar, high_id AS level_id, 1 AS side FROM levels WHERE prev_close <= high_level AND close_u > high_level
    UNION ALL SELECT symbol, bar, low_id, -1 FROM levels WHERE prev_close >= low_level AND close_u < low_level))
WHERE n = 1""")

BOXES = """
SELECT symbol, bar, high_level - low_level AS width, lag(high_level - low_level, 1) OVER w AS width1, lag(high_level - low_level, 2) OVER w AS width2, lag(high_level - low_level, 3) OVER w AS width3
FROM (SELECT symbol, bar, high_level, low_level, high_id, low_id, lag(high_id) OVER (PARTITION BY symbol ORDER BY bar) AS h0, lag(low_id) OVER (PARTITION BY symbol ORDER BY bar) AS l0 FROM levels)
WHERE high_id IS NOT NULL AND low_id IS NOT NULL AND (h0 IS NULL OR l0 IS NULL OR h0 <> high_id OR l0 <> low_id)
WINDOW w AS (PARTITION BY symbol ORDER BY bar)"""

#: Ticks that cross the previous bar's high by a buffer, from the tick before (of whatever bar).
TICK_CROSSES = """
SELECT symbol, buffer_pct, count(*) AS crosses, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT t.symbol, t.seq, v.buffer_pct, t.before_bid AS before, t.bid_u, b.prev_high + (b.prev_high - b.prev_low) * v.buffer_pct / 100.0 AS threshold
  FROM quotes t
  JOIN nb b ON b.symbol = t.symbol AND b.session_day = t.session_day AND b.bucket = t.ts_ns ~div~ 3600000000000
  CROSS JOIN (VALUES (0), (5), (10), (25)) AS v(buffer_pct))
WHERE before <= threshold AND bid_u > threshold GROUP BY symbol, buffer_pct"""
