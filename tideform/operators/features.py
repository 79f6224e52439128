"""Operators of the feature language over closed bars: invalid inputs give invalid results, and bars are versions."""

PREVIOUS = """
SELECT t.symbol, t.seq, b.prev_open, b.prev_high, b.prev_low, b.prev_close, b.prev_last AS version
FROM ticks t JOIN nb b ON t.symbol = b.symbol AND t.session_day = b.session_day AND t.ts_ns ~div~ 3600000000000 = b.bucket"""

SCALAR = """
SELECT symbol, bar, prev_high + prev_low AS added, prev_high - prev_low AS taken,
       CASE WHEN prev_open IS NOT NULL AND prev_close IS NOT NULL THEN least(prev_open, prev_close) END AS lower,
       CASE WHEN prev_open IS NOT NULL AND prev_close IS NOT NULL THEN greatest(prev_open, prev_close) END AS upper,
       prev_close > prev_open AS gt, prev_close >= prev_open AS ge, prev_close < prev_open AS lt, prev_close <= prev_open AS le, prev_close = prev_open AS eq,
       CASE WHEN prev_close IS NOT NULL THEN prev_close > prev_open AND prev_high > 5000 END AS both_true,
       CASE WHEN prev_close IS NOT NULL THEN prev_close > prev_open OR prev_high > 5000 END AS any_true, NOT (prev_close > prev_open) AS negated
FROM nb"""

#: A cross compares with the version before; the first one is invalid.
CROSSES = """
SELECT symbol, bar, a_before <= b_before AND close_u > b AS cross_up, a_before >= b_before AND close_u < b AS cross_down, lag3, lag(up, 2) OVER (PARTITION BY symbol ORDER BY bar) AS lag2_flag FROM (
  SELECT symbol, bar, close_u, open_u AS b, lag(close_u) OVER w AS a_before, lag(open_u) OVER w AS b_before, lag(close_u, 3) OVER w AS lag3, close_u > open_u AS up
  FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar))"""

EXTREMES = """
SELECT symbol, bar, CASE WHEN count(close_u) OVER w = 8 THEN max(close_u) OVER w END AS highest, CASE WHEN count(close_u) OVER w = 8 THEN min(close_u) OVER w END AS lowest
FROM nb WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"""
