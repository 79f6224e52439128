"""Shock and momentum signals, gates, masks and their comparison."""

SHOCKS = ("shocks", """
SELECT symbol, bar, threshold, side FROM (
  SELECT symbol, bar, tr, atr, v.threshold, CASE WHEN close_u > hi3 THEN 1 WHEN close_u < lo3 THEN -1 END AS side FROM (
    SELECT symbol, bar, tr, close_u, lag(a) OVER (PARTITION BY symbol ORDER BY bar) AS atr, max(close_u) OVER p AS hi3, min(close_u) OVER p AS lo3 FROM (
      SELECT symbol, bar, tr, close_u, CASE WHEN count(*) OVER w = 14 THEN avg(tr) OVER w END AS a FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
    WINDOW p AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  CROSS JOIN (VALUES (5), (10), (15), (20), (25)) AS v(threshold))
WHERE side IS NOT NULL AND atr > 0 AND tr * 10.0 >= atr * threshold""")
SHOCK_COUNTS = "SELECT symbol, threshold, side, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM shocks GROUP BY symbol, threshold, side"
#: First bar within three that closes beyond the shock bar on its side; the signal moves there.
CONFIRMED = """
SELECT s.symbol, s.threshold, s.side, s.bar, min(b.bar) AS confirmed_bar FROM shocks s JOIN nb k ON k.symbol = s.symbol AND k.bar = s.bar
CROSS JOIN (SELECT SERIES(1, 3) AS o) z JOIN nb b ON b.symbol = s.symbol AND b.bar = s.bar + z.o WHERE s.side = 1 AND b.close_u > k.high_u OR s.side = -1 AND b.close_u < k.low_u
GROUP BY s.symbol, s.threshold, s.side, s.bar"""
WICKS = """
SELECT symbol, bar, (close_u - low_u) * 3 >= 2 * (high_u - low_u) AS close_top_third, (high_u - close_u) * 3 >= 2 * (high_u - low_u) AS close_bottom_third,
       (high_u - greatest(open_u, close_u)) * 2 <= high_u - low_u AS small_upper_wick, (least(open_u, close_u) - low_u) * 2 <= high_u - low_u AS small_lower_wick,
       (session_day_no + 3) % 7 AS weekday FROM (SELECT symbol, bar, open_u, high_u, low_u, close_u, bucket ~div~ 24 AS session_day_no FROM nb)"""
PERSISTENCE = """
SELECT symbol, bar, close_u > max(close_u) OVER w AS above_all, close_u < min(close_u) OVER w AS below_all, up3 = 3 AS rising3, up3 = -3 AS falling3 FROM (
  SELECT symbol, bar, close_u, sum(sign(close_u - prev_close)) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS up3 FROM nb)
WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"""
#: Six windows of civil time on bars of a quarter of an hour. Server time is New York's plus seven hours; London's follows from
#: the difference at New York's noon of that date.
QUARTERS = ("quarters", """
SELECT symbol, bucket, (bucket * 15 - 420) % 1440 AS ny, ((bucket * 15 - 420) % 1440 + HOUROF(ZONED(noon)) * 60 - 720 + 1440) % 1440 AS london
FROM (SELECT symbol, bucket, BACK7(noon_hour) AS noon FROM (SELECT symbol, bucket, (bucket * 15 - 420) ~div~ 1440 * 24 + 19 AS noon_hour FROM m15))""")
_ZONES = """ny BETWEEN 570 AND 959 AS regular, ny BETWEEN 570 AND 689 AS opening, ny BETWEEN 690 AND 839 AS midday, ny BETWEEN 840 AND 959 AS closing,
       london BETWEEN 480 AND 989 AS london, ny BETWEEN 570 AND 959 AND london BETWEEN 480 AND 989 AS both_open"""
SESSION_GATE = (
    f"SELECT symbol, bucket, {_ZONES} FROM quarters",
    f"""
SELECT symbol, bucket, {_ZONES} FROM (
  SELECT symbol, bucket, CAST(extract(hour FROM ny_time) * 60 + extract(minute FROM ny_time) AS BIGINT) AS ny,
         (CAST(extract(hour FROM ny_time) * 60 + extract(minute FROM ny_time) AS BIGINT) + 1440 + CAST(extract(hour FROM timezone('Europe/London', timezone('America/New_York', date_trunc('day', ny_time) + INTERVAL 12 HOUR))) * 60 AS BIGINT) - 720) % 1440 AS london
  FROM (SELECT symbol, bucket, make_timestamp(bucket * 900000000) - INTERVAL 7 HOUR AS ny_time FROM m15))""",
)

#: As-of join by union and forward fill: the last four-hour bar that ended at or before (inclusive) or before the hour bar.
MTF = """
SELECT symbol, bar, seen AS context_close, seen_strict AS context_close_strict FROM (
  SELECT symbol, bar, kind, LASTKNOWN(inclusive) OVER (PARTITION BY symbol ORDER BY moment, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen,
         LASTKNOWN(inclusive) OVER (PARTITION BY symbol ORDER BY moment, -kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_strict FROM (
    SELECT symbol, CAST(NULL AS BIGINT) AS bar, (bucket + 1) * 4 AS moment, 0 AS kind, close_u AS inclusive FROM b4
    UNION ALL SELECT symbol, bar, bucket, 1, CAST(NULL AS BIGINT) FROM nb))
WHERE kind = 1"""

#: A mask is the set of bars at which a configuration signals; packed and told apart by content in tideform.sources.masks.
MARKS = "SELECT symbol || ':' || CAST(threshold AS VARCHAR(9)) || ':' || CAST(side AS VARCHAR(9)) AS config, symbol, bar AS number FROM shocks"
JACCARD = """
SELECT a.symbol, a.side, a.threshold AS threshold_a, b.threshold AS threshold_b, count(*) AS both_n, round(count(*) * 1.0 / (max(na.n) + max(nc.n) - count(*)), 6) AS jaccard
FROM shocks a JOIN shocks b ON a.symbol = b.symbol AND a.side = b.side AND a.bar = b.bar AND a.threshold < b.threshold
JOIN (SELECT symbol, side, threshold, count(*) AS n FROM shocks GROUP BY symbol, side, threshold) na ON na.symbol = a.symbol AND na.side = a.side AND na.threshold = a.threshold
JOIN (SELECT symbol, side, threshold, count(*) AS n FROM shocks GROUP BY symbol, side, threshold) nc ON nc.symbol = b.symbol AND nc.side = b.side AND nc.threshold = b.threshold
GROUP BY a.symbol, a.side, a.threshold, b.threshold"""
SETS = """
SELECT 'both' AS part, count(*) AS n FROM (SELECT symbol, bar FROM shocks WHERE threshold = 10 INTERSECT SELECT symbol, bar FROM shocks WHERE threshold = 20)
UNION ALL SELECT 'either', count(*) FROM (SELECT symbol, bar FROM shocks WHERE threshold = 10 UNION SELECT symbol, bar FROM shocks WHERE threshold = 20)
UNION ALL SELECT 'first_only', count(*) FROM (SELECT symbol, bar FROM shocks WHERE threshold = 10 EXCEPT SELECT symbol, bar FROM shocks WHERE threshold = 20)"""
