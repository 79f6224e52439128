"""Canonical identities, combinations and partitions of configurations, page sections, normalised text, zone gates, reports."""

#: Server time is New York's civil time seven hours on; London's opening follows from the same instant.
ZONES = """
SELECT symbol, bar, ny_minute BETWEEN 570 AND 959 AS regular, london_minute BETWEEN 480 AND 989 AS london, ny_minute BETWEEN 570 AND 959 AND london_minute BETWEEN 480 AND 989 AS both_open FROM (
  SELECT symbol, bar, HOUROF(ny) * 60 AS ny_minute, HOUROF(ZONED(ny)) * 60 AS london_minute FROM (SELECT symbol, bar, BACK7(bucket) AS ny FROM nb))"""

#: Segment changes: an anchor on either side within a tenth of a segment brackets them.
BRACKETED = """
SELECT g.symbol, g.segment_id, count_if(a.utc_ns < g.start_ns) > 0 AS anchored_before, count_if(a.utc_ns >= g.start_ns) > 0 AS anchored_after
FROM segments g LEFT JOIN anchors a ON a.symbol = g.symbol AND a.utc_ns >= g.start_ns - (g.end_ns - g.start_ns) ~div~ 10 AND a.utc_ns < g.start_ns + (g.end_ns - g.start_ns) ~div~ 10
WHERE g.segment_id > 0 GROUP BY g.symbol, g.segment_id"""

#: Filter settings by family, from what the tables hold; configurations take one setting from each of at most three families.
SETTINGS = ("settings", """
SELECT DISTINCT 1 AS family, 'flag=' || l_returnflag AS setting FROM lineitem UNION ALL SELECT DISTINCT 2, 'line=' || l_linestatus FROM lineitem UNION ALL SELECT DISTINCT 3, 'order=' || o_orderstatus FROM orders
UNION ALL SELECT DISTINCT 4, 'priority=' || o_orderpriority FROM orders UNION ALL SELECT DISTINCT 5, 'event=' || event_type FROM events""")
COMBINED = ("combined", """
SELECT 1 AS size, setting AS config, CAST(family AS VARCHAR(9)) AS signature FROM settings
UNION ALL SELECT 2, a.setting || ';' || b.setting, CAST(a.family AS VARCHAR(9)) || ',' || CAST(b.family AS VARCHAR(9)) FROM settings a JOIN settings b ON a.family < b.family
UNION ALL SELECT 3, a.setting || ';' || b.setting || ';' || c.setting, CAST(a.family AS VARCHAR(9)) || ',' || CAST(b.family AS VARCHAR(9)) || ',' || CAST(c.family AS VARCHAR(9)) FROM settings a JOIN settings b ON a.family < b.family JOIN settings c ON b.family < c.family""")
COMBINATIONS = "SELECT size, config, signature, CAST(row_number() OVER (PARTITION BY size ORDER BY config) AS BIGINT) AS ordinal FROM combined"
PARTITIONS = "SELECT signature, count(*) AS configs, min(config) AS first_config FROM combined GROUP BY signature"
IDENTITIES = """
SELECT birth, SHA(body) AS config_id FROM (SELECT birth, '{"expiry":' || CAST(expiry AS VARCHAR(9)) || ',"fast":' || CAST(fast AS VARCHAR(9)) || ',"slow":' || CAST(slow AS VARCHAR(9)) || ',"stop":' || CAST(stop AS VARCHAR(9)) || '}' AS body FROM decoded)"""
#: The same universe as the product of its axes; whatever either enumeration lacks is listed.
PARITY = """
SELECT count(*) AS births, count_if(b.expiry IS NULL) AS missing, count_if(d.birth IS NULL) AS extra FROM decoded d FULL OUTER JOIN (
  SELECT ((e.k * z.nf + f.k) * z.ns + s.k) * z.nt + t.k AS birth, e.v AS expiry, f.v AS fast, s.v AS slow, t.v AS stop FROM sizes z CROSS JOIN axes e CROSS JOIN axes f CROSS JOIN axes s CROSS JOIN axes t
  WHERE e.axis = 'expiry' AND f.axis = 'fast' AND s.axis = 'slow' AND t.axis = 'stop') b
ON b.birth = d.birth AND b.expiry = d.expiry AND b.fast = d.fast AND b.slow = d.slow AND b.stop = d.stop"""

SECTIONS = """
SELECT page_id, level, count(*) AS n, min(heading) AS first_heading, max(heading) AS last_heading FROM (
  SELECT page_id, 1 AS level, EACHMATCH(html, '<h1[^>]*>([^<]*)</h1>') AS heading FROM pages
  UNION ALL SELECT page_id, 2, EACHMATCH(html, '<h2[^>]*>([^<]*)</h2>') FROM pages UNION ALL SELECT page_id, 3, EACHMATCH(html, '<(?:code|pre)[^>]*>([^<]*)</(?:code|pre)>') FROM pages)
GROUP BY page_id, level"""

#: Synonyms and stop words apply to whole tokens of the cleaned text.
NORMALISED = ("normalised", """
SELECT doc_id, CASE token WHEN 'licence' THEN 'license' WHEN 'colour' THEN 'color' WHEN 'emails' THEN 'email' ELSE token END AS token
FROM (SELECT doc_id, WORDS(text) AS token FROM documents) WHERE token <> '' AND token NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'with')""")
NORMAL_STATS = "SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, min(token) AS low, max(token) AS high FROM normalised GROUP BY doc_id"

#: Ledger figures beside thresholds and the smallest adjusted chance of a symbol's tests.
REPORT = """
SELECT m.symbol, m.n_trades, m.profit_factor, d.max_drawdown_u, q.q, m.n_trades >= 60 AND coalesce(m.profit_factor, 0) >= 1.0 AND m.net_u > 0 AS economic, q.q <= 0.10 AS significant
FROM metrics m JOIN (SELECT symbol, max(peak - eq) AS max_drawdown_u FROM equity GROUP BY symbol) d ON d.symbol = m.symbol JOIN (SELECT symbol, min(by_q) AS q FROM adjusted GROUP BY symbol) q ON q.symbol = m.symbol"""

#: Median positive spread of a bar: whole mean of the two middle ones.
MEDIAN_SPREAD = """
SELECT symbol, session_day, bucket, CAST(sum(CASE WHEN rn IN ((n + 1) ~div~ 2, (n + 2) ~div~ 2) THEN CASE WHEN n % 2 = 1 THEN 2 * s ELSE s END ELSE 0 END) AS BIGINT) ~div~ 2 AS median_spread FROM (
  SELECT symbol, session_day, bucket, s, row_number() OVER (PARTITION BY symbol, session_day, bucket ORDER BY s, seq) AS rn, count(*) OVER (PARTITION BY symbol, session_day, bucket) AS n FROM (
    SELECT symbol, session_day, ts_ns ~div~ 3600000000000 AS bucket, seq, ask_u - bid_u AS s FROM raw WHERE ask_u > bid_u)) GROUP BY symbol, session_day, bucket"""

#: Two tellings of the range average column by column: what lacks a partner, and what differs beyond 1e-8.
TOLERANT = """
SELECT count(*) AS cells, count_if(a.bar IS NULL OR b.bar IS NULL) AS missing, count_if(abs(a.v - b.v) > 1e-8 * greatest(1.0, abs(a.v))) AS different FROM (SELECT symbol, bar, atr14 AS v FROM atrs WHERE atr14 IS NOT NULL) a
FULL OUTER JOIN (SELECT symbol, bar, sum(tr) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / 14.0 + CASE WHEN bar % 100 = 0 THEN 1e-3 ELSE 0.0 END AS v FROM tr) b ON a.symbol = b.symbol AND a.bar = b.bar"""

#: Pivots of six window lengths under two rules for ties; each is known one bar after its window closes.
PIVOT_WINDOWS = "\nUNION ALL ".join(
    f"SELECT symbol, {w} AS width, '{tie}' AS ties, count_if(hi) AS highs, count_if(lo) AS lows, min(CASE WHEN hi THEN bar + {w // 2 + 1} END) AS first_known FROM ("
    f"SELECT symbol, bar, bar > {w // 2} AND count(*) OVER r = {w // 2} AND high_u >= max(high_u) OVER l AND high_u {a} max(high_u) OVER r AS hi, bar > {w // 2} AND count(*) OVER r = {w // 2} AND low_u <= min(low_u) OVER l AND low_u {b} min(low_u) OVER r AS lo FROM nb "
    f"WINDOW l AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {w // 2} PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {w // 2} FOLLOWING)) GROUP BY symbol"
    for w in (3, 5, 7, 9, 11, 13)
    for tie, a, b in (("strict", ">", "<"), ("loose", ">=", "<="))
)

#: Ticks that first cross the level in force by a buffer of the range average, seen from the executable tick before.
LEVEL_CROSSES = """
SELECT symbol, buffer_pct, count(*) AS ups, min(seq) AS first_seq, max(seq) AS last_seq FROM (
  SELECT t.symbol, t.seq, t.before_bid AS before, t.bid_u, v.buffer_pct, l.high_level + a.atr14 * v.buffer_pct / 100.0 AS threshold
  FROM quotes t
  JOIN nb b ON b.symbol = t.symbol AND b.session_day = t.session_day AND b.bucket = t.ts_ns ~div~ 3600000000000
  JOIN levels l ON l.symbol = b.symbol AND l.bar = b.bar - 1 JOIN atrs a ON a.symbol = b.symbol AND a.bar = b.bar - 1 CROSS JOIN (VALUES (0), (5), (10), (25)) AS v(buffer_pct))
WHERE before <= threshold AND bid_u > threshold GROUP BY symbol, buffer_pct"""
