"""Audits of tapes, sessions, spreads and offsets."""

TAPE = """
SELECT symbol, count(*) AS n_rows, count_if(ask_u = bid_u) AS zero_spread, count_if(ask_u < bid_u) AS crossed, count_if(seq <> before_seq + 1) AS seq_breaks,
       count_if(ts_ns < before_ts) AS time_reversals, count_if(session_day < before_day) AS day_reversals, count_if(ts_ns = before_ts) AS same_time,
       count_if(ts_ns = before_ts AND bid_u = before_bid AND ask_u = before_ask) AS repeated, count_if(bid_u <= 0 OR ask_u <= 0) AS not_positive,
       max(CASE WHEN session_day = before_day THEN ts_ns - before_ts END) AS max_gap_ns, count_if(bid_u % 5 <> 0) AS off_grid
FROM followed GROUP BY symbol"""
FOLLOWED = {"seq": "seq", "ts": "ts_ns", "day": "session_day", "bid": "bid_u", "ask": "ask_u"}

SPREADS = """
SELECT symbol, min(s) AS min_spread, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY s) AS BIGINT) AS p50, CAST(percentile_disc(0.95) WITHIN GROUP (ORDER BY s) AS BIGINT) AS p95,
       CAST(percentile_disc(0.99) WITHIN GROUP (ORDER BY s) AS BIGINT) AS p99, max(s) AS max_spread
FROM (SELECT symbol, ask_u - bid_u AS s FROM raw WHERE ask_u >= bid_u) GROUP BY symbol"""

SESSION_MAP = "SELECT symbol, session_day, open_seq, close_seq, open_ts_ns, close_ts_ns, utc_offset_seconds FROM sessions"

MEMBERS = """
SELECT s.symbol, s.session_day, count(*) AS n_ticks, count_if(t.ask_u > t.bid_u) AS executable
FROM ticks t JOIN sessions s ON t.symbol = s.symbol AND t.session_day = s.session_day AND t.seq BETWEEN s.open_seq AND s.close_seq
GROUP BY s.symbol, s.session_day"""

SESSIONS = """
SELECT symbol, count(*) AS n_sessions, count_if(open_seq <> prev_close + 1) AS not_contiguous, count_if(open_ts_ns < prev_ts) AS out_of_order,
       count_if(utc_offset_seconds <> prev_offset) AS offset_changes, count_if(abs(utc_offset_seconds) > 50400) AS odd_offsets
FROM (SELECT symbol, open_seq, close_seq, open_ts_ns, utc_offset_seconds, lag(close_seq) OVER w AS prev_close, lag(close_ts_ns) OVER w AS prev_ts,
             lag(utc_offset_seconds) OVER w AS prev_offset FROM sessions WINDOW w AS (PARTITION BY symbol ORDER BY session_day))
GROUP BY symbol"""

#: Half-open offset segments, checked against anchors (server wall time, UTC) taken every 500 ticks.
SEGMENTS = ("segments", """
SELECT symbol, CAST(k AS BIGINT) AS segment_id, lo + k * width AS start_ns, lo + (k + 1) * width AS end_ns, 7200 + 3600 * (k % 2) AS offset_seconds
FROM (SELECT symbol, min(ts_ns) AS lo, (max(ts_ns) - min(ts_ns)) ~div~ 3 + 1 AS width FROM ticks GROUP BY symbol) CROSS JOIN (VALUES (0), (1), (2)) AS v(k)""")
ANCHORS = ("anchors", "SELECT symbol, seq AS anchor_id, ts_ns AS utc_ns, ts_ns + (7200 + 3600 * (seq % 3 ~div~ 2)) * CAST(1000000000 AS BIGINT) AS server_ns FROM ticks WHERE seq % 500 = 1")
TIME_AUTHORITY = """
SELECT g.symbol, g.segment_id, count(a.anchor_id) AS anchors, count_if(a.server_ns - a.utc_ns <> g.offset_seconds * CAST(1000000000 AS BIGINT)) AS conflicts,
       min(a.utc_ns - g.start_ns) AS after_start_ns, min(g.end_ns - a.utc_ns) AS before_end_ns
FROM segments g LEFT JOIN anchors a ON a.symbol = g.symbol AND a.utc_ns >= g.start_ns AND a.utc_ns < g.end_ns GROUP BY g.symbol, g.segment_id"""

SHARD_CHAIN = """
SELECT symbol, shard, n_rows, first_seq = prev_last + 1 AS continues, first_ts_ns >= prev_ts AS in_time
FROM (SELECT symbol, shard, n_rows, first_seq, first_ts_ns, lag(last_seq) OVER w AS prev_last, lag(last_ts_ns) OVER w AS prev_ts
      FROM (SELECT symbol, (seq - 1) ~div~ 1000 AS shard, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns
            FROM ticks GROUP BY symbol, (seq - 1) ~div~ 1000) WINDOW w AS (PARTITION BY symbol ORDER BY shard))"""
