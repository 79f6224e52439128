"""Volatility brackets, path-dependent exits and exact-decimal exits after bar signals.

A signal enters at the next executable quote of its session and is held for twenty bars or to the session's end. Ticks are
met through (symbol, day, bucket) keys, at most 21 bars an entry, so no join ranges over a tape.
"""

HOLD = 20

#: Simple mean true range over 14 and 50 bars; missing until the window is full.
ATRS = ("atrs", """
SELECT symbol, bar, tr, close_u, CASE WHEN count(*) OVER w = 14 THEN avg(tr) OVER w END AS atr14, CASE WHEN count(*) OVER v = 50 THEN avg(tr) OVER v END AS atr50 FROM tr
WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), v AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")

SIGNALS = ("signals", f"""
SELECT s.symbol, s.bar AS intent_id, s.side, b.session_day, b.last_seq AS signal_seq, b.limit_seq, CAST(floor(3 * a.atr14) AS BIGINT) AS stop_u, CAST(floor(4.5 * a.atr14) AS BIGINT) AS target_u
FROM shocks s JOIN (SELECT symbol, bar, session_day, last_seq, max(last_seq) OVER f AS limit_seq FROM nb
  WINDOW f AS (PARTITION BY symbol, session_day ORDER BY bar ROWS BETWEEN CURRENT ROW AND {HOLD} FOLLOWING)) b ON b.symbol = s.symbol AND b.bar = s.bar
JOIN atrs a ON a.symbol = s.symbol AND a.bar = s.bar WHERE s.threshold = 10 AND a.atr14 > 0""")

ENTERED = ("entered", """
SELECT i.symbol, i.session_day, i.intent_id, i.side, i.stop_u, i.target_u, i.limit_seq, n.entry_seq, t.ts_ns AS entry_ts_ns, t.ts_ns ~div~ 3600000000000 AS entry_bucket,
       CASE WHEN i.side = 1 THEN t.ask_u ELSE t.bid_u END AS entry_u
FROM signals i JOIN nexts n ON n.symbol = i.symbol AND n.seq = i.signal_seq JOIN ticks t ON t.symbol = n.symbol AND t.seq = n.entry_seq WHERE n.entry_seq < i.limit_seq""")

#: The bars that an entry may be held in, met by number: a gap between bars does not shorten the holding time.
HELD = ("held", f"""
SELECT e.symbol, e.session_day, e.intent_id, e.side, e.stop_u, e.target_u, e.limit_seq, e.entry_seq, e.entry_bucket, e.entry_u, b.bucket
FROM entered e CROSS JOIN (SELECT SERIES(0, {HOLD}) AS k) s JOIN nb b ON b.symbol = e.symbol AND b.bar = e.intent_id + s.k AND b.session_day = e.session_day WHERE b.bucket >= e.entry_bucket""")

REACHED = ("reached", """
SELECT h.symbol, h.intent_id, min(CASE WHEN h.bucket > h.entry_bucket AND (h.side = 1 AND (x.min_bid <= h.entry_u - h.stop_u OR x.max_bid >= h.entry_u + h.target_u)
       OR h.side = -1 AND (x.max_ask >= h.entry_u + h.stop_u OR x.min_ask <= h.entry_u - h.target_u)) THEN x.bucket END) AS bucket, max(x.last_seq) AS last_exec
FROM held h JOIN xbars x ON x.symbol = h.symbol AND x.session_day = h.session_day AND x.bucket = h.bucket GROUP BY h.symbol, h.intent_id""")

STRUCK = ("struck", """
SELECT h.symbol, h.intent_id, min(t.seq) AS hit_seq FROM held h JOIN reached r ON r.symbol = h.symbol AND r.intent_id = h.intent_id AND (h.bucket = h.entry_bucket OR h.bucket = r.bucket)
JOIN ticks t ON t.symbol = h.symbol AND t.session_day = h.session_day AND t.ts_ns ~div~ 3600000000000 = h.bucket
WHERE t.seq > h.entry_seq AND t.seq <= h.limit_seq AND t.ask_u > t.bid_u AND (h.side = 1 AND (t.bid_u <= h.entry_u - h.stop_u OR t.bid_u >= h.entry_u + h.target_u)
   OR h.side = -1 AND (t.ask_u >= h.entry_u + h.stop_u OR t.ask_u <= h.entry_u - h.target_u)) GROUP BY h.symbol, h.intent_id""")

#: Stop three times the range, target 4.5 times, else the last quote of the holding time.
BRACKETS = """
SELECT e.symbol, e.intent_id, e.side, e.stop_u, e.entry_seq, e.entry_u, x.seq AS exit_seq, CASE WHEN e.side = 1 THEN x.bid_u ELSE x.ask_u END AS exit_u,
       CASE WHEN k.hit_seq IS NULL THEN 'TIME' WHEN e.side = 1 AND x.bid_u <= e.entry_u - e.stop_u OR e.side = -1 AND x.ask_u >= e.entry_u + e.stop_u THEN 'STOP' ELSE 'TARGET' END AS reason,
       round(e.side * (CASE WHEN e.side = 1 THEN x.bid_u ELSE x.ask_u END - e.entry_u) * 1.0 / e.stop_u, 6) AS r
FROM entered e JOIN reached m ON m.symbol = e.symbol AND m.intent_id = e.intent_id LEFT JOIN struck k ON k.symbol = e.symbol AND k.intent_id = e.intent_id
JOIN ticks x ON x.symbol = e.symbol AND x.seq = coalesce(k.hit_seq, m.last_exec) WHERE e.stop_u > 0 AND x.seq > e.entry_seq"""

#: Gain of every executable quote while held, and the best gain before it. A stop that moves takes effect on the next quote.
PATHS = ("paths", """
SELECT symbol, session_day, intent_id, side, stop_u, target_u, entry_seq, entry_u, seq, ts_ns, gain, max(gain) OVER (PARTITION BY symbol, intent_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (
  SELECT h.symbol, h.session_day, h.intent_id, h.side, h.stop_u, h.target_u, h.entry_seq, h.entry_u, t.seq, t.ts_ns, h.side * (CASE WHEN h.side = 1 THEN t.bid_u ELSE t.ask_u END - h.entry_u) AS gain
  FROM held h JOIN ticks t ON t.symbol = h.symbol AND t.session_day = h.session_day AND t.ts_ns ~div~ 3600000000000 = h.bucket
  WHERE t.seq > h.entry_seq AND t.seq <= h.limit_seq AND t.ask_u > t.bid_u)""")


def managed(break_even: str = "stop_u", trail: str = "2 * stop_u") -> tuple[str, str]:
    """Exits with a stop that goes to the entry after a gain of ``break_even`` and trails the best gain by ``trail``."""
    floor = f"greatest(-stop_u, CASE WHEN best >= {break_even} THEN 0 ELSE -stop_u END, coalesce(best - ({trail}), -stop_u))"
    return "managed", f"""
SELECT symbol, session_day, intent_id, side, stop_u, entry_seq, entry_u, exit_seq, gain_u, mae_u, mfe_u, CASE WHEN exit_hit IS NULL THEN 'TIME' WHEN gain_u >= target_u THEN 'TARGET' WHEN level > -stop_u THEN 'MOVED_STOP' ELSE 'STOP' END AS reason FROM (
  SELECT symbol, session_day, intent_id, side, stop_u, target_u, entry_seq, entry_u, max(exit_hit) AS exit_hit, max(seq) AS exit_seq, max_by(gain, seq) AS gain_u, max_by(level, seq) AS level, least(0, min(gain)) AS mae_u, greatest(0, max(gain)) AS mfe_u FROM (
    SELECT symbol, session_day, intent_id, side, stop_u, target_u, entry_seq, entry_u, seq, gain, level, min(CASE WHEN gain <= level OR gain >= target_u THEN seq END) OVER (PARTITION BY symbol, intent_id) AS exit_hit FROM (
      SELECT symbol, session_day, intent_id, side, stop_u, target_u, entry_seq, entry_u, seq, gain, {floor} AS level FROM paths))
  WHERE exit_hit IS NULL OR seq <= exit_hit GROUP BY symbol, session_day, intent_id, side, stop_u, target_u, entry_seq, entry_u)"""


MANAGED = "SELECT symbol, session_day, intent_id, side, entry_seq, entry_u, exit_seq, gain_u, mae_u, mfe_u, reason FROM managed"

#: Stop or time exit only, the entry record itself included; R as an exact decimal.
EXACT_R = """
SELECT symbol, intent_id, exit_seq, reason, CAST(CAST(side * (exit_u - entry_u) AS DECIMAL(18, 0)) / CAST(stop_u AS DECIMAL(18, 0)) AS DOUBLE) AS r FROM (
  SELECT e.symbol, e.intent_id, e.side, e.stop_u, e.entry_u, x.seq AS exit_seq, CASE WHEN e.side = 1 THEN x.bid_u ELSE x.ask_u END AS exit_u, CASE WHEN s.hit_seq IS NULL THEN 'TIME' ELSE 'STOP' END AS reason
  FROM entered e JOIN (
    SELECT h.symbol, h.intent_id, min(CASE WHEN h.side = 1 AND t.bid_u <= h.entry_u - h.stop_u OR h.side = -1 AND t.ask_u >= h.entry_u + h.stop_u THEN t.seq END) AS hit_seq, max(t.seq) AS last_seq
    FROM held h JOIN ticks t ON t.symbol = h.symbol AND t.session_day = h.session_day AND t.ts_ns ~div~ 3600000000000 = h.bucket
    WHERE t.seq >= h.entry_seq AND t.seq <= h.limit_seq AND t.ask_u > t.bid_u GROUP BY h.symbol, h.intent_id) s ON s.symbol = e.symbol AND s.intent_id = e.intent_id
  JOIN ticks x ON x.symbol = e.symbol AND x.seq = coalesce(s.hit_seq, s.last_seq)) WHERE stop_u > 0"""

STEPS = (ATRS, SIGNALS, ENTERED, HELD)
