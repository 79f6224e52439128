"""Candidates: conditions of closed bars to signals, entries, exits with an expiry in records, and daily admission.

A condition is seen at the first tick of the next bar. A candidate enters at the next executable quote of its session and
leaves at its stop, at its target, at the first executable quote ``EXPIRY`` records on, or at the session's last one. Admission
within a day is a fold (functions.folds.schedule).
"""

from tideform.operators import execution

EXPIRY, STOP_U, TARGET_U = 50, 1500, 2500
_KEYS = "symbol, mode, side, signal_seq"
_HIT = "({q}.side = 1 AND ({x}.{lo_bid} <= {q}.entry_u - {stop} OR {x}.{hi_bid} >= {q}.entry_u + {target}) OR {q}.side = -1 AND ({x}.{hi_ask} >= {q}.entry_u + {stop} OR {x}.{lo_ask} <= {q}.entry_u - {target}))"


def _hit(q: str, x: str, bar: bool) -> str:
    names = {"lo_bid": "min_bid", "hi_bid": "max_bid", "lo_ask": "min_ask", "hi_ask": "max_ask"} if bar else {"lo_bid": "bid_u", "hi_bid": "bid_u", "lo_ask": "ask_u", "hi_ask": "ask_u"}
    return _HIT.format(q=q, x=x, stop=STOP_U, target=TARGET_U, **names)


#: Signals at each update at which a condition holds, or only where it did not hold at the one before.
RAISED = ("raised", """
SELECT symbol, mode, side, seen AS signal_seq FROM (
  SELECT symbol, v.mode, v.side, seen, CASE WHEN v.side = 1 THEN up ELSE down END AS holds, CASE WHEN v.side = 1 THEN coalesce(up_before, FALSE) ELSE coalesce(down_before, FALSE) END AS held FROM (
    SELECT symbol, lead(first_seq) OVER w AS seen, up, down, lag(up) OVER w AS up_before, lag(down) OVER w AS down_before
    FROM (SELECT symbol, bar, first_seq, close_u > open_u AND close_u > prev_close AS up, close_u < open_u AND close_u < prev_close AS down FROM nb) WINDOW w AS (PARTITION BY symbol ORDER BY bar))
  CROSS JOIN (VALUES ('RISING', 1), ('RISING', -1), ('EACH_UPDATE', 1), ('EACH_UPDATE', -1)) AS v(mode, side))
WHERE holds AND seen IS NOT NULL AND (mode = 'EACH_UPDATE' OR NOT held)""")
ENTERED = ("entered", """
SELECT r.symbol, r.mode, r.side, r.signal_seq, n.session_day, n.entry_seq, t.ts_ns ~div~ 3600000000000 AS entry_bucket, CASE WHEN r.side = 1 THEN t.ask_u ELSE t.bid_u END AS entry_u
FROM raised r JOIN nexts n ON n.symbol = r.symbol AND n.seq = r.signal_seq JOIN ticks t ON t.symbol = n.symbol AND t.seq = n.entry_seq""")
LATER = ("later", f"""
SELECT e.symbol, e.mode, e.side, e.signal_seq, min(x.bucket) AS bucket FROM entered e JOIN xbars x ON x.symbol = e.symbol AND x.session_day = e.session_day AND x.bucket > e.entry_bucket AND {_hit('e', 'x', True)}
GROUP BY e.symbol, e.mode, e.side, e.signal_seq""")
HITS = ("hits", f"""
SELECT k.symbol, k.mode, k.side, k.signal_seq, min(t.seq) AS hit_seq FROM (
  SELECT {_KEYS}, session_day, entry_seq, entry_u, entry_bucket AS bucket FROM entered
  UNION ALL SELECT e.symbol, e.mode, e.side, e.signal_seq, e.session_day, e.entry_seq, e.entry_u, l.bucket FROM later l JOIN entered e ON e.symbol = l.symbol AND e.mode = l.mode AND e.side = l.side AND e.signal_seq = l.signal_seq) k
JOIN ticks t ON t.symbol = k.symbol AND t.session_day = k.session_day AND t.ts_ns ~div~ 3600000000000 = k.bucket AND t.seq > k.entry_seq AND t.ask_u > t.bid_u AND {_hit('k', 't', False)}
GROUP BY k.symbol, k.mode, k.side, k.signal_seq""")
ENDS = ("ends", f"""
SELECT e.symbol, e.mode, e.side, e.signal_seq, e.session_day, e.entry_seq, e.entry_u, h.hit_seq, x.entry_seq AS expiry_seq, CASE WHEN q.last_exec > e.entry_seq THEN q.last_exec END AS last_seq
FROM entered e LEFT JOIN hits h ON h.symbol = e.symbol AND h.mode = e.mode AND h.side = e.side AND h.signal_seq = e.signal_seq
LEFT JOIN nexts x ON x.symbol = e.symbol AND x.seq = e.entry_seq + {EXPIRY - 1} AND x.session_day = e.session_day JOIN lastq q ON q.symbol = e.symbol AND q.session_day = e.session_day""")
OUTCOMES = f"""
SELECT c.symbol, c.mode, c.side, c.session_day, c.signal_seq * 2 + (1 - c.side) ~div~ 2 AS intent_id, c.entry_seq, c.entry_u, t.seq AS exit_seq, CASE WHEN c.side = 1 THEN t.bid_u ELSE t.ask_u END AS exit_u,
       CASE WHEN c.hit AND (c.side = 1 AND t.bid_u <= c.entry_u - {STOP_U} OR c.side = -1 AND t.ask_u >= c.entry_u + {STOP_U}) THEN 'STOP' WHEN c.hit THEN 'TARGET' WHEN c.expiry_seq IS NOT NULL THEN 'EXPIRY' ELSE 'CLOSE' END AS reason
FROM (SELECT {_KEYS}, session_day, entry_seq, entry_u, expiry_seq, hit_seq IS NOT NULL AND (expiry_seq IS NULL OR hit_seq <= expiry_seq) AS hit,
             CASE WHEN hit_seq IS NOT NULL AND (expiry_seq IS NULL OR hit_seq <= expiry_seq) THEN hit_seq ELSE coalesce(expiry_seq, last_seq) END AS exit_seq FROM ends) c
JOIN ticks t ON t.symbol = c.symbol AND t.seq = c.exit_seq"""
STEPS = (RAISED, execution.NEXT, ENTERED, execution.XBARS, LATER, HITS, execution.LAST_QUOTE, ENDS)

#: The same by looking at every later quote of the session.
CHECK = f"""
SELECT e.symbol, e.mode, e.side, e.session_day, e.signal_seq * 2 + (1 - e.side) ~div~ 2 AS intent_id, e.entry_seq, e.entry_u, min(x.seq) AS exit_seq, min_by(CASE WHEN e.side = 1 THEN x.bid_u ELSE x.ask_u END, x.seq) AS exit_u,
       min_by(CASE WHEN e.side = 1 AND x.bid_u <= e.entry_u - {STOP_U} OR e.side = -1 AND x.ask_u >= e.entry_u + {STOP_U} THEN 'STOP' WHEN e.side = 1 AND x.bid_u >= e.entry_u + {TARGET_U} OR e.side = -1 AND x.ask_u <= e.entry_u - {TARGET_U} THEN 'TARGET'
                   WHEN x.seq >= e.entry_seq + {EXPIRY} THEN 'EXPIRY' ELSE 'CLOSE' END, x.seq) AS reason
FROM (SELECT r.symbol, r.mode, r.side, r.signal_seq, s.session_day, min(t.seq) AS entry_seq, min_by(CASE WHEN r.side = 1 THEN t.ask_u ELSE t.bid_u END, t.seq) AS entry_u
      FROM raised r JOIN ticks s ON s.symbol = r.symbol AND s.seq = r.signal_seq JOIN ticks t ON t.symbol = s.symbol AND t.session_day = s.session_day AND t.seq > s.seq AND t.ask_u > t.bid_u GROUP BY r.symbol, r.mode, r.side, r.signal_seq, s.session_day) e
JOIN (SELECT symbol, session_day, seq, bid_u, ask_u, seq = max(seq) OVER (PARTITION BY symbol, session_day) AS is_last FROM ticks WHERE ask_u > bid_u) x
  ON x.symbol = e.symbol AND x.session_day = e.session_day AND x.seq > e.entry_seq AND (x.is_last OR x.seq >= e.entry_seq + {EXPIRY} OR {_hit('e', 'x', False)})
GROUP BY e.symbol, e.mode, e.side, e.session_day, e.signal_seq, e.entry_seq, e.entry_u"""
