"""Entries, first-touch exits and the ledger.

The next executable quote is a running minimum over the session read backwards. An exit is looked for in two steps: bars
whose executable extremes reach a level, then the ticks of the entry's own bar and of the first later bar that does.
"""

NEXT = ("nexts", """
SELECT symbol, seq, session_day, min(CASE WHEN ask_u > bid_u THEN seq END) OVER w AS entry_seq FROM ticks
WINDOW w AS (PARTITION BY symbol, session_day ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")

ENTRIES = ("entries", """
SELECT i.symbol, i.session_day, i.intent_id, i.side, i.stop_u, i.target_u, i.session_close_seq, n.entry_seq, t.ts_ns ~div~ 3600000000000 AS entry_bucket, t.ts_ns AS entry_ts_ns,
       CASE WHEN i.side = 1 THEN t.ask_u ELSE t.bid_u END AS entry_u
FROM intents i JOIN nexts n ON n.symbol = i.symbol AND n.seq = i.signal_seq LEFT JOIN ticks t ON t.symbol = n.symbol AND t.seq = n.entry_seq""")

XBARS = ("xbars", """
SELECT symbol, session_day, ts_ns ~div~ 3600000000000 AS bucket, min(bid_u) AS min_bid, max(bid_u) AS max_bid, min(ask_u) AS min_ask, max(ask_u) AS max_ask, max(seq) AS last_seq
FROM ticks WHERE ask_u > bid_u GROUP BY symbol, session_day, ts_ns ~div~ 3600000000000""")

LATER = ("later", """
SELECT e.symbol, e.intent_id, min(x.bucket) AS bucket FROM entries e JOIN xbars x ON x.symbol = e.symbol AND x.session_day = e.session_day AND x.bucket > e.entry_bucket
 AND (e.side = 1 AND (x.min_bid <= e.entry_u - e.stop_u OR x.max_bid >= e.entry_u + e.target_u) OR e.side = -1 AND (x.max_ask >= e.entry_u + e.stop_u OR x.min_ask <= e.entry_u - e.target_u))
GROUP BY e.symbol, e.intent_id""")

HITS = ("hits", """
SELECT e.symbol, e.intent_id, min(t.seq) AS hit_seq FROM (
  SELECT symbol, intent_id, entry_bucket AS bucket FROM entries WHERE entry_seq IS NOT NULL UNION ALL SELECT symbol, intent_id, bucket FROM later) k
JOIN entries e ON e.symbol = k.symbol AND e.intent_id = k.intent_id
JOIN ticks t ON t.symbol = e.symbol AND t.session_day = e.session_day AND t.ts_ns ~div~ 3600000000000 = k.bucket AND t.seq > e.entry_seq AND t.ask_u > t.bid_u
 AND (e.side = 1 AND (t.bid_u <= e.entry_u - e.stop_u OR t.bid_u >= e.entry_u + e.target_u) OR e.side = -1 AND (t.ask_u >= e.entry_u + e.stop_u OR t.ask_u <= e.entry_u - e.target_u))
GROUP BY e.symbol, e.intent_id""")

LAST_QUOTE = ("lastq", "SELECT symbol, session_day, max(seq) AS last_exec FROM ticks WHERE ask_u > bid_u GROUP BY symbol, session_day")

#: The stop is looked at before the target on one record; gaps fill at the quote that is there.
TRADES = ("trades", """
SELECT e.symbol, e.session_day, e.intent_id, e.side, e.stop_u, e.target_u, e.entry_seq, e.entry_ts_ns, e.entry_u, x.seq AS exit_seq, x.ts_ns AS exit_ts_ns,
       CASE WHEN e.side = 1 THEN x.bid_u ELSE x.ask_u END AS exit_u,
       CASE WHEN e.entry_seq IS NULL THEN 'NO_ENTRY' WHEN x.seq IS NULL THEN 'UNRESOLVED' WHEN h.hit_seq IS NULL THEN 'CLOSE'
            WHEN e.side = 1 AND x.bid_u <= e.entry_u - e.stop_u OR e.side = -1 AND x.ask_u >= e.entry_u + e.stop_u THEN 'STOP' ELSE 'TARGET' END AS reason
FROM entries e LEFT JOIN hits h ON h.symbol = e.symbol AND h.intent_id = e.intent_id
LEFT JOIN lastq q ON q.symbol = e.symbol AND q.session_day = e.session_day
LEFT JOIN ticks x ON x.symbol = e.symbol AND x.seq = coalesce(h.hit_seq, CASE WHEN q.last_exec > e.entry_seq THEN q.last_exec END)""")

LEDGER = ("ledger", """
SELECT symbol, session_day, intent_id, side, entry_seq, entry_ts_ns, entry_u, exit_seq, exit_ts_ns, exit_u, reason, side * (exit_u - entry_u) AS net_u, stop_u AS risk_u
FROM trades WHERE exit_seq IS NOT NULL""")

STEPS = (NEXT, ENTRIES, XBARS, LATER, HITS, LAST_QUOTE, TRADES, LEDGER)

REPLAY = "SELECT symbol, intent_id, side, entry_seq, entry_u, exit_seq, exit_u, reason, side * (exit_u - entry_u) AS net_u FROM trades"
LABELS = "SELECT symbol, intent_id, CASE reason WHEN 'TARGET' THEN 1 WHEN 'STOP' THEN 0 END AS target_first FROM trades"
COSTS = """
SELECT l.symbol, l.intent_id, round(l.net_u * 1.0 / l.risk_u, 6) AS r, round((l.net_u - 2) * 1.0 / l.risk_u, 6) AS conservative_r, round((l.net_u - 5) * 1.0 / l.risk_u, 6) AS severe_r,
       round(l.net_u * 1.0 / l.risk_u - 0.5 * (a.ask_u - a.bid_u + b.ask_u - b.bid_u) / l.risk_u, 6) AS half_spread_r
FROM ledger l JOIN ticks a ON a.symbol = l.symbol AND a.seq = l.entry_seq JOIN ticks b ON b.symbol = l.symbol AND b.seq = l.exit_seq"""
#: A symbol's trades are ordered by days, each with the last exit of the day before; positions are numbered likewise.
TRADE_DAYS = ("trade_days", ("""
SELECT symbol, session_day, n - own AS before_n, lag(last_exit) OVER (PARTITION BY symbol ORDER BY session_day) AS before_exit FROM (
  SELECT symbol, session_day, own, last_exit, sum(own) OVER (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (
    SELECT symbol, session_day, count(*) AS own, max_by(exit_seq, struct(entry_seq, intent_id)) AS last_exit FROM ledger GROUP BY symbol, session_day))""", None))
FOLLOWING = ("following", (
    """
SELECT l.*, coalesce(l.own_exit, d.before_exit) AS prev_exit FROM (SELECT *, lag(exit_seq) OVER (PARTITION BY symbol, session_day ORDER BY entry_seq, intent_id) AS own_exit FROM ledger) l
JOIN trade_days d ON d.symbol = l.symbol AND d.session_day = l.session_day""",
    "SELECT *, lag(exit_seq) OVER (PARTITION BY symbol ORDER BY entry_seq, intent_id) AS prev_exit FROM ledger",
))
VALIDATE = """
SELECT symbol, count(*) AS n_trades, count(*) - count(DISTINCT intent_id) AS repeated, count_if(exit_seq <= entry_seq) AS backwards, count_if(exit_ts_ns < entry_ts_ns) AS time_reversed,
       count_if(net_u <> side * (exit_u - entry_u)) AS unbalanced, count_if(reason = 'STOP' AND net_u > -risk_u) AS weak_stops, count_if(entry_seq <= prev_exit) AS overlapping FROM following GROUP BY symbol"""


def numbered(name: str, where: str) -> tuple:
    """Steps that end in ``name``: a symbol's trades with their positions, by days."""
    return (
        (f"{name}_days", (f"SELECT symbol, session_day, sum(own) OVER (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - own AS earlier FROM (SELECT symbol, session_day, count(*) AS own FROM ledger WHERE {where} GROUP BY symbol, session_day)", None)),
        (name, (
            f"SELECT l.symbol, l.intent_id, l.entry_seq, l.entry_u, l.own + d.earlier AS n FROM (SELECT symbol, session_day, intent_id, entry_seq, entry_u, row_number() OVER (PARTITION BY symbol, session_day ORDER BY entry_seq, intent_id) AS own FROM ledger WHERE {where}) l JOIN {name}_days d ON d.symbol = l.symbol AND d.session_day = l.session_day",
            f"SELECT symbol, intent_id, entry_seq, entry_u, row_number() OVER (PARTITION BY symbol ORDER BY entry_seq, intent_id) AS n FROM ledger WHERE {where}",
        )),
    )


POSITIONS, RETOLD = numbered("positions", "TRUE"), numbered("retold", "intent_id % 70 <> 0")
PARITY = """
SELECT CAST(count(*) AS BIGINT) AS positions, count_if(a_id IS NULL OR b_id IS NULL) AS missing, count_if(a_entry <> b_entry) AS signal_diff, count_if(a_u <> b_u) AS fill_diff FROM (
  SELECT a.intent_id AS a_id, b.intent_id AS b_id, a.entry_seq AS a_entry, b.entry_seq AS b_entry, a.entry_u AS a_u, b.entry_u + CASE WHEN b.intent_id % 35 = 0 THEN 1 ELSE 0 END AS b_u
  FROM positions a FULL OUTER JOIN retold b ON a.symbol = b.symbol AND a.n = b.n)"""

#: Signals with what became of them, for a scheduler of sessions: hours, entry, stop against the quote at entry, exit.
OUTCOMES = """
SELECT t.symbol, t.session_day, t.intent_id, t.intent_id AS signal_seq, t.exit_seq, s.ts_ns ~div~ 3600000000000 % 24 BETWEEN 6 AND 19 AND WEEKDAYOF(day) <= 5 AS inside,
       CASE WHEN t.entry_seq IS NULL THEN 'NO_ENTRY' WHEN q.ask_u - q.bid_u >= t.stop_u THEN 'GEOMETRY' WHEN t.exit_seq IS NULL THEN 'UNRESOLVED' ELSE '' END AS state, t.side * (t.exit_u - t.entry_u) * 1.0 / t.stop_u AS r
FROM (SELECT *, session_day AS day FROM trades) t JOIN ticks s ON s.symbol = t.symbol AND s.seq = t.intent_id LEFT JOIN ticks q ON q.symbol = t.symbol AND q.seq = t.entry_seq"""
#: The ledger as offers of two books, the buys before the sells, in an account's smallest unit of money.
OFFERS = """
SELECT symbol, session_day, entry_ts_ns, exit_ts_ns, CASE WHEN side = 1 THEN 0 ELSE 1 END AS priority, intent_id AS offer_id, CAST(3600000 AS BIGINT) AS bar_ms, net_u, CAST(CASE WHEN side = 1 THEN 1000 ELSE 1500 END AS BIGINT) AS usd_micro_per_unit FROM ledger"""
