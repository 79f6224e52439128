"""Tick tape, sessions and intents as steps over the ``events`` table; a symbol is an event type.

A tape is numbered by days: ticks within (symbol, day), days by the ticks before them. What needs the tick before takes it
within the day, and for a day's first tick from a small table of days. So no task sorts more than one symbol's day.
"""

_COLUMNS = """MICROS(ts) * 1000 AS ts_ns, DAYNUM(ts) AS session_day, CAST(round(value * 100) AS BIGINT) AS bid_u,
       CAST(round(value * 100) AS BIGINT) + user_id % 4 AS ask_u"""

DAYS = ("tape_days", ("SELECT event_type AS symbol, DAYNUM(ts) AS session_day, count(*) AS n FROM events GROUP BY event_type, DAYNUM(ts)", None))
STARTS = ("tape_starts", ("SELECT symbol, session_day, sum(n) OVER (PARTITION BY symbol ORDER BY session_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS before FROM tape_days", None))
TICKS = ("ticks", (
    f"""
SELECT e.symbol, CAST(s.before + e.n AS BIGINT) AS seq, e.ts_ns, e.session_day, e.bid_u, e.ask_u
FROM (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type, DAYNUM(ts) ORDER BY ts, event_id) AS n, {_COLUMNS} FROM events) e
JOIN tape_starts s ON s.symbol <=> e.symbol AND s.session_day <=> e.session_day""",
    f"SELECT event_type AS symbol, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS seq, {_COLUMNS} FROM events",
))
TAPE = (DAYS, STARTS, TICKS)


def carried(name: str, source: str, values: dict[str, str], where: str = "TRUE") -> tuple:
    """Steps that end in ``name``: ticks of ``source`` with ``values`` of the tick before as before_<value>."""
    own, cols = "symbol, seq, ts_ns, session_day, bid_u, ask_u", list(values)
    ends = ", ".join(f"max_by({e}, seq) AS {c}" for c, e in values.items())
    prior = ", ".join(f"lag({c}) OVER (PARTITION BY symbol ORDER BY session_day) AS {c}" for c in cols)
    lags = ", ".join(f"lag({e}) OVER w AS l_{c}" for c, e in values.items())
    taken = ", ".join(f"coalesce(t.l_{c}, p.{c}) AS before_{c}" for c in cols)
    return (
        (f"{name}_ends", (f"SELECT symbol, session_day, {ends} FROM {source} WHERE {where} GROUP BY symbol, session_day", None)),
        (f"{name}_prior", (f"SELECT symbol, session_day, {prior} FROM {name}_ends", None)),
        (name, (
            f"""
SELECT t.symbol, t.seq, t.ts_ns, t.session_day, t.bid_u, t.ask_u, {taken}
FROM (SELECT {own}, {lags} FROM {source} WHERE {where} WINDOW w AS (PARTITION BY symbol, session_day ORDER BY seq)) t
JOIN {name}_prior p ON p.symbol <=> t.symbol AND p.session_day <=> t.session_day""",
            f"SELECT {own}, {', '.join(f'lag({e}) OVER w AS before_{c}' for c, e in values.items())} FROM {source} WHERE {where} WINDOW w AS (PARTITION BY symbol ORDER BY seq)",
        )),
    )


#: For audits: some quotes are crossed.
RAW = ("raw", "SELECT symbol, seq, ts_ns, session_day, bid_u, bid_u + seq % 11 - 1 AS ask_u FROM ticks")

SESSIONS = ("sessions", """
SELECT symbol, session_day, min(seq) AS open_seq, max(seq) AS close_seq, min(ts_ns) AS open_ts_ns, max(ts_ns) AS close_ts_ns,
       CAST(0 AS BIGINT) AS utc_offset_seconds
FROM ticks GROUP BY symbol, session_day""")

#: Every seventh tick of a tape is a signal; the side follows its parity.
INTENTS = ("intents", """
SELECT t.symbol, t.seq AS intent_id, CASE WHEN t.seq % 2 = 0 THEN 1 ELSE -1 END AS side, t.seq AS signal_seq, s.close_seq AS session_close_seq,
       CAST(1500 AS BIGINT) AS stop_u, CAST(2500 AS BIGINT) AS target_u, t.session_day
FROM ticks t JOIN sessions s ON t.symbol = s.symbol AND t.session_day = s.session_day
WHERE t.seq % 7 = 0 AND t.seq < s.close_seq""")
