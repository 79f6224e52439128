"""Bars and other per-bucket aggregates."""

HOUR_MS = 3_600_000


def bars(period_ms: int = HOUR_MS, name: str = "bars", source: str = "ticks", where: str = "TRUE") -> tuple[str, str]:
    """OHLC of the bid per (symbol, day, bucket); the first and last tick by sequence open and close it."""
    return name, f"""
SELECT symbol, session_day, ts_ns ~div~ {period_ms * 1_000_000} AS bucket, min_by(bid_u, seq) AS open_u, max(bid_u) AS high_u, min(bid_u) AS low_u,
       max_by(bid_u, seq) AS close_u, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_ticks, sum(ask_u - bid_u) AS spread_sum
FROM {source} WHERE {where} GROUP BY symbol, session_day, ts_ns ~div~ {period_ms * 1_000_000}"""


def coarser(factor: int, name: str, source: str = "bars") -> tuple[str, str]:
    """Bars of a multiple of the period, from finer bars instead of from ticks."""
    return name, f"""
SELECT symbol, bucket ~div~ {factor} AS bucket, min_by(open_u, first_seq) AS open_u, max(high_u) AS high_u, min(low_u) AS low_u,
       max_by(close_u, last_seq) AS close_u, min(first_seq) AS first_seq, max(last_seq) AS last_seq
FROM {source} GROUP BY symbol, bucket ~div~ {factor}"""


#: Numbered bars with the closed one before; only a bar with a successor is ever seen closed.
NUMBERED = ("nb", """
SELECT symbol, session_day, bucket, open_u, high_u, low_u, close_u, first_seq, last_seq, n_ticks, spread_sum,
       CAST(row_number() OVER w AS BIGINT) AS bar, lag(open_u) OVER w AS prev_open, lag(high_u) OVER w AS prev_high, lag(low_u) OVER w AS prev_low,
       lag(close_u) OVER w AS prev_close, lag(last_seq) OVER w AS prev_last, lag(bucket) OVER w AS prev_bucket
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bucket, session_day)""")

_STEPS = ", ".join(f"({n})" for n in (2, 3, 4, 5, 6, 10, 12, 15, 20, 30, 60, 120, 180, 240, 1440))
#: Fifteen time frames in minutes, rolled up from minute bars; checked by reading the ticks for each.
MULTI = (
    f"""
SELECT symbol, step, bucket ~div~ step AS bucket, min_by(open_u, first_seq) AS open_u, max(high_u) AS high_u, min(low_u) AS low_u,
       max_by(close_u, last_seq) AS close_u, min(first_seq) AS first_seq, max(last_seq) AS last_seq
FROM m1 CROSS JOIN (VALUES {_STEPS}) AS v(step) GROUP BY symbol, step, bucket ~div~ step""",
    f"""
SELECT symbol, step, (ts_ns ~div~ 1000000) ~div~ (step * 60000) AS bucket, min_by(bid_u, seq) AS open_u, max(bid_u) AS high_u, min(bid_u) AS low_u,
       max_by(bid_u, seq) AS close_u, min(seq) AS first_seq, max(seq) AS last_seq
FROM ticks CROSS JOIN (VALUES {_STEPS}) AS v(step) GROUP BY symbol, step, (ts_ns ~div~ 1000000) ~div~ (step * 60000)""",
)
#: Minute bars of the doubled middle between bid and ask.
MID = """
SELECT symbol, ts_ns ~div~ 60000000000 AS bucket, min_by(bid_u + ask_u, seq) AS open_mid2, max(bid_u + ask_u) AS high_mid2, min(bid_u + ask_u) AS low_mid2,
       max_by(bid_u + ask_u, seq) AS close_mid2 FROM ticks GROUP BY symbol, ts_ns ~div~ 60000000000"""

# 1970-01-01 was a Thursday: three days on, weeks begin on Monday.
WEEKLY = """
SELECT symbol, (ts_ns ~div~ 86400000000000 + 3) ~div~ 7 AS week, min_by(bid_u, seq) AS open_u, max(bid_u) AS high_u, min(bid_u) AS low_u,
       max_by(bid_u, seq) AS close_u, count(*) AS n_ticks
FROM ticks GROUP BY symbol, (ts_ns ~div~ 86400000000000 + 3) ~div~ 7"""

#: Feature bars from quotes that are not crossed, in doubled units; execution extremes from quotes with a spread.
EXEC_CACHE = """
SELECT symbol, ts_ns ~div~ 60000000000 AS minute, min_by(2 * bid_u, seq) FILTER (WHERE ask_u >= bid_u) AS open_bid2, max(2 * bid_u) FILTER (WHERE ask_u >= bid_u) AS high_bid2,
       min(2 * bid_u) FILTER (WHERE ask_u >= bid_u) AS low_bid2, max_by(2 * bid_u, seq) FILTER (WHERE ask_u >= bid_u) AS close_bid2,
       min_by(bid_u + ask_u, seq) FILTER (WHERE ask_u >= bid_u) AS open_mid2, max_by(bid_u + ask_u, seq) FILTER (WHERE ask_u >= bid_u) AS close_mid2,
       min(bid_u) FILTER (WHERE ask_u > bid_u) AS min_bid, max(ask_u) FILTER (WHERE ask_u > bid_u) AS max_ask,
       min(seq) FILTER (WHERE ask_u > bid_u) AS first_exec, max(seq) FILTER (WHERE ask_u > bid_u) AS last_exec
FROM raw GROUP BY symbol, ts_ns ~div~ 60000000000"""

COUNTS = """
SELECT symbol, session_day, bucket, n_ticks, CAST(sum(n_ticks) OVER (PARTITION BY symbol, session_day ORDER BY bucket) AS BIGINT) AS day_ticks FROM bars"""

COVERAGE = """
SELECT minute_of_close, count(*) AS days FROM (
  SELECT symbol, session_day, max(CASE WHEN ask_u > bid_u THEN (ts_ns ~div~ 60000000000) % 1440 END) AS minute_of_close FROM raw GROUP BY symbol, session_day)
GROUP BY minute_of_close"""

#: Reopening after a gap of more than one bucket, and how many bars have run since.
GAPS = """
SELECT symbol, bucket, reopening, CAST(row_number() OVER (PARTITION BY symbol, island ORDER BY bucket, session_day) AS BIGINT) AS run_length FROM (
  SELECT symbol, session_day, bucket, CASE WHEN prev_bucket IS NULL OR bucket - prev_bucket > 1 THEN 1 ELSE 0 END AS reopening,
         sum(CASE WHEN prev_bucket IS NULL OR bucket - prev_bucket > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY bucket, session_day) AS island
  FROM nb)"""

VALID = """
SELECT symbol, count(*) AS n_bars, count_if(bucket <= prev_bucket) AS not_increasing, count_if(first_seq <= prev_last) AS overlapping,
       count_if(high_u < greatest(open_u, close_u) OR low_u > least(open_u, close_u)) AS insane
FROM nb GROUP BY symbol"""

ZONES = """
SELECT symbol, (seq - 1) ~div~ 1024 AS block, min(bid_u) AS min_bid, max(ask_u) AS max_ask, min(ts_ns) AS first_ts_ns, max(ts_ns) AS last_ts_ns
FROM ticks GROUP BY symbol, (seq - 1) ~div~ 1024"""
