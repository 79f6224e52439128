"""Crosses of ticks over levels of twelve structures with four buffers each: up and down, listed one by one.

A structure is a window of pivots and a rule for ties. A tick crosses upwards every threshold from its predecessor's price up
to, but not including, its own; downwards likewise. Thresholds of a bar are sorted and searched for both prices, so a tick
costs two searches and its crosses, however many thresholds there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Windows of the pivots, and buffers in hundredths of the average range.
WIDTHS, BUFFERS = (3, 5, 7, 9, 11, 13), (0, 5, 10, 25)
#: Ties on the right: a strict pivot tops them all, a loose one may equal some.
TIES = {"strict": (">", "<"), "loose": (">=", "<=")}
STRUCTURES = [(f"{tie}{w}", w, tie) for w in WIDTHS for tie in TIES]


def _flag(w: int, tie: str, high: bool) -> str:
    side, on_left, on_right = ("high_u", ">=", TIES[tie][0]) if high else ("low_u", "<=", TIES[tie][1])
    best = "max" if high else "min"
    half = w // 2
    return f"bar > {half} AND count(*) OVER r{w} = {half} AND {side} {on_left} {best}({side}) OVER l{w} AND {side} {on_right} {best}({side}) OVER r{w}"


_FLAGS = ", ".join(f"{_flag(w, tie, high)} AS {'h' if high else 'l'}_{name}" for name, w, tie in STRUCTURES for high in (True, False))
_FRAMES = ", ".join(f"l{w} AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {w // 2} PRECEDING AND 1 PRECEDING), r{w} AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND {w // 2} FOLLOWING)" for w in WIDTHS)
_NAMES = ", ".join(f"('{name}', {w // 2 + 1})" for name, w, _ in STRUCTURES)


def _pick(kind: str) -> str:
    return f"CASE v.structure {' '.join(f'''WHEN '{name}' THEN {kind}_{name}''' for name, _, _ in STRUCTURES)} END"


#: All pivots in one ordering of the bars; each is known one bar after its window closes.
PIVOTS = ("all_pivots", f"SELECT symbol, bar, high_u, low_u, {_FLAGS} FROM nb WINDOW {_FRAMES}")
KNOWN = ("known_pivots", f"""
SELECT symbol, structure, bar, bar + delay AS known_at, CASE WHEN is_high THEN high_u END AS hi, CASE WHEN is_high THEN bar END AS hi_bar, CASE WHEN is_low THEN low_u END AS lo, CASE WHEN is_low THEN bar END AS lo_bar FROM (
  SELECT symbol, bar, high_u, low_u, v.structure, v.delay, {_pick('h')} AS is_high, {_pick('l')} AS is_low FROM all_pivots CROSS JOIN (VALUES {_NAMES}) AS v(structure, delay)) WHERE is_high OR is_low""")
IN_FORCE = ("all_levels", f"""
SELECT symbol, structure, bar, LASTKNOWN(hi) OVER w AS high_level, LASTKNOWN(hi_bar) OVER w AS high_id, LASTKNOWN(lo) OVER w AS low_level, LASTKNOWN(lo_bar) OVER w AS low_id FROM (
  SELECT b.symbol, v.structure, b.bar, k.hi, k.hi_bar, k.lo, k.lo_bar FROM nb b CROSS JOIN (VALUES {_NAMES}) AS v(structure, delay)
  LEFT JOIN known_pivots k ON k.symbol = b.symbol AND k.structure = v.structure AND k.known_at = b.bar)
WINDOW w AS (PARTITION BY symbol, structure ORDER BY bar ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
#: Thresholds that the bar's extremes leave possible; without an average range only the level itself.
THRESHOLDS = f"""
SELECT symbol, session_day, bucket, bar, structure, side, buffer_pct, level_id, threshold FROM (
  SELECT b.symbol, b.session_day, b.bucket, b.bar, b.high_u, b.low_u, l.structure, s.side, p.buffer_pct, CASE s.side WHEN 1 THEN l.high_id ELSE l.low_id END AS level_id,
         CASE s.side WHEN 1 THEN l.high_level ELSE l.low_level END + CASE p.buffer_pct WHEN 0 THEN 0.0 ELSE s.side * a.atr14 * p.buffer_pct / 100.0 END AS threshold
  FROM nb b JOIN all_levels l ON l.symbol = b.symbol AND l.bar = b.bar LEFT JOIN atrs a ON a.symbol = b.symbol AND a.bar = b.bar - 1
  CROSS JOIN (VALUES (1), (-1)) AS s(side) CROSS JOIN (VALUES {", ".join(f"({b})" for b in BUFFERS)}) AS p(buffer_pct))
WHERE threshold IS NOT NULL AND (side = 1 AND high_u > threshold OR side = -1 AND low_u < threshold)"""
MOVES = "SELECT symbol, session_day, ts_ns ~div~ 3600000000000 AS bucket, seq, before_bid, bid_u FROM {0} WHERE before_bid <> bid_u"

#: The same by a plain range join, for checking.
PLAIN = """
SELECT m.symbol, t.structure, t.side, t.buffer_pct, t.level_id, t.bar, m.seq FROM m JOIN t ON t.symbol = m.symbol AND t.session_day = m.session_day AND t.bucket = m.bucket
WHERE t.side = 1 AND m.before_bid <= t.threshold AND m.bid_u > t.threshold OR t.side = -1 AND m.before_bid >= t.threshold AND m.bid_u < t.threshold"""

BAR = ["symbol", "session_day", "bucket"]
OUT = ["symbol", "structure", "side", "buffer_pct", "level_id", "bar", "seq"]


def _met(moves: pd.DataFrame, bands: pd.DataFrame) -> pd.DataFrame:
    """Crosses of one symbol's day, bar by bar: both sides of a bar's thresholds are sorted once and searched for all its moves."""
    moves, bands = moves.sort_values("bucket", kind="stable"), bands.sort_values(["side", "bucket", "threshold"], kind="stable")
    before, now = moves["before_bid"].to_numpy(), moves["bid_u"].to_numpy()
    bucket = moves["bucket"].to_numpy()
    values, own = bands["threshold"].to_numpy(), bands["bucket"].to_numpy()
    down = int((bands["side"] == -1).sum())  # these come first
    ticks, hits = [], []
    for b in np.unique(bucket):
        m = np.arange(*np.searchsorted(bucket, [b, b + 1]))
        for first, last, up in ((0, down, False), (down, len(values), True)):
            lo, hi = first + np.searchsorted(own[first:last], [b, b + 1])
            tick = m[now[m] > before[m]] if up else m[now[m] < before[m]]
            if lo == hi or not len(tick):
                continue
            x, y = (before, now) if up else (now, before)
            low, high = (lo + np.searchsorted(values[lo:hi], v[tick], "left" if up else "right") for v in (x, y))
            n = high - low
            ticks.append(np.repeat(tick, n))
            hits.append(np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum()))
    if not hits:
        return pd.DataFrame(columns=OUT)
    found = bands.iloc[np.concatenate(hits)]
    return found.assign(seq=moves["seq"].to_numpy()[np.concatenate(ticks)])[OUT]


def crosses(moves: DataFrame, bands: DataFrame) -> DataFrame:
    """Every cross of ``moves`` (a bar's key, seq, before_bid, bid_u) over ``bands`` (the same key, threshold and names).

    Moves that reach none of their bar's thresholds are left out before they are grouped; a group is a symbol's day.
    """
    reach = bands.groupBy(*BAR).agg(*(f(F.when(F.col("side") == s, F.col("threshold"))).alias(n) for f, s, n in ((F.min, 1, "low_up"), (F.max, 1, "high_up"), (F.min, -1, "low_down"), (F.max, -1, "high_down"))))
    near = moves.join(reach, BAR).where("bid_u > low_up and before_bid <= high_up or bid_u < high_down and before_bid >= low_down").select(*moves.columns)
    return near.groupBy(*BAR[:2]).cogroup(bands.groupBy(*BAR[:2])).applyInPandas(_met, "symbol string, structure string, side int, buffer_pct int, level_id bigint, bar bigint, seq bigint")
