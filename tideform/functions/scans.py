"""Recurrences over whole tapes, block by block in parallel.

A block is a run of consecutive rows of a symbol, whatever its length in time. What a block does to the value it begins with
is a function that can be written down without knowing that value: for a float average an affine map, for the integer one
(whose steps are cut to whole numbers) a step function, got by running every value that may begin the block, of which those
that meet go on as one. A symbol's functions, one row a block, are composed in order to give each block's first value; then
all blocks run at once. No task sees more than a block's rows, or a symbol's blocks.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideform.sources.written import written

BLOCK = 65_536
MERGE = 8  # steps between two looks for values that have met
END = 2_048  # rows at the end of a block that are looked at first


@dataclass(frozen=True)
class Average:
    """``name``: ``value`` smoothed over ``n``; kind is ``ema`` or ``wilder`` (float, from the mean of the first n) or ``ema_int``."""

    name: str
    value: str
    kind: str
    n: int

    @property
    def alpha(self) -> float:
        return 2 / (self.n + 1) if self.kind == "ema" else 1 / self.n


def _cut(x: np.ndarray, n: int) -> np.ndarray:
    """2 * x / (n + 1), cut towards zero."""
    twice = 2 * x
    return np.sign(twice) * (np.abs(twice) // (n + 1))


def int_map(x: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """What a block makes of a first value between ``low`` and ``high``: where its value changes, and the values.

    The step is monotone and brings values closer, so those that met stay together; in the end some n + 1 are left, or one. All
    values stay between ``low`` and ``high``: where the end of the block alone brings all of these to one, no row before it matters.
    """
    end = END
    while end < len(x):
        begin, e = _int_map(x[-end:], n, low, high)
        if len(e) == 1:
            return begin, e
        end *= 4
    return _int_map(x, n, low, high)


def _int_map(x: np.ndarray, n: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    begin = np.arange(low, high + 1, dtype=np.int64)
    e = begin.copy()
    for i, v in enumerate(x.tolist()):
        e = e + _cut(v - e, n)
        if i % MERGE == MERGE - 1 or i == len(x) - 1:
            new = np.concatenate([[True], e[1:] != e[:-1]])
            if not new.all():
                begin, e = begin[new], e[new]
    return begin, e


def int_run(x: np.ndarray, n: int, e: int | None) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for i, v in enumerate(x.tolist()):
        if e is None:
            e = v
        else:
            step = 2 * (v - e)
            e += step // (n + 1) if step >= 0 else -(-step // (n + 1))
        out[i] = e
    return out


def float_run(x: np.ndarray, specs: list[Average], offset: int, e: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values after each row (columns: ``specs``), the last of them, and the sums that seed those not begun yet.

    ``offset`` rows came before; ``e`` and ``total`` are the values and the sums up to there.
    """
    n, alpha = np.array([s.n for s in specs]), np.array([s.alpha for s in specs])
    out = np.full((len(x), len(specs)), np.nan)
    e, total = e.copy(), total.copy()
    for i, v in enumerate(x.tolist()):
        at = offset + i + 1
        if at <= n.max():
            total = np.where(at <= n, total + v, total)
            e = np.where(at == n, total / n, np.where(at > n, e + alpha * (v - e), np.nan))
        else:
            e = e + alpha * (v - e)
        out[i] = e
    return out, e, total


def averages(rows: DataFrame, order: str, specs: Iterable[Average], block: int = BLOCK) -> DataFrame:
    """``rows`` (symbol, ``order``, values) with one more column for each average, null until it has n values.

    ``order`` numbers a symbol's rows (gaps are allowed, ties are not). Rows without a value have no average and move none.
    Null symbols are one symbol. Results do not depend on ``block``; float ones up to rounding.
    """
    out = rows
    for value in dict.fromkeys(s.value for s in specs):
        own = [s for s in specs if s.value == value]
        got = _of_one(rows.select("symbol", order, value).where(F.col(value).isNotNull()), order, value, own, block)
        out = out.join(got.withColumnsRenamed({"symbol": "_symbol", order: "_order"}), F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col(order) == F.col("_order")), "left").drop("_symbol", "_order")
    return out


def _of_one(rows: DataFrame, order: str, value: str, specs: list[Average], size: int) -> DataFrame:
    floats, ints = [s for s in specs if s.kind != "ema_int"], [s for s in specs if s.kind == "ema_int"]
    rows = written(rows, "scan-rows")  # read three times below; what led to them is done once
    keyed = rows.select("symbol", F.expr(f"{order} div {size}").alias("block"), F.col(order).alias("at"), F.col(value).alias("x"))
    stats = keyed.groupBy("symbol", "block").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    before = Window.partitionBy("symbol").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("symbol")
    # One row a block. An integer average stays between the least and the largest value seen.
    stats = stats.select("symbol", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.min("least").over(every).alias("least"), F.max("most").over(every).alias("most"))
    stats = written(stats, "scan-blocks")
    same = lambda a, b: a["symbol"].eqNullSafe(b["symbol"]) & (a["block"] == b["block"])
    known = keyed.join(stats, same(keyed, stats)).select(keyed["symbol"], keyed["block"], "at", "x", "offset", "least", "most")

    def summary(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("at")
        offset, x = int(f["offset"].iloc[0]), f["x"].to_numpy()
        row = {"symbol": f["symbol"].iloc[0], "block": f["block"].iloc[0], "offset": offset, "n": len(f)}
        if floats:
            n = np.array([s.n for s in floats])
            scale = (1 - np.array([s.alpha for s in floats])) ** np.clip(np.minimum(len(f), offset + len(f) - n), 0, None)
            # From zero, or from the seed where it falls into this block: then nothing of the value before is left.
            _, e, total = float_run(x.astype(float), floats, offset, np.zeros(len(floats)), np.zeros(len(floats)))
            row |= {"scale": scale, "shift": np.nan_to_num(e), "total": total}
        maps = [int_map(x, s.n, int(f["least"].iloc[0]), int(f["most"].iloc[0])) if offset else (np.zeros(1, np.int64), int_run(x, s.n, None)[-1:]) for s in ints]
        row |= {"begins": [b.tolist() for b, _ in maps], "ends": [e.tolist() for _, e in maps]}
        return pd.DataFrame([row])

    parts = "scale array<double>, shift array<double>, total array<double>" if floats else ""
    cols = ", ".join(filter(None, ["symbol string, block bigint, offset bigint, n bigint", parts, "begins array<array<bigint>>, ends array<array<bigint>>"]))
    summed = written(known.groupBy("symbol", "block").applyInPandas(summary, cols), "scan-maps")

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        out, n = [], np.array([s.n for s in floats])
        e, total, whole = np.full(len(floats), np.nan), np.zeros(len(floats)), [None] * len(ints)
        for r in frame.sort_values("block").itertuples(index=False):
            out.append((r.symbol, r.block, r.offset, e.tolist(), total.tolist(), whole))
            if floats:
                begun, seeded = n <= r.offset, n <= r.offset + r.n
                # A seed that falls into the block lacks what earlier blocks summed: it counts by its weight after the seed.
                carried = total / n * np.asarray(r.scale)
                e = np.where(begun, np.asarray(r.scale) * np.nan_to_num(e) + np.asarray(r.shift), np.where(seeded, np.asarray(r.shift) + carried, np.nan))
                total = total + np.asarray(r.total)
            whole = [int(end[max(0, np.searchsorted(begin, w or 0, side="right") - 1)]) for begin, end, w in zip(r.begins, r.ends, whole)]
        return pd.DataFrame(out, columns=["symbol", "block", "offset", "e", "total", "whole"])

    starts = written(summed.groupBy("symbol").applyInPandas(compose, "symbol string, block bigint, offset bigint, e array<double>, total array<double>, whole array<bigint>"), "scan-starts")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("at")
        x, offset = f["x"].to_numpy(), int(f["offset"].iloc[0])
        out = pd.DataFrame({"symbol": f["symbol"], order: f["at"]})
        if floats:
            values, _, _ = float_run(x.astype(float), floats, offset, np.asarray(f["e"].iloc[0], float), np.asarray(f["total"].iloc[0], float))
            for k, s in enumerate(floats):
                out[s.name] = pd.Series(values[:, k], index=f.index).where(~np.isnan(values[:, k]), None).astype(object)
        for s, begin in zip(ints, f["whole"].iloc[0]):
            e = int_run(x, s.n, None if begin is None or not offset else int(begin))
            out[s.name] = pd.Series(e, index=f.index).astype(object).where(np.arange(offset + 1, offset + len(f) + 1) >= s.n, None)
        return out

    ready = keyed.join(starts, same(keyed, starts)).select(keyed["symbol"], keyed["block"], "at", "x", "offset", "e", "total", "whole")
    kinds = ", ".join([*(f"{s.name} double" for s in floats), *(f"{s.name} bigint" for s in ints)])
    return ready.groupBy("symbol", "block").applyInPandas(run, f"symbol string, {order} {rows.schema[order].dataType.simpleString()}, {kinds}")
