"""Order statistics over long moving windows, at a cost that does not depend on their length.

The values of a block of bars are written once as a wavelet matrix: for each bit of a value's rank, from the highest, how many
zeros stand before each position. The k-th smallest of any window is then found bit by bit, for all bars, lookbacks and
quantiles of the block at once. Blocks begin with the bars that their windows reach back to.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 65_536


class Wavelet:
    """The k-th smallest in any range of a sequence."""

    def __init__(self, values: np.ndarray) -> None:
        self.sorted, rank = np.unique(values, return_inverse=True)
        self.bits = max(1, int(len(self.sorted) - 1).bit_length())
        self.zeros, self.split = [], []
        for b in range(self.bits - 1, -1, -1):
            one = (rank >> b) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            self.split.append(int((~one).sum()))
            rank = np.concatenate([rank[~one], rank[one]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Values of rank ``k`` (from 1) among positions ``low`` to before ``high``; all three are arrays."""
        k, rank = k - 1, np.zeros(len(k), np.int64)
        for zeros, split in zip(self.zeros, self.split):
            at, to = zeros[low], zeros[high]
            right = k >= to - at
            k = np.where(right, k - (to - at), k)
            low, high = np.where(right, split + low - at, at), np.where(right, split + high - to, to)
            rank = 2 * rank + right
        return self.sorted[rank]


def nearest_rank(length: int, part: int, of: int) -> int:
    """Smallest rank that ``part / of`` of so many values do not exceed, in whole numbers."""
    return (part * length + of - 1) // of


def rolling(bars: DataFrame, value: str, lookbacks: tuple[int, ...], quantiles: dict[str, tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """Nearest-rank quantiles of the values of bars t - lookback - 1 to t - 2, beside the value of t - 1.

    ``bars`` (symbol, bar, value) number a symbol's bars without gaps. Returns ``(symbol, bar, lookback, reference,
    *quantiles)`` for every bar and lookback whose window and reference have all their values; null values leave theirs out.
    """
    reach = max(lookbacks) + 2
    size = max(block, reach)
    kind = bars.schema[value].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bar")
        own, bar, x = int(f["block"].iloc[0]), f["bar"].to_numpy(), f["v"]
        known = x.notna().to_numpy()
        values = x[known].to_numpy()
        wave = Wavelet(values) if len(values) else None
        count = np.concatenate([[0], np.cumsum(known)])  # positions among the known values
        t = np.flatnonzero(bar // size == own)
        parts = []
        for length in lookbacks:
            at = t[t >= length + 1]
            at = at[known[at - 1] & (count[at - 1] - count[at - 1 - length] == length)]
            if wave is None or not len(at):
                continue
            cols = {"symbol": f["symbol"].iloc[0], "bar": bar[at], "lookback": length, "reference": values[count[at - 1]]}
            for name, (part, of) in quantiles.items():
                cols[name] = wave.kth(count[at - 1 - length], count[at - 1], np.full(len(at), nearest_rank(length, part, of)))
            parts.append(pd.DataFrame(cols))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["symbol", "bar", "lookback", "reference", *quantiles])

    rows = bars.select("symbol", "bar", F.col(value).alias("v"))
    rows = rows.withColumn("block", F.explode(F.array_distinct(F.array(F.expr(f"bar div {size}"), F.expr(f"(bar + {reach}) div {size}")))))
    out = ", ".join(f"{n} {kind}" for n in ("reference", *quantiles))
    return rows.groupBy("symbol", "block").applyInPandas(run, f"symbol string, bar bigint, lookback int, {out}")
