"""Retellings of a ledger that each miss some trades, drawn by digests."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 64  # of a digest: one retelling each
SYMBOLS = 256  # whose sums a task holds at once


def nets(trades: DataFrame, blocks: int) -> DataFrame:
    """``(symbol, rep, net)``: what ``trades`` (symbol, intent_id, net_u) add up to in each of 64 retellings a block.

    The k-th retelling of a block misses a trade where the k-th digit of the digest of symbol, trade and block is 0. A task sums
    its trades before anything is exchanged; no row is made for a trade and a block.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def told() -> pd.DataFrame:
            rep = np.arange(blocks * DIGITS)
            return pd.concat([pd.DataFrame({"symbol": s, "rep": rep, "net": sums.ravel()}) for s, sums in held.items()])

        for frame in frames:
            for symbol, part in frame.groupby("symbol", sort=False):
                if symbol not in held:
                    if len(held) == SYMBOLS:
                        yield told()
                        held.clear()
                    held[symbol] = np.zeros((blocks, DIGITS), np.int64)
                net, heads = part["net_u"].to_numpy(np.int64), [f"{symbol}:{i}:" for i in part["intent_id"].tolist()]
                for block in range(blocks):
                    drawn = np.frombuffer(b"".join([sha256(f"{h}{block}".encode()).digest() for h in heads]), np.uint8).reshape(-1, DIGITS // 2)
                    held[symbol][block, 0::2] += net @ (drawn > 15).astype(np.int64)
                    held[symbol][block, 1::2] += net @ (drawn & 15 > 0).astype(np.int64)
        if held:
            yield told()

    # Few bytes but much work a row: dealt over all cores, however small the table.
    spread = trades.select("symbol", "intent_id", "net_u").repartition(4 * trades.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(run, "symbol string, rep bigint, net bigint").groupBy("symbol", "rep").agg(F.sum("net").alias("net"))


def missed(trades: DataFrame, blocks: int) -> DataFrame:
    """Worst, best and quantiles of the retellings of each symbol."""
    return nets(trades, blocks).groupBy("symbol").agg(
        F.count("*").alias("reps"), F.min("net").alias("worst"), F.expr("percentile(net, 0.05D)").alias("q05"), F.expr("percentile(net, 0.5D)").alias("q50"), F.max("net").alias("best"), F.count_if(F.col("net") <= 0).alias("not_positive"))
