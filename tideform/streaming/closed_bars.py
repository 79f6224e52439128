"""Bars from a stream of ticks: a bar leaves when the first tick of a later bucket of its symbol arrives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "symbol string, bucket bigint, open_u bigint, high_u bigint, low_u bigint, close_u bigint, n_ticks bigint"
STATE = "bucket bigint, open_u bigint, high_u bigint, low_u bigint, close_u bigint, n_ticks bigint, seq bigint"


def closed_bars(ticks: DataFrame, period_ms: int = 3_600_000) -> DataFrame:
    """Streaming (symbol, seq, ts_ns, bid_u) to closed bars.

    State is one open bar per symbol. Ticks come in order per symbol over the batches; a sequence number that was seen
    already is skipped, so a replayed batch changes nothing. The open bar never leaves by the end of the input.
    """
    width = period_ms * 1_000_000

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, ts, bid in zip(rows["seq"].tolist(), rows["ts_ns"].tolist(), rows["bid_u"].tolist()):
            if now and seq <= now[6]:
                continue
            bucket = ts // width
            if now and bucket == now[0]:
                now = [bucket, now[1], max(now[2], bid), min(now[3], bid), bid, now[5] + 1, seq]
            else:
                if now:
                    out.append((key[0], *now[:6]))
                now = [bucket, bid, bid, bid, bid, 1, seq]
        if now:
            state.update(tuple(now))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
