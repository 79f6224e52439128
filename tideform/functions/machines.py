"""Candidates on every record of a session: orders that wait, entries, stops that move, targets, the close; sessions in parallel.

A candidate forgets everything at a session's end, so a symbol's day is folded by itself. Between events nothing changes: the
fold goes from one signal to the next, and a trade's whole path, with the stop that each record leaves for the one after, is
worked out at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

OUT = "symbol string, mode string, side int, session_day bigint, signal_seq bigint, entry_seq bigint, entry_u bigint, exit_seq bigint, exit_u bigint, reason string, mae_u bigint, mfe_u bigint"


@dataclass(frozen=True)
class Rules:
    """Distances in units of price; ``even_ppm`` is the part of the target (in millionths) whose gain moves the stop to the entry plus
    ``even_u``; ``trail_u`` keeps it that far from the best price; nought switches either off."""

    expiry: int = 50
    per_day: int = 3
    stop_u: int = 1500
    target_u: int = 2500
    even_ppm: int = 0
    even_u: int = 0
    trail_u: int = 0
    slip_u: int = 0
    bar_ms: int = 3_600_000


def path(gain: np.ndarray, rules: Rules) -> tuple[int | None, bool]:
    """First quote at which a trade ends by its stop (True) or target, from its gains quote by quote; None if it does not.

    A quote is held against the stop that the quotes before it left; where it reaches both, the stop counts.
    """
    before = np.concatenate([[0], np.maximum.accumulate(gain)[:-1]])
    stop = np.full(len(gain), -rules.stop_u, np.int64)
    if rules.even_ppm:
        moved = (before > 0) & (before * 1_000_000 >= rules.target_u * rules.even_ppm)
        stop = np.where(moved, np.maximum(stop, rules.even_u), stop)
    if rules.trail_u and len(gain):
        trailed = np.maximum(before, 0) - rules.trail_u
        trailed[0] = -rules.stop_u  # the first quote meets the stop it was entered with
        stop = np.maximum(stop, trailed)
    hit = np.flatnonzero((gain <= stop) | (gain >= rules.target_u))
    return (int(hit[0]), bool(gain[hit[0]] <= stop[hit[0]])) if len(hit) else (None, False)


def session(seq: np.ndarray, ms: np.ndarray, bid: np.ndarray, ask: np.ndarray, signals: np.ndarray, side: int, rules: Rules) -> list[tuple]:
    """Trades of one candidate in one session: (signal_seq, entry_seq, entry, exit_seq, exit, reason, mae, mfe).

    ``signals`` are the records at which it is triggered. A signal is dropped while another waits or a trade is open, beyond the
    day's limit, in the bar of the last entry, and on the session's last record. An order waits for ``expiry`` records.
    """
    out, live = [], np.flatnonzero(ask > bid)
    bar, close = ms // rules.bar_ms, len(seq) - 1
    free, last_bar = -1, None  # the record up to which signals are dropped, and the bar of the last entry
    for at in np.searchsorted(seq, signals).tolist():
        if at < free or at >= close or len(out) >= rules.per_day or last_bar is not None and bar[at] == last_bar:
            continue
        # Entered at the first executable record after the signal, in another bar than the last entry, before the close.
        some = live[np.searchsorted(live, at + 1) : np.searchsorted(live, min(at + rules.expiry, close - 1) + 1)]
        some = some[bar[some] != last_bar] if last_bar is not None else some
        if not len(some):
            free = min(at + rules.expiry + 1, close)  # the order is given up on the record after its last one
            continue
        enter = int(some[0])
        price = int(ask[enter] + rules.slip_u if side == 1 else bid[enter] - rules.slip_u)
        later = live[np.searchsorted(live, enter + 1) :]
        gain = side * ((bid if side == 1 else ask)[later].astype(np.int64) - price)
        end, stopped = path(gain, rules)
        last_bar = bar[enter]
        if end is None and not len(later):
            out.append((int(seq[at]), int(seq[enter]), price, None, None, "UNRESOLVED", 0, 0))
            free = close
            continue
        reason = "CLOSE" if end is None else "STOP" if stopped else "TARGET"
        end = len(later) - 1 if end is None else end
        leave = int(later[end])
        held = gain[: end + 1]
        out.append((int(seq[at]), int(seq[enter]), price, int(seq[leave]), int((bid if side == 1 else ask)[leave]), reason, int(min(0, held.min())), int(max(0, held.max()))))
        free = close if reason == "CLOSE" else leave
    return out


def trades(ticks: DataFrame, signals: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades of all candidates (mode, side) of ``signals`` (symbol, session_day, mode, side, signal_seq) over ``ticks``.

    A trade without an executable record after its entry comes back as UNRESOLVED, without an exit.
    """

    def run(key: tuple, t: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(t) and len(s):
            t = t.sort_values("seq")
            arrays = [t["seq"].to_numpy(), t["ts_ns"].to_numpy() // 1_000_000, t["bid_u"].to_numpy(), t["ask_u"].to_numpy()]
            for (mode, side), own in s.groupby(["mode", "side"]):
                out += [(key[0], mode, side, key[1], *row) for row in session(*arrays, np.sort(own["signal_seq"].to_numpy()), int(side), rules)]
        f = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        return f.astype({"exit_seq": "Int64", "exit_u": "Int64"})

    keys = ["symbol", "session_day"]
    return ticks.select(*keys, "seq", "ts_ns", "bid_u", "ask_u").groupBy(*keys).cogroup(signals.groupBy(*keys)).applyInPandas(run, OUT)
