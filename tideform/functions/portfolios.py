"""Admission of trades in order, with what is open carried over days, and settlement; no task folds more than it must.

Admission depends on the past only through trades that are still open and the last bar used. Days that no offer reaches into
from before are therefore where a fold can begin anew: days between two such are one segment, segments run in parallel, and a
segment streams through its task in order. Running sums over days are carried likewise, from a table with one row a day.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideform.sources.written import written


def segments(offers: DataFrame) -> DataFrame:
    """``(session_day, segment)``: runs of days that an open trade, or a bar, may connect. One row a day is put in order."""
    days = offers.groupBy("session_day").agg(F.min("entry_ts_ns").alias("first"), F.max("entry_ts_ns").alias("last"), F.max("exit_ts_ns").alias("open_to"), F.max(F.col("bar_ms") * 1_000_000).alias("bar"))
    order = Window.orderBy("first", "session_day")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = (F.max("open_to").over(before) < F.col("first")) & (F.col("first") - F.max("last").over(before) >= F.greatest(F.max("bar").over(before), "bar"))
    days = days.withColumn("begins", F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0))
    return days.select("session_day", F.sum("begins").over(order).alias("segment"))


def allocate(offers: DataFrame, per_symbol: int = 3, per_day: int = 10) -> DataFrame:
    """Offers with ``reason``: empty if accepted, else OVERLAP, SAME_BAR or DAILY_LIMIT.

    ``offers``: symbol, session_day (of the entry), entry_ts_ns, exit_ts_ns, priority, offer_id, bar_ms, and further columns, which
    come back. They are looked at by entry, priority and identifier. One enters only after its symbol's open trade has ended, in a
    bar (of its own length) in which that symbol has not entered, and within both daily limits; it counts for its entry's day.
    """
    cut = written(segments(offers), "segments")
    rows = offers.join(cut, "session_day").repartition("segment").sortWithinPartitions("segment", "entry_ts_ns", "priority", "offer_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for f in frames:
            out = []
            for segment, symbol, day, entry, exit_, bar_ms in zip(*(f[c].tolist() for c in ("segment", "symbol", "session_day", "entry_ts_ns", "exit_ts_ns", "bar_ms"))):
                if segment != now:
                    now, busy, last, own, every = segment, {}, {}, {}, {}
                bar = bar_ms * 1_000_000
                if symbol in busy and entry <= busy[symbol]:
                    reason = "OVERLAP"
                elif symbol in last and last[symbol] // bar == entry // bar:
                    reason = "SAME_BAR"
                elif own.get((symbol, day), 0) >= per_symbol or every.get(day, 0) >= per_day:
                    reason = "DAILY_LIMIT"
                else:
                    reason, busy[symbol], last[symbol] = "", exit_, entry
                    own[symbol, day] = own.get((symbol, day), 0) + 1
                    every[day] = every.get(day, 0) + 1
                out.append(reason)
            yield f.drop(columns="segment").assign(reason=out)

    cols = [c for c in rows.columns if c != "segment"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in cols)
    return rows.mapInPandas(run, f"{kinds}, reason string")


def running(rows: DataFrame, keys: list[str], day: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``total`` and ``peak`` (at least nought) of the running sum of ``value``: within days, and days' sums carried."""
    rows = written(rows, "running")
    here = Window.partitionBy(*keys, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_run", F.sum(value).over(here))
    own = own.withColumn("_top", F.max("_run").over(here))
    days = own.groupBy(*keys, day).agg(F.sum(value).alias("_sum"), F.max("_run").alias("_high"))
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0), F.coalesce(F.max(F.col("_start") + F.col("_high")).over(before), F.lit(0))))
    out = own.join(days.select(*keys, day, "_start", "_peak"), [*keys, day])
    return out.withColumns({"total": F.col("_start") + F.col("_run"), "peak": F.greatest("_peak", F.col("_start") + F.col("_top"))}).drop("_run", "_top", "_start", "_peak")


def settle(allocated: DataFrame, capital: int) -> DataFrame:
    """One row: offers and each kind of rejection, and the account's end and its largest fall between settlements.

    Money is ``net_u`` times ``usd_micro_per_unit``; what settles at one time is one cash flow.
    """
    paid = allocated.where("reason = ''").groupBy("exit_ts_ns").agg(F.sum(F.col("net_u") * F.col("usd_micro_per_unit")).alias("cash"))
    paid = paid.withColumns({"account": F.lit(1), "day": F.expr("exit_ts_ns div 86400000000000")})
    flow = running(paid, ["account"], "day", ["exit_ts_ns"], "cash").agg(F.coalesce(F.max(F.col("peak") - F.col("total")), F.lit(0)).cast("bigint").alias("drawdown_micro"))
    kinds = {"accepted": "", "overlap": "OVERLAP", "same_bar": "SAME_BAR", "daily_limit": "DAILY_LIMIT"}
    counts = allocated.agg(
        F.count("*").alias("offered"), *(F.count_if(F.col("reason") == r).alias(n) for n, r in kinds.items()),
        (F.lit(capital) + F.coalesce(F.sum(F.when(F.col("reason") == "", F.col("net_u") * F.col("usd_micro_per_unit"))), F.lit(0))).cast("bigint").alias("final_micro"),
    )
    return counts.crossJoin(flow)  # one row each


def schedule(outcomes: DataFrame, per_day: int = 3) -> DataFrame:
    """Signals of a session in order, each with why it is no trade: PAST (before the last exit), SESSION (outside its hours), CAP,
    or what is wrong with its outcome, worked out beforehand (``state``: NO_ENTRY, GEOMETRY, UNRESOLVED); empty if it trades.

    ``outcomes``: symbol, session_day, intent_id, signal_seq, exit_seq, inside, state, r. All exits are within the session, so a
    symbol's sessions are independent and one is folded by itself.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["signal_seq", "intent_id"])
        busy, n, out = -1, 0, []
        for signal, end, inside, state in zip(f["signal_seq"], f["exit_seq"], f["inside"], f["state"]):
            reason = "PAST" if signal <= busy else "SESSION" if not inside else "CAP" if n >= per_day else state
            if not reason:
                n, busy = n + 1, end
            out.append(reason)
        return f[["symbol", "session_day", "intent_id", "signal_seq", "r"]].assign(reason=out)

    return outcomes.groupBy("symbol", "session_day").applyInPandas(run, "symbol string, session_day bigint, intent_id bigint, signal_seq bigint, r double, reason string")


REASONS = ("PAST", "SESSION", "CAP", "NO_ENTRY", "GEOMETRY", "UNRESOLVED")


def schedule_report(scheduled: DataFrame) -> DataFrame:
    """Per symbol: signals, trades, each reason's count, and sum, gains, losses and largest fall of R in order of the signals."""
    scheduled = written(scheduled, "scheduled")
    rows = running(scheduled.where("reason = ''"), ["symbol"], "session_day", ["signal_seq", "intent_id"], "r")
    sums = rows.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.round(F.sum("r"), 6).alias("total_r"), F.round(F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), 6).alias("gains_r"),
        F.round(F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0)), 6).alias("losses_r"), F.round(F.max(F.col("peak") - F.col("total")), 6).alias("drawdown_r"),
    )
    counts = scheduled.groupBy("symbol").agg(F.count("*").alias("signals"), *(F.count_if(F.col("reason") == r).alias(r.lower()) for r in REASONS))
    return counts.join(sums, "symbol", "left")
