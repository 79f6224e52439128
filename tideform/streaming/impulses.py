"""Impulse, pullback and confirmation on ticks, with scores: one machine for batches by days and for streams with state.

Two bars are kept: a fast one whose close can arm a side, and a slow one that gives the average range (Wilder, 14) and the
median spread of the bar before. A side waits for a pullback and for the price to come back near the impulse's close; it is
confirmed some seconds later, by the first tick that has a spread. A new day forgets what waits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tideform.functions.scans import Average, averages
from tideform.operators.indicators import IPS_WEIGHTS
from tideform.sources.written import written

DAY_MS = 86_400_000
RING = 64  # moves that the imbalance counts
# Least and most body in ranges, least efficiency, most distance of the close from the bar's end, pullback that
# readies, that still confirms, that ends; part of the body within which the price must come back; part of the range beyond
# the extreme where the stop stands.
BODY, EFFICIENCY, CLOSE_OFF, READY, CONFIRM, END, BACK, BUFFER = (0.35, 1.2), 0.6, 0.2, 0.15, 0.5, 0.6, 0.1, 0.03
OUT = "symbol string, entry_ms bigint, seq bigint, side int, score_v1 double, score_v2 double, eligible boolean"


@dataclass(frozen=True)
class Clock:
    """Lengths in milliseconds: fast and slow bars, how long an impulse may wait, and until it is confirmed."""

    fast: int = 300_000
    slow: int = 900_000
    expire: int = 1_200_000
    confirm: int = 10_000


def _unit(x: float) -> float:
    return min(1.0, max(0.0, x))


def score(side: dict, now: int, spread: int, p50: int, z: float) -> tuple[float, float]:
    """Scores in both weightings: displacement, efficiency, pullback, recovery, imbalance, spread."""
    depth = abs(side["close"] - side["extreme"])
    gone = depth / side["body"]
    out_s, back_s = (max((b - a) / 1000, 1e-6) for a, b in ((side["since"], side["extreme_at"]), (side["extreme_at"], side["back_at"])))
    back = abs(side["level"] - side["extreme"]) / back_s
    pullback = 0.0 if gone <= 0.15 or gone >= 0.5 else (gone - 0.15) / 0.15 if gone <= 0.3 else (0.5 - gone) / 0.2
    parts = (
        _unit((side["of_range"] - 0.35) / 0.55), _unit((side["efficiency"] - 0.6) / 0.35), pullback, _unit(back / (depth / out_s) / 2),
        _unit((side["sign"] * z + 1) / 2), _unit(1 - spread / (2 * p50)),
    )
    return tuple(sum(w * p for w, p in zip(IPS_WEIGHTS[v], parts)) for v in (1, 2))


class Machine:
    """Sides that wait, over ticks in order; ``state`` is plain data, so that it can be kept between batches."""

    def __init__(self, clock: Clock, state: dict | None = None) -> None:
        self.clock = clock
        self.state = state or {"day": None, "bar": None, "sides": {}}

    def step(self, ms: int, bid: int, ask: int, atr: float | None, p50: int, z: float) -> Iterator[tuple[int, float, float, bool]]:
        s, c = self.state, self.clock
        day, bucket = ms // DAY_MS, ms // c.fast
        if s["day"] != day:
            s["day"], s["sides"] = day, {}
        bar = s["bar"]
        if bar and bar[0] == bucket:
            s["bar"] = [bucket, bar[1], max(bar[2], bid), min(bar[3], bid), bid]
        else:
            if bar and bar[0] * c.fast // DAY_MS == day:
                self._arm(bar, ms, atr)
            s["bar"] = [bucket, bid, bid, bid, bid]
        spread = ask - bid
        for name in ("-1", "1"):
            x = s["sides"].get(name)
            if x and x["waits"] and ms >= x["confirm_at"] and spread > 0 and p50 > 0:
                del s["sides"][name]
                if READY <= abs(x["close"] - x["extreme"]) / x["body"] <= CONFIRM:
                    stop = x["extreme"] - x["sign"] * BUFFER * x["atr"]
                    yield x["sign"], *score(x, ms, spread, p50, z), x["sign"] * ((ask if x["sign"] == 1 else bid) - stop) > 0
        for name in ("-1", "1"):
            x = s["sides"].get(name)
            if x and not x["waits"]:
                self._follow(name, x, ms, bid)

    def _arm(self, bar: list, ms: int, atr: float | None) -> None:
        _, o, h, lo, c = bar
        body, height = abs(c - o), h - lo
        if not atr or atr <= 0 or not body or not height:
            return
        sign = 1 if c > o else -1
        if not BODY[0] <= body / atr <= BODY[1] or body / height < EFFICIENCY or (h - c if sign == 1 else c - lo) / height > CLOSE_OFF or str(sign) in self.state["sides"]:
            return
        self.state["sides"][str(sign)] = {
            "sign": sign, "since": ms, "until": ms + self.clock.expire, "close": c, "extreme": c, "extreme_at": ms, "body": body, "atr": atr, "of_range": body / atr,
            "efficiency": body / height, "level": c - sign * BACK * body, "ready": False, "waits": False,
        }

    def _follow(self, name: str, x: dict, ms: int, bid: int) -> None:
        if ms > x["until"]:
            del self.state["sides"][name]
            return
        if x["sign"] * (x["extreme"] - bid) > 0:
            x["extreme"], x["extreme_at"] = bid, ms
        gone = x["sign"] * (x["close"] - x["extreme"]) / x["body"]
        if gone > END:
            del self.state["sides"][name]
            return
        x["ready"] = x["ready"] or gone >= READY
        if x["ready"] and x["sign"] * (bid - x["level"]) >= 0:
            if gone > CONFIRM:
                del self.state["sides"][name]
            else:
                x |= {"waits": True, "back_at": ms, "confirm_at": ms + self.clock.confirm}


class Surroundings:
    """Average range, median spread of the slow bar before, and imbalance, tick by tick."""

    def __init__(self, clock: Clock, state: dict | None = None) -> None:
        self.clock = clock
        self.state = state or {"bar": None, "close": None, "n": 0, "atr": 0.0, "p50": 0, "spreads": {}, "ring": [], "mid": None}

    def step(self, ms: int, bid: int, ask: int) -> tuple[float | None, int, float]:
        s = self.state
        bucket = ms // self.clock.slow
        if s["bar"] and s["bar"][0] == bucket:
            s["bar"] = [bucket, max(s["bar"][1], bid), min(s["bar"][2], bid), bid]
        else:
            if s["bar"]:
                self._close()
            s["bar"], s["spreads"] = [bucket, bid, bid, bid], {}
        if ask > bid:
            k = str(min(ask - bid, 65_535))
            s["spreads"][k] = s["spreads"].get(k, 0) + 1
        if s["mid"] is not None and bid + ask != s["mid"]:
            s["ring"] = [*s["ring"], 1 if bid + ask > s["mid"] else -1][-RING:]
        s["mid"] = bid + ask
        return (s["atr"] if s["n"] >= 14 else None), s["p50"], sum(s["ring"]) / len(s["ring"]) if s["ring"] else 0.0

    def _close(self) -> None:
        s = self.state
        _, high, low, close = s["bar"]
        tr = high - low if s["close"] is None else max(high - low, abs(high - s["close"]), abs(low - s["close"]))
        s["n"] += 1
        s["atr"] = s["atr"] + tr / 14 if s["n"] <= 14 else (s["atr"] * 13 + tr) / 14
        s["close"] = close
        n, seen, middle = sum(s["spreads"].values()), 0, []
        for k in sorted(map(int, s["spreads"])):
            seen += s["spreads"][str(k)]
            middle += [k] * ((seen > (n - 1) // 2 and not middle) + (seen > n // 2 and len(middle) < 2))
            if len(middle) >= 2:
                break
        s["p50"] = sum(middle[:2]) // 2 if middle else 0


class _Stream(StatefulProcessor):
    def __init__(self, clock: Clock) -> None:
        self.clock = clock

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = json.loads(self.kept.get()[0]) if self.kept.exists() else {"seq": -1, "machine": None, "around": None}
        machine, around, last, out = Machine(self.clock, known["machine"]), Surroundings(self.clock, known["around"]), known["seq"], []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if r.seq <= last:  # a batch that is replayed changes nothing
                continue
            last, ms = int(r.seq), int(r.ts_ns) // 1_000_000
            if r.ask_u >= r.bid_u:
                atr, p50, z = around.step(ms, int(r.bid_u), int(r.ask_u))
                out += [(key[0], ms, last, *e) for e in machine.step(ms, int(r.bid_u), int(r.ask_u), atr, p50, z)]
        self.kept.update((json.dumps({"seq": last, "machine": machine.state, "around": around.state}),))
        if machine.state["sides"]:
            self.handle.registerTimer((machine.state["day"] + 1) * DAY_MS)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The day of what waits is over for good: forget it, without waiting for the symbol's next tick."""
        if self.kept.exists():
            known = json.loads(self.kept.get()[0])
            if (known["machine"]["day"] + 1) * DAY_MS <= timerValues.getCurrentWatermarkInMs():
                known["machine"]["sides"] = {}
                self.kept.update((json.dumps(known),))
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_impulses(ticks: DataFrame, clock: Clock = Clock(), late: str = "1 day") -> DataFrame:
    """Streaming (symbol, seq, ts_ns, bid_u, ask_u) to scored impulses, each once, however batches are cut or replayed.

    Ticks come in order per symbol over the batches, symbols no more than ``late`` apart. Needs a state store for several
    column families (RocksDB).
    """
    timed = ticks.withColumn("at", F.timestamp_micros(F.expr("ts_ns div 1000"))).withWatermark("at", late)
    return timed.groupBy("symbol").transformWithStateInPandas(_Stream(clock), OUT, "Append", "EventTime")


def impulses(ticks: DataFrame, clock: Clock = Clock()) -> DataFrame:
    """The same over a whole tape, days in parallel: slow bars, imbalance and its carry over days are worked out beforehand.

    ``ticks``: symbol, seq, ts_ns, session_day, bid_u, ask_u; crossed quotes are skipped. Null symbols have no impulses.
    """
    t = written(ticks.where("symbol is not null and ask_u >= bid_u").selectExpr("symbol", "seq", "ts_ns div 1000000 as ms", "bid_u", "ask_u"), "impulse-ticks")
    t = t.withColumns({"slow": F.expr(f"ms div {clock.slow}"), "day": F.expr(f"ms div {DAY_MS}")})
    bars = t.groupBy("symbol", "slow").agg(F.max("bid_u").alias("h"), F.min("bid_u").alias("l"), F.max_by("bid_u", "seq").alias("c"))
    # The lower and the upper middle of the spreads, exactly.
    wide = t.where("ask_u > bid_u").groupBy("symbol", "slow", F.expr("least(ask_u - bid_u, 65535)").alias("w")).count()
    upto = Window.partitionBy("symbol", "slow").orderBy("w")
    wide = wide.withColumns({"seen": F.sum("count").over(upto), "n": F.sum("count").over(Window.partitionBy("symbol", "slow"))})
    middle = wide.groupBy("symbol", "slow").agg(F.min(F.expr("case when seen > (n - 1) div 2 then w end")).alias("a"), F.min(F.expr("case when seen > n div 2 then w end")).alias("b"))
    order = Window.partitionBy("symbol").orderBy("slow")
    bars = bars.join(middle, ["symbol", "slow"], "left").withColumns({"bar": F.row_number().over(order).cast("bigint"), "before": F.lag("c").over(order)})
    bars = bars.selectExpr("symbol", "slow", "bar", "coalesce((a + b) div 2, 0) as p50", "cast(case when before is null then h - l else greatest(h - l, abs(h - before), abs(l - before)) end as bigint) as tr")
    bars = averages(written(bars, "slow-bars"), "bar", [Average("atr", "tr", "wilder", 14)])
    known = bars.select("symbol", "slow", F.lag("atr").over(order).alias("atr"), F.coalesce(F.lag("p50").over(order), F.lit(0)).alias("p50"))

    # The last moves of a day, and the middle it ends with, are what the next day begins with.
    by_day = Window.partitionBy("symbol", "day").orderBy("seq")
    mids = t.select("symbol", "day", "seq", (F.col("bid_u") + F.col("ask_u")).alias("mid"))
    ends = mids.groupBy("symbol", "day").agg(F.max_by("mid", "seq").alias("end"))
    days = Window.partitionBy("symbol").orderBy("day")
    ends = written(ends.withColumn("start", F.lag("end").over(days)), "day-ends")
    signs = mids.join(ends.select("symbol", "day", "start"), ["symbol", "day"]).withColumn("prior", F.coalesce(F.lag("mid").over(by_day), "start"))
    signs = signs.where("mid <> prior").select("symbol", "day", "seq", F.when(F.expr("mid > prior"), 1).otherwise(-1).alias("sign"))
    tail = signs.withColumn("back", F.row_number().over(Window.partitionBy("symbol", "day").orderBy(F.desc("seq")))).where(f"back <= {RING}")
    tail = tail.groupBy("symbol", "day").agg(F.expr("transform(array_sort(collect_list(struct(seq, sign))), x -> x.sign)").alias("tail"))
    tail = ends.select("symbol", "day", "start").join(tail, ["symbol", "day"], "left")

    def carry(frame: pd.DataFrame) -> pd.DataFrame:
        out, ring = [], []
        for r in frame.sort_values("day").itertuples(index=False):  # one row a day
            out.append((r.symbol, r.day, r.start, ring))
            ring = [*ring, *(r.tail if r.tail is not None else [])][-RING:]
        return pd.DataFrame(out, columns=["symbol", "day", "start", "ring"])

    rings = tail.groupBy("symbol").applyInPandas(carry, "symbol string, day bigint, start bigint, ring array<int>")
    ready = t.join(known, ["symbol", "slow"]).join(rings, ["symbol", "day"])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("seq")
        machine, out = Machine(clock), []
        ring, mid = list(f["ring"].iloc[0]), f["start"].iloc[0]
        mid = None if pd.isna(mid) else mid
        for seq, ms, bid, ask, atr, p50 in zip(*(f[c].tolist() for c in ("seq", "ms", "bid_u", "ask_u", "atr", "p50"))):
            if mid is not None and bid + ask != mid:
                ring = [*ring, 1 if bid + ask > mid else -1][-RING:]
            mid = bid + ask
            out += [(f["symbol"].iloc[0], ms, seq, *e) for e in machine.step(ms, bid, ask, None if pd.isna(atr) else atr, p50, sum(ring) / len(ring) if ring else 0.0)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    return ready.groupBy("symbol", "day").applyInPandas(run, OUT)
