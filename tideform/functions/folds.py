"""Recurrences that no window expresses: one ordered pass per symbol, in Arrow batches, symbols in parallel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ema_int(x: np.ndarray, n: int) -> list[int]:
    """Integer EMA: starts at the first value; each step adds 2 * (x - e) / (n + 1) cut towards zero."""
    out, e = [], None
    for v in x.tolist():
        if e is None:
            e = v
        else:
            step = 2 * (v - e)
            e += abs(step) // (n + 1) * (1 if step >= 0 else -1)
        out.append(e)
    return out


def smoothed(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """Exponential smoothing that starts from the mean of the first n values; missing before that."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        e = out[n - 1] = float(np.mean(x[:n]))
        for i in range(n, len(x)):
            e = out[i] = e + alpha * (x[i] - e)
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smoothed(x, n, 1 / n)


def rsi(close: np.ndarray, n: int = 14) -> np.ndarray:
    """Relative strength; 100 without losses, 0 without gains, 50 without either."""
    step = np.diff(close.astype(float))
    up, down = wilder(np.maximum(step, 0), n), wilder(np.maximum(-step, 0), n)
    both = up + down
    out = np.where(both > 0, 100 * up / np.where(both > 0, both, 1), 50.0)
    return np.concatenate([[np.nan], np.where(np.isnan(up), np.nan, out)])[: len(close)]


def adx(high: np.ndarray, low: np.ndarray, close: np.ndarray, n: int = 14) -> np.ndarray:
    """Directional index: Wilder means of directional moves over true range, smoothed once more.

    The first bar moves nowhere and its range is its height, so values begin at bar 2 n - 1.
    """
    h, l, c = (v.astype(float) for v in (high, low, close))
    up, down = np.diff(h, prepend=h[:1]), -np.diff(l, prepend=l[:1])
    before = np.concatenate([c[:1], c[:-1]])
    tr = np.maximum(h - l, np.maximum(np.abs(h - before), np.abs(l - before)))
    tr[:1] = (h - l)[:1]
    a = wilder(tr, n)
    p, m = wilder(np.where((up > down) & (up > 0), up, 0.0), n), wilder(np.where((down > up) & (down > 0), down, 0.0), n)
    moved = a > 0  # false where missing
    pi, mi = (np.where(moved, 100 * x / np.where(moved, a, 1), 0.0) for x in (p, m))
    both = pi + mi
    dx = np.where(both > 0, 100 * np.abs(pi - mi) / np.where(both > 0, both, 1), 0.0)
    return np.concatenate([np.full(min(n - 1, len(c)), np.nan), wilder(dx[n - 1 :], n)])


EMAS = (8, 20, 35)


def indicator_folds(bars: DataFrame) -> DataFrame:
    """EMA, ATR, RSI and ADX columns per symbol over numbered bars with true range."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bar")
        close = f["close_u"].to_numpy()
        cols = {f"ema{n}": ema(close, n) for n in EMAS} | {
            "atr14": wilder(f["tr"].to_numpy().astype(float), 14), "rsi14": rsi(close), "adx14": adx(f["high_u"].to_numpy(), f["low_u"].to_numpy(), close),
        }
        out = pd.DataFrame({"symbol": f["symbol"].to_numpy(), "bar": f["bar"].to_numpy(), "close_u": close, "ema_int5": ema_int(close, 5)})
        for k, v in cols.items():
            out[k] = pd.Series(v).where(~np.isnan(v), None).astype(object)
        return out

    doubles = ", ".join(f"{c} double" for c in (*(f"ema{n}" for n in EMAS), "atr14", "rsi14", "adx14"))
    return bars.groupBy("symbol").applyInPandas(run, f"symbol string, bar bigint, close_u bigint, ema_int5 bigint, {doubles}")


#: What the gates read of a bar beside the one before it.
BEFORE = [f"lag(ema{n}) over (partition by symbol order by bar) as before{n}" for n in EMAS]


def gates(folded: DataFrame, lookback: int = 5, adx_least: float = 25, slope_least: float = 0.1) -> DataFrame:
    """Gates by side: order of the three averages (with close beyond the fast one, with all sloping), strength, slope of the
    middle average against the range, and a cross of fast over middle within ``lookback`` bars. Missing input closes a gate."""
    f = folded.selectExpr("*", *BEFORE)
    f = f.selectExpr("*", "ema8 > ema20 and ema20 > ema35 as above", "ema8 < ema20 and ema20 < ema35 as below", "case when atr14 > 0 then (ema20 - before20) / atr14 end as slope",
        "case when ema8 > ema20 and before8 <= before20 then bar end as crossed_up", "case when ema8 < ema20 and before8 >= before20 then bar end as crossed_down")
    last = f"over (partition by symbol order by bar rows between {lookback - 1} preceding and current row)"
    shut = {
        "up": "above", "down": "below", "price_up": "above and close_u > ema8", "price_down": "below and close_u < ema8",
        "slope_up": "above and ema8 > before8 and ema20 > before20 and ema35 > before35", "slope_down": "below and ema8 < before8 and ema20 < before20 and ema35 < before35",
        "strong": f"adx14 >= {adx_least}", "rising": f"slope >= {slope_least}", "falling": f"slope <= -{slope_least}", "momentum_up": "rsi14 >= 55", "momentum_down": "rsi14 <= 45",
        "recent_up": f"max(crossed_up) {last} is not null", "recent_down": f"max(crossed_down) {last} is not null",
    }
    return f.selectExpr("symbol", "bar", *(f"coalesce({e}, false) as {n}" for n, e in shut.items()))


def greedy(trades: DataFrame) -> DataFrame:
    """Trades in entry order, each accepted if it enters after the last accepted exit; the others carry a reason. Trades that
    have a session end within it, so a symbol's sessions are independent."""
    by = [c for c in ("symbol", "session_day") if c in trades.columns]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["entry_seq", "intent_id"])
        busy, ok = -1, []
        for a, b in zip(f["entry_seq"], f["exit_seq"]):
            ok.append(a > busy)
            if ok[-1]:
                busy = b
        return pd.DataFrame({"symbol": f["symbol"], "intent_id": f["intent_id"], "accepted": ok, "reason": ["" if x else "OVERLAP" for x in ok]})

    return trades.groupBy(*by).applyInPandas(run, "symbol string, intent_id bigint, accepted boolean, reason string")


def refractory(events: DataFrame, rest: int) -> DataFrame:
    """Events of a (symbol, threshold, side) more than ``rest`` bars after the last one accepted."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("bar")
        last, ok = None, []
        for b in f["bar"]:
            ok.append(last is None or b - last > rest)
            last = b if ok[-1] else last
        return f[ok]

    return events.groupBy("symbol", "threshold", "side").applyInPandas(run, events.schema)


RESAMPLES = 500  # of a symbol, that one task draws at once


def _stream(seed: int, kind: int, block: int, n: int) -> np.random.Generator:
    """Generator of one block of resamples: counter-based, so that blocks are independent wherever they run."""
    return np.random.Generator(np.random.Philox(key=[seed, (kind << 56) + (block << 32) + n]))


def _resampled(daily: DataFrame, reps: int, run, schema: str) -> DataFrame:
    """``run`` (frame in order, block, number of resamples) for each symbol and block; a symbol's days go to every block."""
    blocks = daily.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // RESAMPLES) - 1))))

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        return run(frame.sort_values(frame.columns[1]), block, min(RESAMPLES, reps - block * RESAMPLES))

    return blocks.groupBy("symbol", "block").applyInPandas(part, schema)


def block_bootstrap(daily: DataFrame, reps: int = 20_000, block: int = 5, seed: int = 76) -> DataFrame:
    """Circular block bootstrap of a symbol's daily results (symbol, d, r): share of resamples whose mean is not above zero, 5 %
    quantiles of mean and profit factor (null where more than that share of resamples has no loss), 95 % quantile of the
    drawdown. Blocks of resamples are drawn in parallel; Spark takes the quantiles."""

    def run(f: pd.DataFrame, k: int, size: int) -> pd.DataFrame:
        r, n = f["r"].to_numpy(), len(f)
        start = _stream(seed, 1, k, n).integers(0, n, (size, -(-n // block)))
        x = r[((start[:, :, None] + np.arange(block)) % n).reshape(size, -1)[:, :n]]
        total = np.concatenate([np.zeros((size, 1)), x.cumsum(1)], 1)
        lost = -np.minimum(x, 0).sum(1)
        factor = np.where(lost > 0, np.maximum(x, 0).sum(1) / np.where(lost > 0, lost, 1), np.inf)
        return pd.DataFrame({"symbol": f["symbol"].iloc[0], "mean": x.mean(1), "factor": factor, "fall": (np.maximum.accumulate(total, 1) - total).max(1)})

    drawn = _resampled(daily.select("symbol", "d", "r"), reps, run, "symbol string, mean double, factor double, fall double")
    out = drawn.groupBy("symbol").agg(
        F.avg(F.when(F.col("mean") <= 0, 1.0).otherwise(0.0)).alias("p_not_positive"), F.percentile("mean", 0.05).alias("q05"),
        F.expr("percentile_disc(0.05) within group (order by factor)").alias("factor_q05"), F.percentile("fall", 0.95).alias("drawdown_q95"),
    )
    return out.withColumn("factor_q05", F.when(F.col("factor_q05") < float("inf"), F.col("factor_q05")))


def year_bootstrap(blocks: DataFrame, reps: int = 10_000, seed: int = 76) -> DataFrame:
    """Resamples of a symbol's yearly totals (symbol, fold, r): how many years, share of sums not above zero, 5 % and 50 % quantiles."""

    def run(f: pd.DataFrame, k: int, size: int) -> pd.DataFrame:
        r = f["r"].to_numpy()
        return pd.DataFrame({"symbol": f["symbol"].iloc[0], "years": len(r), "total": r[_stream(seed, 2, k, len(r)).integers(0, len(r), (size, len(r)))].sum(1)})

    drawn = _resampled(blocks.select("symbol", "fold", "r"), reps, run, "symbol string, years bigint, total bigint")
    return drawn.groupBy("symbol").agg(F.max("years").alias("years"), F.avg(F.when(F.col("total") <= 0, 1.0).otherwise(0.0)).alias("p_not_positive"), F.percentile("total", 0.05).alias("q05"), F.percentile("total", 0.5).alias("q50"))


REARM, RETEST = ("return", "replaced", "once"), ("off", "touch", "close")


def retests(crosses: DataFrame, window: int = 5) -> DataFrame:
    """Crosses of levels that become signals, under three rules of rearming and three of retesting.

    A cross signals at once, after a touch and reclaim, or after a close reclaim, found within ``window`` bars; one that waits
    in vain blocks later ones until its end (replacement, a cross of the other side, the window). A level that has signalled
    signals again after price returned inside it or it was replaced (``return``), or never (``replaced``, ``once``).
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["bar", "level_id"])
        rows = f[["bar", "level_id", "until_bar", "opposite_bar", "touch_bar", "close_bar", "return_bar", "return_touch", "return_close"]].astype("float64").to_numpy()
        out = []
        for rearm in REARM:
            for k, retest in enumerate(RETEST):
                used, allowed, blocked = None, -math.inf, -math.inf
                for bar, level, until, opposite, touch, close, *back in rows.tolist():
                    if bar < blocked or level == used and (rearm != "return" or bar < allowed):
                        continue
                    final = (bar, touch, close)[k]
                    if math.isnan(final):
                        blocked = min(x for x in (until, opposite, bar + window) if not math.isnan(x))
                        continue
                    blocked, used = -math.inf, level
                    allowed = min([x for x in (back[k], until) if not math.isnan(x)], default=math.inf)
                    out.append((rearm, retest, int(level), int(bar), int(final)))
        got = pd.DataFrame(out, columns=["rearm", "retest", "level_id", "bar", "signal_bar"])
        got.insert(0, "symbol", frame["symbol"].iloc[0])
        got.insert(1, "side", frame["side"].iloc[0])
        return got

    return crosses.groupBy("symbol", "side").applyInPandas(run, "symbol string, side int, rearm string, retest string, level_id bigint, bar bigint, signal_bar bigint")


def schedule(outcomes: DataFrame, per_day: int = 3, by: tuple[str, ...] = ("symbol", "session_day")) -> DataFrame:
    """Outcomes worked out beforehand, admitted in entry order within a symbol's session: no overlap, ``per_day`` at most.
    Sessions are independent. Every offer comes back with its reason."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values(["entry_seq", "intent_id"])
        busy, n, out = -1, 0, []
        for a, b in zip(f["entry_seq"], f["exit_seq"]):
            reason = "OVERLAP" if a <= busy else "DAILY_LIMIT" if n >= per_day else ""
            out.append(reason)
            if not reason:
                busy, n = b, n + 1
        return f[[*by, "intent_id"]].assign(accepted=[not x for x in out], reason=out)

    kinds = ", ".join(f"{c} {outcomes.schema[c].dataType.simpleString()}" for c in by)
    return outcomes.groupBy(*by).applyInPandas(run, f"{kinds}, intent_id bigint, accepted boolean, reason string")


def xorshift_bits(n: int, seed: int = 76) -> np.ndarray:
    """Lowest bits of a 64-bit xorshift* generator's outputs."""
    x, out = seed or 1, np.empty(n, bool)
    for i in range(n):
        x ^= x >> 12
        x ^= (x << 25) & (2**64 - 1)
        x ^= x >> 27
        out[i] = x * 0x2545F4914F6CDD1D & 1
    return out


def sign_flip(blocks: DataFrame, reps: int = 999, seed: int = 76) -> DataFrame:
    """Chance that randomly signed yearly totals sum to at least what a symbol's do, (hits + 1) / (reps + 1); 1 where that sum
    is not above zero. Every symbol reads the same bits, drawn once: the years of a repetition after those before it."""
    years = blocks.groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    bits = blocks.sparkSession.sparkContext.broadcast(np.packbits(xorshift_bits(reps * years, seed)))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.sort_values("fold")["r"].to_numpy(np.int64)
        plus = np.unpackbits(bits.value)[: reps * len(r)].reshape(reps, len(r)).astype(bool)
        hits = int((np.where(plus, r, -r).sum(1) >= r.sum()).sum())
        return pd.DataFrame({"symbol": [frame["symbol"].iloc[0]], "blocks": [len(r)], "p": [(hits + 1) / (reps + 1) if r.sum() > 0 else 1.0]})

    return blocks.groupBy("symbol").applyInPandas(run, "symbol string, blocks bigint, p double")


def impulses(bars: DataFrame, expire: int = 20) -> DataFrame:
    """Impulse, pullback, confirmation on bars, a side's apart from the other's.

    A bar whose body is 0.35 to 1.2 ranges, fills six tenths of its height and closes in its last fifth arms its side. A
    retracement from its close of 0.15 of the body or more readies; a close back within a tenth of the body then confirms
    at the next bar, if no more than half was given up. More than 0.6, or ``expire`` bars, ends it. ``bars``: symbol, bar,
    bucket, open_u, high_u, low_u, close_u, atr14, up_share, spread, spread_p50.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        f = frame.sort_values("bar")
        rows = f[["bar", "bucket", "open_u", "high_u", "low_u", "close_u", "atr14", "up_share", "spread", "spread_p50"]].astype("float64").to_numpy().tolist()
        for side in (1, -1):
            now = wait = None
            for bar, at, o, h, lo, c, atr, ups, spread, p50 in rows:
                if wait:
                    start, body, begun, base, far, far_at, back, back_at, of_atr, of_range = wait
                    out.append((side, int(start), int(bar), of_atr, of_range, abs(base - far) / body, abs(base - far), (far_at - begun) * 3600.0,
                                abs(back - far), (back_at - far_at) * 3600.0, ups if side == 1 else 1 - ups, spread, p50))
                    wait = None
                if now and bar - now[0] > expire:
                    now = None
                if now:
                    start, body, begun, base, far, far_at, of_atr, of_range = now
                    low = lo if side == 1 else h
                    if side * (low - far) < 0:
                        far, far_at = low, at
                    gone, back = side * (base - far) / body, base - side * 0.1 * body
                    now = None if gone > 0.6 else (start, body, begun, base, far, far_at, of_atr, of_range)
                    if now and gone >= 0.15 and far_at < at and side * (c - back) >= 0:
                        wait = (start, body, begun, base, far, far_at, back, at, of_atr, of_range) if gone <= 0.5 else None
                        now = None
                body, high = side * (c - o), h - lo
                fits = body > 0 and high > 0 and atr > 0 and 0.35 <= body / atr <= 1.2 and body / high >= 0.6
                if now is None and wait is None and fits and (h - c if side == 1 else c - lo) / high <= 0.2:
                    now = (bar, body, at, c, c, at, body / atr, body / high)
        cols = ["side", "bar", "confirmed_bar", "body_atr", "efficiency", "retracement", "pulled", "pullback_s", "recovered", "recovery_s", "micro", "spread", "spread_p50"]
        got = pd.DataFrame(out, columns=cols)
        got.insert(0, "symbol", frame["symbol"].iloc[0])
        return got

    parts = ", ".join(f"{c} double" for c in ("body_atr", "efficiency", "retracement", "pulled", "pullback_s", "recovered", "recovery_s", "micro", "spread", "spread_p50"))
    return bars.groupBy("symbol").applyInPandas(run, f"symbol string, side int, bar bigint, confirmed_bar bigint, {parts}")
