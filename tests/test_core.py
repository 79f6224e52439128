"""Folds, packed tapes, streaming bars and first-touch exits against plain loops."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideform import queries
from tideform.functions import folds
from tideform.sources import packed
from tideform.streaming.closed_bars import closed_bars

DATA = "/root/testdata/sf0.001"


def test_integer_ema_cuts_towards_zero():
    assert folds.ema_int(np.array([10, 13, 19]), 3) == [10, 11, 15]
    assert folds.ema_int(np.array([10, 3]), 3) == [10, 7]


def test_rsi_edges():
    assert folds.rsi(np.arange(30))[-1] == 100 and folds.rsi(-np.arange(30))[-1] == 0 and folds.rsi(np.ones(30))[-1] == 50
    assert np.isnan(folds.adx(np.arange(5), np.arange(5), np.arange(5))).all()
    x = np.random.default_rng(1).normal(size=40).cumsum()
    assert np.isnan(folds.adx(x + 1, x - 1, x)[:26]).all() and not np.isnan(folds.adx(x + 1, x - 1, x)[26:]).any()


def test_tape_is_numbered_by_days(spark):
    """A tape over several days, with equal times and a day that has one tick, numbers as one sort of a symbol would."""
    import datetime as dt

    start = dt.datetime(2024, 2, 28, 22)
    rows = [(i, start + dt.timedelta(hours=(i * 7) % 60 // 2 * 2), i % 5, ("a", "b")[i % 3 == 0], i / 7) for i in range(90)] + [(99, start + dt.timedelta(days=9), 1, "a", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").createOrReplaceTempView("some_events")
    text = queries.PLANS["tick_view"].text(True).replace("FROM events", "FROM some_events")
    got = sorted((r.symbol, r.seq, r.ts_ns) for r in spark.sql(text).collect())
    want = []
    for symbol in "ab":
        own = sorted((r[1], r[0]) for r in rows if r[3] == symbol)
        want += [(symbol, n + 1, t) for n, (t, _) in enumerate(own)]
    epoch = dt.datetime(1970, 1, 1)
    assert [(s, n, epoch + dt.timedelta(microseconds=t // 1000)) for s, n, t in got] == want


def test_upper_tail():
    import math

    from tideform.operators import metrics

    for t in (-4.0, -1.0, -0.2, 0.0, 0.5, 1.96, 6.0):
        value = __import__("duckdb").execute(f"SELECT {metrics.upper_tail(f'CAST({t} AS DOUBLE)')}").fetchone()[0]
        assert abs(value - 0.5 * math.erfc(t / math.sqrt(2))) < 2e-7
    assert abs(metrics.harmonic(1_000_001) - sum(1 / k for k in range(1, 1_000_002))) < 1e-9


def test_retest_rules(spark):
    """The rules on a tape of bars, against looking through the bars for each cross."""
    bars = queries.NUMBERED
    bars = queries.Plan(*bars, select="SELECT symbol, bar, low_u, high_u, close_u FROM nb").run(spark, DATA).collect()
    crosses = queries.Plan(*queries.CROSSED, select="SELECT symbol, side, level_id, bar, level, until_bar FROM crossed").run(spark, DATA).collect()
    tape = {(b.symbol, b.bar): b for b in bars}
    assert crosses
    want = set()
    for symbol, side in {(c.symbol, c.side) for c in crosses}:
        own = sorted((c for c in crosses if (c.symbol, c.side) == (symbol, side)), key=lambda c: c.bar)
        other = sorted(c.bar for c in crosses if c.symbol == symbol and c.side == -side)
        last = max(b for s, b in tape if s == symbol)
        inside = lambda c, b: tape[symbol, b].low_u <= c.level if side == 1 else tape[symbol, b].high_u >= c.level
        beyond = lambda c, b: tape[symbol, b].close_u > c.level if side == 1 else tape[symbol, b].close_u < c.level
        for rearm in folds.REARM:
            for retest in folds.RETEST:
                used, allowed, blocked = None, 0, 0
                for c in own:
                    until, end = c.until_bar or last + 1, min([c.until_bar or last + 1, *(o for o in other if o > c.bar), c.bar + 5])
                    if c.bar < blocked or c.level_id == used and (rearm != "return" or c.bar < allowed):
                        continue
                    look = range(c.bar + 1, min(end, last + 1))
                    if retest == "off":
                        final = c.bar
                    elif retest == "close":
                        final = next((b for b in look if inside(c, b) and beyond(c, b)), None)
                    else:
                        touch = next((b for b in look if inside(c, b)), None)
                        final = next((b for b in look if touch is not None and b >= touch and beyond(c, b)), None)
                    if final is None:
                        blocked = min([x for x in (c.until_bar, *(o for o in other if o > c.bar), c.bar + 5) if x])
                        continue
                    used, blocked = c.level_id, 0
                    back = next((b for b in range(final + 1, until) if inside(c, b)), None)
                    allowed = min([x for x in (back, c.until_bar) if x], default=10**9)
                    want.add((symbol, side, rearm, retest, c.level_id, c.bar, final))
    got = queries.queries()["retest_filter"](spark, DATA).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_impulse_and_scores(spark):
    """One impulse that is armed, gives up 0.3 of its body, comes back and is confirmed; parts and scores by hand."""
    bars = [(1, 100, 100, 110, 100, 110), (2, 101, 110, 111, 107, 108), (3, 102, 108, 110, 108, 110), (4, 103, 110, 112, 109, 111)]
    rows = [("a", b, t, o, h, lo, c, 20.0, 0.75, 1.0, 2.0) for b, t, o, h, lo, c in bars]
    df = spark.createDataFrame(rows, "symbol string, bar long, bucket long, open_u long, high_u long, low_u long, close_u long, atr14 double, up_share double, spread double, spread_p50 double")
    got = folds.impulses(df).where("side = 1").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.bar, r.confirmed_bar, r.body_atr, r.efficiency) == (1, 4, 0.5, 1.0) and abs(r.retracement - 0.3) < 1e-12
    assert (r.pulled, r.pullback_s, r.recovered, r.recovery_s) == (3.0, 3600.0, 2.0, 3600.0)
    from tideform.operators import indicators
    from tideform.plans.sql import dialect

    one, two = folds.impulses(df).where("side = 1").selectExpr(dialect(indicators.ips(1), True), dialect(indicators.ips(2), True)).first()
    parts = [0.15 / 0.55, 1.0, 1.0, (2 / 3) / 2, 0.75, 0.75]
    for score, weights in ((one, (20, 15, 20, 20, 15, 10)), (two, (15, 5, 10, 20, 30, 20))):
        assert abs(score - sum(w * p for w, p in zip(weights, parts))) < 1e-9


def test_replay_against_loop(spark):
    ticks = queries.PLANS["tick_view"].run(spark, DATA).toPandas().sort_values(["symbol", "seq"])
    close = ticks.groupby(["symbol", "session_day"])["seq"].transform("max")
    got = {(r.symbol, r.intent_id): r for r in queries.queries()["replay_intents"](spark, DATA).collect()}
    rows = {s: list(f.assign(close=close).itertuples(index=False)) for s, f in ticks.groupby("symbol")}
    n = 0
    for symbol, tape in rows.items():
        for i, t in enumerate(tape):
            if t.seq % 7 or t.seq >= t.close:
                continue
            side, n = (1 if t.seq % 2 == 0 else -1), n + 1
            session = [x for x in tape[i + 1 :] if x.seq <= t.close and x.ask_u > x.bid_u]
            r = got[symbol, t.seq]
            if not session:
                assert r.reason == "NO_ENTRY"
                continue
            entry, rest = session[0], session[1:]
            price = entry.ask_u if side == 1 else entry.bid_u
            want = (None, None, "UNRESOLVED")
            for x in rest:
                out = x.bid_u if side == 1 else x.ask_u
                want = (x.seq, out, "CLOSE")
                if side * (out - price) <= -1500:
                    want = (x.seq, out, "STOP")
                    break
                if side * (out - price) >= 2500:
                    want = (x.seq, out, "TARGET")
                    break
            assert (r.entry_seq, r.entry_u, r.exit_seq, r.exit_u, r.reason) == (entry.seq, price, *want)
    assert n == len(got)


def test_packed_round_trip(spark, tmp_path):
    rows = [(1_700_000_000_000 + 7 * i, 100 - i, 102 - i * 3, 6) for i in range(50)]
    for k in range(2):
        (tmp_path / f"{k}.bin").write_bytes(b"".join(struct.pack("<qiiB", *r) for r in rows[k * 25 : k * 25 + 25]))
    tape = packed.read_packed(spark, str(tmp_path), 5)
    assert [tuple(r) for r in tape.orderBy("seq").collect()] == [(5 + i, t * 1_000_000, b, a, f) for i, (t, b, a, f) in enumerate(rows)]
    many = [(k, k % 97, k % 89, k % 7) for k in range(60_000)]
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "0.bin").write_bytes(b"".join(struct.pack("<qiiB", *r) for r in many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.input.fileinputformat.split.maxsize", "100000")
    big = packed.read_packed(spark, str(tmp_path / "big"))
    assert big.select(F.spark_partition_id()).distinct().count() > 5
    assert [(r.seq, r.ts_ns // 1_000_000, r.bid_u, r.ask_u, r.flags) for r in big.orderBy("seq").collect()] == [(k + 1, *r) for k, r in enumerate(many)]
    conf.unset("mapreduce.input.fileinputformat.split.maxsize")
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    same = packed.conversion_parity(tape.withColumn("session_day", F.lit(1)), tape).first()
    assert tuple(same) == (50, 0, 0)
    (tmp_path / "2.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="truncated"):
        packed.read_packed(spark, str(tmp_path)).collect()


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seq,ts_ns,session_day,bid_u,ask_u\n1,2,20240101,3,4\n")
    assert packed.read_csv_tape(spark, str(tmp_path / "a.csv")).collect()[0].ask_u == 4
    (tmp_path / "b.csv").write_text("seq,ts_ns,session_day,bid_u,ask_u\n1,x,20240101,3,4\n")
    with pytest.raises(Exception):
        packed.read_csv_tape(spark, str(tmp_path / "b.csv")).collect()


def test_greedy_and_refractory(spark):
    trades = spark.createDataFrame([("a", 1, 1, 5), ("a", 2, 5, 6), ("a", 3, 6, 9), ("b", 4, 1, 2)], "symbol string, intent_id long, entry_seq long, exit_seq long")
    assert sorted(r.intent_id for r in folds.greedy(trades).where("accepted").collect()) == [1, 3, 4]
    events = spark.createDataFrame([("a", 1, 1, b) for b in (1, 3, 7, 8, 13)], "symbol string, threshold int, side int, bar long")
    assert sorted(r.bar for r in folds.refractory(events, 5).collect()) == [1, 7, 13]


def test_stream_equals_batch(spark, tmp_path):
    ticks = queries.PLANS["tick_view"].run(spark, DATA).select("symbol", "seq", "ts_ns", "bid_u")
    rows = ticks.orderBy("ts_ns").collect()
    for k in range(3):
        part = rows[k * len(rows) // 3 : (k + 1) * len(rows) // 3]
        spark.createDataFrame(part, ticks.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = closed_bars(stream, 86_400_000).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = ticks.withColumn("bucket", F.expr("ts_ns div 86400000000000")).groupBy("symbol", "bucket").agg(
        F.min_by("bid_u", "seq").alias("o"), F.max("bid_u").alias("h"), F.min("bid_u").alias("l"), F.max_by("bid_u", "seq").alias("c"), F.count("*").alias("n"))
    last = batch.groupBy("symbol").agg(F.max("bucket").alias("bucket"))
    want = batch.join(last, ["symbol", "bucket"], "left_anti")
    assert sorted(map(tuple, spark.table("closed").collect())) == sorted(map(tuple, want.collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_feature_language_refuses():
    from tideform.plans.features import compile_graph

    good = {"a": "CLOSE:$p", "b": "EMA:a:3", "c": "GT:a:b"}
    assert [n.name for n in compile_graph(good, ["c"], {"p": 60_000})] == ["a", "b", "c"]
    for bad, outputs, message in (
        ({"a": "ADD:a:a"}, ["a"], "cycle"), ({"a": "NOT:b"}, ["a"], "unknown definition"), ({"a": "SUM:b"}, ["a"], "unknown operator"), (good | {"d": "BID"}, ["c"], "unused"),
        ({"a": "BID", "b": "NOT:a"}, ["b"], "conditions"), ({"a": "BID", "b": "GT:a:a", "c": "ADD:a:b"}, ["c"], "numbers"), ({"a": "CLOSE:0"}, ["a"], "range"),
        ({"a": "CLOSE:$q"}, ["a"], "parameter"), ({"a": "BID:1"}, ["a"], "arguments"), ({"a": "CONST:x"}, ["a"], "whole number"), ({"a": "BID", "b": "LAG:a:100001"}, ["b"], "range"),
    ):
        with pytest.raises(ValueError, match=message):
            compile_graph(bad, outputs, {"p": 60_000})


def test_blocks_of_quotes(spark, monkeypatch):
    """Looking back over quotes in small blocks gives what one sort of the tape would."""
    from tideform.plans import features

    monkeypatch.setattr(features, "BLOCK", 7)
    ticks = queries.PLANS["tick_view"].run(spark, DATA)
    nodes = features.compile_graph({"bid": "BID", "ask": "ASK", "old": "LAG:bid:5", "top": "HIGHEST:ask:4", "x": "CROSS_DOWN:bid:old"}, ["top", "x"])
    got = features.Graph(ticks, nodes).values("old", "top", "x").toPandas().sort_values(["symbol", "seen"])
    f = ticks.toPandas().sort_values(["symbol", "seq"])
    g = f.groupby("symbol")
    old, top = g["bid_u"].shift(5), g["ask_u"].transform(lambda s: s.rolling(4).max())
    prior, prior_bid = old.groupby(f["symbol"]).shift(1), g["bid_u"].shift(1)
    same = lambda a, b: (a.astype("float64").fillna(-1).to_numpy() == b.astype("float64").fillna(-1).to_numpy()).all()
    assert len(got) == len(f) and same(got["old"], old) and same(got["top"], top)
    want = ((prior_bid >= prior) & (f["bid_u"] < old)).where(prior.notna())
    assert same(got["x"].map({True: 1, False: 0}), want.map({True: 1, False: 0}))
