"""Sinks that never overwrite, strict ledgers, scenarios, vendor files; folds and clusters against plain loops."""

import struct
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideform import queries
from tideform.functions import clusters, folds
from tideform.sources import ledgers, packed

DATA = "/root/testdata/sf0.001"


def test_write_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    path = str(tmp_path / "t")
    assert ledgers.write_once(df, path) is True and ledgers.write_once(df.orderBy(F.desc("k")), path) is False
    with pytest.raises(ValueError, match="other rows"):
        ledgers.write_once(df.limit(1), path)
    assert spark.read.parquet(path).count() == 2


def test_ledger_is_strict(spark, tmp_path):
    ok = "a,20240101,7,1,1,10,100,2,20,130,30,15,TARGET"
    head = ",".join(ledgers.LEDGER.names)
    (tmp_path / "ok.csv").write_text(f"{head}\n{ok}\n")
    assert ledgers.read_ledger(spark, str(tmp_path / "ok.csv")).first().net_u == 30
    for k, bad in enumerate((ok.replace(",30,15", ",31,15"), ok.replace(",2,20,", ",1,20,"), ok.replace("TARGET", "TARGET,9"), ok.replace("100", "x"), ok.replace(",7,1,1,", ",7,,1,"))):
        (tmp_path / f"{k}.csv").write_text(f"{head}\n{bad}\n")
        with pytest.raises(Exception):
            ledgers.read_ledger(spark, str(tmp_path / f"{k}.csv")).collect()


def test_scenarios(spark, tmp_path):
    tick = '{{"carrier_sequence":{},"timestamp":{},"bid":"{}","ask":"{}"}}'
    line = '{{"scenario_id":"{}","event_anchor":{{"side":"{}","trigger_ts":10,"close_ts":50,"stop":"{}"}},"ticks":[{}]}}'
    ticks = ",".join(tick.format(*t) for t in [(1, 5, "1.0", "1.1"), (2, 10, "1.0", "1.2"), (3, 10, "1.3", "1.3"), (4, 20, "0.9", "1.0"), (5, 50, "1.4", "1.5"), (6, 51, "0.1", "0.2")])
    (tmp_path / "s.jsonl").write_text("\n".join(line.format(*x, ticks) for x in (("a", "BUY", "0.8"), ("b", "BUY", "0.9"), ("c", "SELL", "1.5"), ("e", "SELL", "1.2"))) + "\n" + line.format("d", "BUY", "0.5", tick.format(1, 5, "1", "2")))
    got = {r.scenario_id: r for r in ledgers.scenario_outcomes(ledgers.read_scenarios(spark, str(tmp_path / "s.jsonl"))).collect()}
    assert (got["a"].reason, got["a"].r) == ("TIME", Decimal("0.5")) and (got["b"].reason, got["b"].r) == ("STOP", Decimal(-1))
    assert got["c"].reason == "STOP" and got["c"].exit == Decimal("1.5") and got["d"].reason == "NO_ENTRY" and got["d"].r is None
    assert got["e"].reason == "STOP" and got["e"].exit == Decimal("1.2")  # the entry's own record


def test_vendor_to_packed(spark, tmp_path):
    (tmp_path / "v.csv").write_text("date,time,bid,ask\n2018.03.14,12:00:00.250,7000.1,7000.3\n1969.12.31,23:59:59,-1.5,2\n")
    rows = ledgers.read_vendor_csv(spark, str(tmp_path / "v.csv"))
    assert sorted(map(tuple, rows.collect())) == [(-1000, -15, 20), (1521028800250, 70001, 70003)]
    records = ledgers.packed_records(rows.withColumn("flags", F.lit(6)))
    raw = sorted(bytes(r.rec) for r in records.collect())
    assert raw == sorted(struct.pack("<qiiB", *r, 6) for r in [(-1000, -15, 20), (1521028800250, 70001, 70003)])
    (tmp_path / "x.bin").write_bytes(b"".join(raw))
    assert {(r.ts_ns, r.bid_u, r.ask_u) for r in packed.read_packed(spark, str(tmp_path / "x.bin")).collect()} == {(-1_000_000_000, -15, 20), (1521028800250_000_000, 70001, 70003)}
    with pytest.raises(Exception, match="too many digits"):
        ledgers.read_vendor_csv(spark, str(tmp_path / "v.csv"), 0).collect()


def test_schedule(spark):
    offers = spark.createDataFrame([("a", 1, k, a, b) for k, (a, b) in enumerate([(1, 5), (4, 6), (6, 7), (8, 9), (10, 11)])] + [("a", 2, 9, 12, 13)], "symbol string, session_day long, intent_id long, entry_seq long, exit_seq long")
    assert {r.intent_id: r.reason for r in folds.schedule(offers).collect()} == {0: "", 1: "OVERLAP", 2: "", 3: "", 4: "DAILY_LIMIT", 9: ""}


def test_managed_exits_against_loop(spark):
    ticks = {s: f.sort_values("seq") for s, f in queries.PLANS["tick_view"].run(spark, DATA).toPandas().groupby("symbol")}
    entered = queries.Plan(*queries.HELD, select="SELECT symbol, session_day, intent_id, side, stop_u, target_u, limit_seq, entry_seq, entry_u FROM entered").run(spark, DATA).collect()
    got = {(r.symbol, r.intent_id): r for r in queries.queries()["managed_exits"](spark, DATA).collect()}
    plain = {(r.symbol, r.intent_id): r for r in queries.queries()["atr_brackets"](spark, DATA).collect()}
    for e in entered:
        best, out, hit = None, None, None
        f = ticks[e.symbol]
        for t in f[(f.seq > e.entry_seq) & (f.seq <= e.limit_seq) & (f.ask_u > f.bid_u) & (f.session_day == e.session_day)].itertuples():
            gain = e.side * ((t.bid_u if e.side == 1 else t.ask_u) - e.entry_u)
            if hit is None and (gain <= -e.stop_u or gain >= e.target_u):
                hit = t.seq
            level = -e.stop_u if best is None else max(-e.stop_u, 0 if best >= e.stop_u else -e.stop_u, best - 2 * e.stop_u)
            if out is None or not out[2]:
                out = (t.seq, gain, gain <= level or gain >= e.target_u)
            best = gain if best is None else max(best, gain)
        mine = got.get((e.symbol, e.intent_id))
        assert (mine is None) == (out is None)
        if out:
            assert (mine.exit_seq, mine.gain_u) == out[:2]
            assert plain[e.symbol, e.intent_id].exit_seq == (hit if hit is not None else f[(f.seq <= e.limit_seq) & (f.ask_u > f.bid_u)].seq.max())
    assert entered


def test_clusters(spark):
    rng = np.random.default_rng(3)
    pairs = [(f"n{a:03}", f"n{b:03}", 0.5) for a, b in rng.integers(0, 120, (90, 2)) if a != b] + [(f"p{k:03}", f"p{k + 1:03}", 1.0) for k in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in pairs:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    edges = spark.createDataFrame(pairs, "a string, b string, weight double")
    assert {r.node: r.component for r in clusters.components(edges.select("a", "b")).collect()} == {x: find(x) for x in list(root)}
    assert [r.medoid for r in clusters.medoids(edges).where("component = 'p000'").collect()] == ["p001"]
    assert clusters.medoids(edges.limit(0)).count() == 0


def test_statistics(spark):
    blocks = spark.createDataFrame([("up", k, 10**9) for k in range(8)] + [("flat", k, 2 * (-1) ** k + (k == 0)) for k in range(8)] + [("down", 1, -5)], "symbol string, fold long, r long")
    p = {r.symbol: r.p for r in folds.sign_flip(blocks).collect()}
    assert p["up"] < 0.02 and p["flat"] > 0.3 and p["down"] == 1.0
    bits = folds.xorshift_bits(10_000)
    assert 0.48 < bits.mean() < 0.52


@pytest.mark.parametrize("name", ["bootstrap", "portfolio_allocation"])
def test_registered_folds_give_rows(spark, name):
    assert queries.queries()[name](spark, DATA).count() > 0
