"""Streams against batches: impulses with state and timers, whatever the batches."""

import random

import pytest

from tideform.streaming import impulses as machines

CLOCK = machines.Clock()


def tape(seed, n, symbols=("A", "B")):
    """Trending legs with pullbacks, several ticks a second, over two days; some quotes crossed, some without a spread."""
    rnd, rows = random.Random(seed), []
    for symbol in symbols:
        ms, bid, drift = machines.DAY_MS * 18_000 + 77_000_000, 100_000, 0
        for k in range(1, n + 1):
            leg = ms // CLOCK.fast % 4  # a bar up or down, one that pulls back and returns, two that drift
            if leg == 0 and not drift:
                drift = rnd.choice([-2, 2])
            gone = ms % CLOCK.fast / CLOCK.fast
            now = drift if leg == 0 else (-drift if gone < 0.25 else drift) if leg == 1 else 0
            drift = 0 if leg == 2 else drift
            ms += rnd.choice([0, 500, 1000, 4000])
            bid += now + rnd.randint(-2, 2)
            rows.append((symbol, k, ms * 1_000_000 + 5, 20260101, bid, bid + rnd.choice([-1, 0, 2, 2, 3, 4])))
    return rows


def plain(rows):
    out = []
    for symbol in sorted({r[0] for r in rows}):
        machine, around = machines.Machine(CLOCK), machines.Surroundings(CLOCK)
        for _, seq, ts, _, bid, ask in sorted(r for r in rows if r[0] == symbol):
            if ask >= bid:
                got = around.step(ts // 1_000_000, bid, ask)
                out += [(symbol, ts // 1_000_000, seq, *e) for e in machine.step(ts // 1_000_000, bid, ask, *got)]
    return out


def rounded(rows):
    return sorted((r[0], r[1], r[2], r[3], round(r[4], 6), round(r[5], 6), r[6]) for r in map(tuple, rows))


SCHEMA = "symbol string, seq long, ts_ns long, session_day long, bid_u long, ask_u long"


@pytest.fixture(scope="module")
def rows():
    return tape(3, 24_000)


def test_batch_by_days(spark, rows):
    want = plain(rows)
    assert len(want) >= 5 and {r[3] for r in want} == {1, -1}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rounded(machines.impulses(df, CLOCK).collect()) == rounded(want)
    assert machines.impulses(df.where("false"), CLOCK).count() == 0


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_equals_batch(spark, rows, cuts, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    order = sorted(rows, key=lambda r: r[2])
    step = -(-len(order) // cuts)
    for k in range(cuts):  # each batch repeats the end of the one before
        part = order[max(0, k * step - 40) : (k + 1) * step]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = machines.stream_impulses(stream, CLOCK).writeStream.format("memory").queryName(f"impulses{cuts}").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rounded(spark.table(f"impulses{cuts}").collect()) == rounded(plain(rows))


def test_machine_forgets():
    """No confirmation before its time, none after a deep pullback, a new day or the wait's end."""

    def run(ticks):
        m, out = machines.Machine(CLOCK, {"day": None, "bar": [0, 0, 100, 0, 100], "sides": {}}), []
        for ms, bid in ticks:
            out += [(ms, e[0], e[3]) for e in m.step(ms, bid, bid + 2, 120.0, 2, 0.0)]
        return out

    t = CLOCK.fast
    assert run([(t, 100), (t + 1000, 75), (t + 2000, 95), (t + 11_999, 96), (t + 12_000, 97), (t + 13_000, 97)]) == [(t + 12_000, 1, True)]
    assert run([(t, 100), (t + 1000, 30), (t + 2000, 95), (t + 13_000, 97)]) == []
    assert run([(t, 100), (t + 1000, 45), (t + 2000, 95), (t + 13_000, 97)]) == []
    assert run([(t, 100), (t + 1000, 75), (t + CLOCK.expire + 1, 95), (t + CLOCK.expire + 20_000, 97)]) == []
    assert run([(t, 100), (t + 1000, 75), (t + 2000, 95), (machines.DAY_MS + 5, 97)]) == []
