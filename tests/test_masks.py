"""Packed masks: round trip, damage, classes whose digests clash, conjunctions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tideform.sources import masks


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    sets = {"a": rnd.sample(range(-300, 200_000), 500), "b": range(50, 90), "d": [0], "e": rnd.sample(range(-300, 200_000), 700), "f": [2**40, 2**40 + 1]}
    sets["c"], sets["g"] = sets["a"], [*sets["a"][:-1], 7_000_000]
    data = [(k, v) for k, s in sets.items() for v in s] + [("b", 50), ("b", None)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "config string, number long"), {k: sorted(set(s)) for k, s in sets.items()}


def test_round_trip(rows):
    df, sets = rows
    packed = masks.pack(df, ["config"], span=1000)
    assert packed.where("n > 1000 or last - first >= 1000").count() == 0
    got = {}
    for r in masks.unpack(packed.repartition(3), ["config"]).collect():
        got.setdefault(r.config, []).append(r.number)
    assert {k: sorted(v) for k, v in got.items()} == sets


@pytest.mark.parametrize("damage", ["n + 1 as n", "last + 1 as last", "substring(deltas, 1, octet_length(deltas) - 1) as deltas", "concat(deltas, X'00000000') as deltas", "first + 1 as first", "'0' as digest"])
def test_damage_stops_the_job(rows, damage):
    packed = masks.pack(rows[0].where("config = 'b'"), ["config"])
    name = damage.rsplit(" ", 1)[1]
    bad = packed.selectExpr(*(damage if c == name else c for c in packed.columns))
    with pytest.raises(Exception, match="damaged chunk"):
        masks.unpack(bad, ["config"]).collect()


def test_classes_by_content(rows):
    df, sets = rows
    got = {r.representative: r for r in masks.classes(masks.pack(df, ["config"], span=4096), [], "config").collect()}
    assert {k: (r.aliases, r.events, r.exact) for k, r in got.items()} == {k: (2 if k == "a" else 1, len(sets[k]), True) for k in "abdefg"}
    assert got["d"].class_hash == hashlib.sha256(hashlib.sha256(b"0").hexdigest().encode()).hexdigest()


def test_digests_that_clash_are_found(rows):
    df, _ = rows
    clash = masks.pack(df.where("config in ('a', 'c', 'g', 'b')"), ["config"], span=1 << 24, digest=lambda text: F.lit("same"))
    seen = {(r.config, r.canonical): r.same for r in masks.aliases(clash, [], "config").collect()}
    assert seen["a", "a"] and seen["c", "a"] and not seen["g", "a"] and not seen["b", "a"]
    assert [r.exact for r in masks.classes(clash, [], "config", clash="show").where("aliases > 1").collect()] == [False]
    with pytest.raises(Exception, match="share a digest"):
        masks.classes(clash, [], "config").collect()


def test_conjunctions(rows):
    df, sets = rows
    got = {(r.config_a, r.config_b): r.both_n for r in masks.conjunctions(df, [], "config").collect()}
    want = {(x, y): len(set(sets[x]) & set(sets[y])) for x in sets for y in sets if x < y}
    assert got == {k: n for k, n in want.items() if n}


def test_roots_and_empty(spark, rows):
    ids = spark.createDataFrame([(f"{i % 5}{i:03d}",) for i in range(200)] * 2 + [(None,)], "id string").repartition(6)
    got = {r.shard: (r.n, r.root) for r in masks.sorted_roots(ids, F.substring("id", 1, 1)).collect()}
    for s in "01234":
        own = sorted({f"{i % 5}{i:03d}" for i in range(200) if str(i % 5) == s})
        assert got[s] == (40, hashlib.sha256("".join(f"{x}\n" for x in own).encode()).hexdigest())
    none = masks.pack(rows[0].where("false"), ["config"])
    assert masks.unpack(none, ["config"]).count() == masks.classes(none, [], "config").count() == masks.conjunctions(rows[0].where("false"), [], "config").count() == 0
