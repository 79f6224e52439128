"""Block-by-block recurrences against one pass over each symbol."""

import random

import numpy as np
import pytest

from tideform.functions import folds, scans
from tideform.functions.scans import Average

SPECS = [Average("e3", "x", "ema", 3), Average("e20", "x", "ema", 20), Average("w14", "x", "wilder", 14), Average("i4", "x", "ema_int", 4), Average("i50", "x", "ema_int", 50), Average("i1", "x", "ema_int", 1), Average("y7", "y", "ema", 7)]


def tape(seed, n):
    rnd, x, rows = random.Random(seed), 5000, []
    for symbol, size in (("A", n), ("B", n // 3), ("C", 5), (None, 40)):
        for k in range(1, size + 1):
            x += rnd.randint(-30, 30)
            rows.append((symbol, 2 * k if symbol == "B" else k, x, x / 3.0, None if rnd.random() < 0.2 else x * 0.5))
    return rows


@pytest.mark.parametrize("block", [17, 65_536])
def test_blocks_do_not_matter(spark, block):
    rows = tape(block, 300)
    df = spark.createDataFrame(rows, "symbol string, seq long, x long, z double, y double").repartition(5)
    got = {(r.symbol, r.seq): r for r in scans.averages(df, "seq", SPECS, block).collect()}
    assert len(got) == len(rows)
    for symbol in ("A", "B", "C", None):
        mine = [r for r in rows if r[0] == symbol]
        x = np.array([r[2] for r in mine])
        whole = {n: folds.ema_int(x, n) for n in (1, 4, 50)}
        y = [(k, r[4]) for k, r in enumerate(mine) if r[4] is not None]
        smooth = dict(zip((k for k, _ in y), folds.ema(np.array([v for _, v in y]), 7)))
        plain = {"e3": folds.ema(x.astype(float), 3), "e20": folds.ema(x.astype(float), 20), "w14": folds.wilder(x.astype(float), 14)}
        for k, r in enumerate(mine):
            g = got[symbol, r[1]]
            for name, v in plain.items():
                assert (g[name] is None) == bool(np.isnan(v[k])) and (g[name] is None or abs(g[name] - v[k]) < 1e-7)
            for n in (1, 4, 50):
                assert g[f"i{n}"] == (whole[n][k] if k + 1 >= n else None)
            v = smooth.get(k, np.nan)
            assert (g.y7 is None) == bool(np.isnan(v)) and (g.y7 is None or abs(g.y7 - v) < 1e-7)


def test_integer_maps():
    rnd = random.Random(4)
    for n in (1, 2, 5, 40):
        x = np.array([rnd.randint(0, 500) for _ in range(200)])
        begin, end = scans.int_map(x, n, 0, 500)
        assert len(begin) <= 2 * n + 2
        for e in range(0, 501, 7):
            assert end[np.searchsorted(begin, e, side="right") - 1] == scans.int_run(x, n, e)[-1]


def test_empty(spark):
    df = spark.createDataFrame([], "symbol string, seq long, x long, y double")
    assert scans.averages(df, "seq", SPECS).count() == 0
    nothing = spark.createDataFrame([("A", 1, None, None)], "symbol string, seq long, x long, y double")
    assert scans.averages(nothing, "seq", SPECS).first().i4 is None


def test_int_map_reads_the_end_only_where_it_decides(monkeypatch):
    """Rows before an end that brings all values to one are not stepped through; where it does not, all are."""
    rnd = np.random.default_rng(3)
    steps = []
    monkeypatch.setattr(scans, "_cut", lambda x, n, f=scans._cut: (steps.append(1), f(x, n))[1])
    for x, most in ((rnd.integers(0, 10_000, 20_000), 2_048), (np.full(20_000, 77), 20_000 + 8_192 + 2_048)):
        for n in (12, 80):
            steps.clear()
            begin, e = scans.int_map(x, n, 0, 10_000)
            assert len(steps) <= most
            for first in (0, 1, 76, 77, 78, 5_000, 10_000):
                want = first
                for v in x.tolist():
                    step = 2 * (v - want)
                    want += step // (n + 1) if step >= 0 else -(-step // (n + 1))
                assert e[np.searchsorted(begin, first, side="right") - 1] == want
