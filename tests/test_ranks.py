"""Order statistics of moving windows against sorting each of them."""

import random

import numpy as np
import pytest

from tideform.functions import ranks

QUANTILES = {"q20": (1, 5), "q50": (1, 2), "q75": (3, 4), "q90": (9, 10)}


def test_kth():
    rng = np.random.default_rng(1)
    for n, most in ((1, 1), (7, 3), (500, 40), (500, 10**9)):
        x = rng.integers(-most, most, n)
        wave = ranks.Wavelet(x)
        low = rng.integers(0, n, 300)
        high = low + 1 + (rng.random(300) * (n - low)).astype(int).clip(0, n - low - 1)
        k = 1 + (rng.random(300) * (high - low)).astype(int).clip(0, high - low - 1)
        assert wave.kth(low, high, k).tolist() == [sorted(x[a:b])[c - 1] for a, b, c in zip(low, high, k)]


@pytest.mark.parametrize("block", [1, 40, 65_536])
def test_rolling(spark, block):
    rnd, rows = random.Random(block), []
    for symbol, n in (("A", 260), ("B", 30), ("C", 3)):
        rows += [(symbol, k, None if rnd.random() < 0.01 else rnd.randint(0, 60)) for k in range(1, n + 1)]
    df = spark.createDataFrame(rows, "symbol string, bar long, v long")
    got = {(r.symbol, r.bar, r.lookback): tuple(r)[3:] for r in ranks.rolling(df, "v", (5, 20, 100), QUANTILES, block).collect()}
    want = {}
    for symbol in "ABC":
        x = [r[2] for r in rows if r[0] == symbol]
        for length in (5, 20, 100):
            for t in range(length + 1, len(x)):
                window, reference = x[t - length - 1 : t - 1], x[t - 1]
                if None not in window and reference is not None:
                    w = sorted(window)
                    want[symbol, t + 1, length] = (reference, *(w[-(-part * length // of) - 1] for part, of in QUANTILES.values()))
    assert got == want
    assert ranks.rolling(df.where("false"), "v", (5,), QUANTILES).count() == 0


def test_cost_does_not_follow_the_length():
    """The same searches touch the same arrays whatever the window."""
    rng = np.random.default_rng(2)
    wave = ranks.Wavelet(rng.integers(0, 1000, 20_000))
    assert len(wave.zeros) == 10
    t = np.arange(10_001, 20_000)
    for length in (20, 10_000):
        got = wave.kth(t - length, t, np.full(len(t), ranks.nearest_rank(length, 1, 2)))
        assert len(got) == len(t)
