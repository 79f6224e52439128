"""Checks and conversions of fields; bootstraps against plain resampling."""

import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideform.functions import folds, scalars


def test_dates_hashes_names(spark):
    days = {20240229: True, 20230229: False, 20241301: False, 19691231: False, 22001231: True, 22010101: False, 20240100: False, 202401: False, -20240101: False, None: False}
    df = spark.createDataFrame([(d,) for d in days], "d long")
    assert {r.d: r.ok for r in df.select("d", scalars.valid_date(F.col("d")).alias("ok")).collect()} == days
    texts = {"a" * 64: (True, True), "A" * 64: (False, True), "0" * 63: (False, True), "a" * 64 + "\n": (False, False), "": (False, False), "x y": (False, False), "a_b-9": (False, True), "é": (False, False), "x" * 129: (False, False), None: (False, False)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: (r.h, r.n) for r in df.select("t", scalars.valid_hash(F.col("t")).alias("h"), scalars.valid_name(F.col("t")).alias("n")).collect()} == texts


def test_numbers(spark):
    rows = [(1, 3), (0, 5), (7, 0), (10**12, 1), (999_999, 1_000_000)]
    df = spark.createDataFrame(rows, "a long, b long")
    assert [r[0] for r in df.select(scalars.parts_per_million(F.col("a"), F.col("b"))).collect()] == [a * 10**6 // b if b else 0 for a, b in rows]
    with pytest.raises(Exception, match="beyond the bound"):
        spark.createDataFrame([(10**12 + 1, 1)], "a long, b long").select(scalars.parts_per_million(F.col("a"), F.col("b"))).collect()
    texts = {"R1.5": 1.5, "AT1R": 1.0, "AT2.25R0.5": 2.25, "BE_AT_0.5R": 0.5, "NONE": None, "OFF": None, "x": None, "R": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.m for r in df.select("t", scalars.multiple(F.col("t")).alias("m")).collect()} == texts
    values = {"1.5000": "1.5", "10.0000": "10", "0.0000": "0", "-0.0000": "0", "-2.5000": "-2.5", "100.0100": "100.01"}
    df = spark.createDataFrame([(k, Decimal(k)) for k in values], "k string, v decimal(18,4)")
    assert {r.k: r.p for r in df.select("k", scalars.plain_decimal(F.col("v")).alias("p")).collect()} == values


def test_bootstrap_against_plain_resampling(spark, monkeypatch):
    """The same draws, block by block, in plain numpy; any number of resamples, and of tasks."""
    rng = np.random.default_rng(8)
    daily = {"a": rng.normal(0.1, 1, 37), "b": rng.normal(-0.2, 1, 12), "c": np.array([1.0, 2.0, 3.0])}
    df = spark.createDataFrame([(s, k + 1, float(x)) for s, v in daily.items() for k, x in enumerate(v)], "symbol string, d long, r double")
    got = {r.symbol: r for r in folds.block_bootstrap(df.repartition(6), reps=1200).collect()}
    for s, r in daily.items():
        means, factors, falls = [], [], []
        for k, size in ((0, 500), (1, 500), (2, 200)):
            start = folds._stream(76, 1, k, len(r)).integers(0, len(r), (size, -(-len(r) // 5)))
            for row in start:
                x = [r[(at + o) % len(r)] for at in row for o in range(5)][: len(r)]
                means.append(sum(x) / len(x))
                lost = -sum(v for v in x if v < 0)
                factors.append(sum(v for v in x if v > 0) / lost if lost else math.inf)
                total = peak = fall = 0.0
                for v in x:
                    total += v
                    peak = max(peak, total)
                    fall = max(fall, peak - total)
                falls.append(fall)
        low = sorted(factors)[math.ceil(0.05 * len(factors)) - 1]
        g = got[s]
        assert g.p_not_positive == pytest.approx(np.mean([m <= 0 for m in means])) and g.q05 == pytest.approx(np.quantile(means, 0.05)) and g.drawdown_q95 == pytest.approx(np.quantile(falls, 0.95))
        assert g.factor_q05 == (pytest.approx(low) if math.isfinite(low) else None)
    years = spark.createDataFrame([("a", 2020, 5), ("a", 2021, -3), ("a", 2022, 1), ("b", 2020, -1)], "symbol string, fold long, r long")
    y = {r.symbol: r for r in folds.year_bootstrap(years, reps=800).collect()}
    draws = np.concatenate([np.array([5, -3, 1])[folds._stream(76, 2, k, 3).integers(0, 3, (n, 3))].sum(1) for k, n in ((0, 500), (1, 300))])
    assert y["a"].q05 == np.quantile(draws, 0.05) and y["a"].p_not_positive == pytest.approx((draws <= 0).mean()) and (y["b"].years, y["b"].q50) == (1, -1.0)
