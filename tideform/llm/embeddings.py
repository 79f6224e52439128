"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A table hashes a vector to the axis (with sign) that its rotated direction lies closest to; several such hashes make a
bucket. Each vector goes to its own bucket and to the next best ones, and all pairs of a bucket are verified in double
precision. A pair that shares several buckets counts in the first of them only, so links are counted, not listed. How
many hashes a bucket takes follows from the number of vectors; how many tables follow from the measured chance that two
vectors right at the threshold meet, so that at least ``RECALL`` of such pairs do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideform.llm.common import Scratch
from tideform.llm.components import connected_components
from tideform.llm.simhash import _roots

RECALL = 0.985  # aimed at for pairs right at the threshold; closer pairs meet more often
BUCKET = 1024  # vectors of a bucket aimed at when choosing the hashes per bucket
PART = 2048  # vectors of a bucket that one task compares with as many others
TILE = 1024
PROBES = 2  # best axes tried per hash


def _rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of sign flips and a Walsh-Hadamard transform; x is rows x a power of two."""
    for s in signs:
        x = x * s
        h, d = 1, x.shape[1]
        while h < d:
            x = x.reshape(len(x), d // (2 * h), 2, h)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
            h *= 2
            x = x.reshape(len(x), d)
    return x


def _signs(dim: int, table: int, k: int) -> np.ndarray:
    return np.random.default_rng([dim, table, k]).choice([-1.0, 1.0], size=(3, dim))


def _codes(x: np.ndarray, table: int, hashes: int) -> np.ndarray:
    """Buckets of each row in one table: rows x PROBES ** hashes, the own one first."""
    dim = 1 << max(1, math.ceil(math.log2(max(2, x.shape[1]))))
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    codes = np.zeros((len(x), 1), np.int64)
    for k in range(hashes):
        y = _rotate(padded, _signs(dim, table, k))
        axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :PROBES]
        axes = 2 * axes + (np.take_along_axis(y, axes, 1) < 0)
        codes = (codes[:, :, None] * (2 * dim) + axes[:, None, :]).reshape(len(x), -1)
    return codes


@lru_cache(maxsize=64)
def plan(rows: int, dim: int, threshold: float) -> tuple[int, int]:
    """Hashes per bucket and number of tables for so many vectors."""
    hashes = max(1, math.ceil(math.log(max(1, rows / BUCKET)) / math.log(2 * max(2, dim))))
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 4000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
    b = threshold * a + math.sqrt(max(0.0, 1 - threshold**2)) * b
    ca, cb = _codes(a, 0, hashes), _codes(b, 0, hashes)
    p = float((ca[:, :, None] == cb[:, None, :]).any((1, 2)).mean())
    return hashes, max(1, math.ceil(math.log(1 - RECALL) / math.log(max(1e-9, 1 - min(p, 1 - 1e-9)))))


def _hashed(frames: Iterator[pd.DataFrame], rows: int, threshold: float, slim: bool, packed: type = np.float64) -> Iterator[pd.DataFrame]:
    for whole in frames:
        lengths = whole["vec"].map(len)
        for dim, frame in whole.groupby(lengths.to_numpy()):
            x = np.stack([np.asarray(v, np.float64) for v in frame["vec"]])
            hashes, tables = plan(rows, int(dim), threshold)
            codes = np.stack([_codes(x, t, hashes) for t in range(tables)], axis=1)  # rows x tables x probes
            for t in range(tables):
                for j in range(codes.shape[2]):
                    out = pd.DataFrame({"dim": np.int32(dim), "tab": np.int32(t), "code": codes[:, t, j]})
                    if not slim:
                        out["rep"], out["size"] = frame["rep"].to_numpy(), frame["size"].to_numpy()
                        out["vec"] = [v.tobytes() for v in x.astype(packed)]
                    yield out


def _verified(frame: pd.DataFrame, threshold: float, hashes: int, tables: int, packed: type) -> pd.DataFrame | None:
    """Links that one run owns: for each vector how many others, and edges that keep the components.

    The buckets of a vector follow from it, so they are worked out again for those that link instead of travelling along.
    """
    tab, code = int(frame["tab"].iloc[0]), int(frame["code"].iloc[0])
    frame = frame.sort_values("side", kind="stable")
    side, ids, size = frame["side"].to_numpy(), frame["rep"].to_numpy(), frame["size"].to_numpy()
    x = np.stack([np.frombuffer(v, packed) for v in frame["vec"]]).astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    links = np.zeros(len(x))
    known: dict[int, np.ndarray] = {}

    def codes(rows: np.ndarray) -> np.ndarray:
        """Buckets of some rows: rows x tables x probes."""
        new = np.array([k for k in np.unique(rows).tolist() if k not in known], np.int64)
        if len(new):
            got = np.stack([_codes(x[new], t, hashes) for t in range(tables)], axis=1)
            known.update(zip(new.tolist(), got))
        return np.stack([known[k] for k in rows.tolist()])

    a, b = [], []
    split = int((side == 0).sum()) if (side == 1).any() else None
    cuts = sorted({0, len(x), *range(0, len(x), TILE), *([split] if split else [])})
    tiles = list(zip(cuts[:-1], cuts[1:]))
    for i, (p, q) in enumerate(tiles):
        for r, s in tiles[i:]:
            if split is not None and side[p] == side[r]:
                continue
            cos = (x[p:q] @ x[r:s].T) / (norm[p:q, None] * norm[None, r:s])
            match = cos >= threshold
            if p == r:
                match = np.triu(match, 1)
            m, n = np.nonzero(match)
            for at in range(0, len(m), 1 << 16):  # where several buckets hold the pair, the first one owns it
                mm, nn = m[at : at + (1 << 16)], n[at : at + (1 << 16)]
                left, right = codes(p + mm), codes(r + nn)
                same = left[:, :, :, None] == right[:, :, None, :]
                first = same.any((2, 3)).argmax(1)
                k = np.arange(len(mm))
                common = np.where(same[k, first].any(2), left[k, first], np.iinfo(np.int64).max).min(1)
                lost = (first != tab) | (common != code)
                match[mm[lost], nn[lost]] = False
            m, n = np.nonzero(match)
            if not len(m):
                continue
            links[p:q] += np.bincount(m, weights=size[r + n], minlength=q - p)
            links[r:s] += np.bincount(n, weights=size[p + m], minlength=s - r)
            if p == r:
                match = match | match.T
            left, right = _roots(match)
            for u, v in enumerate(left.tolist()):
                if u != v:
                    a.append(p + u), b.append(p + v)
            for u, v in enumerate(right.tolist()):
                if v < q - p and (p + v) != (r + u):
                    a.append(r + u), b.append(p + v)
    some = np.flatnonzero(links)
    if not len(some):
        return None
    counted = pd.DataFrame({"a": ids[some], "b": ids[some], "links": links[some].astype(np.int64)})
    return pd.concat([counted, pd.DataFrame({"a": ids[a], "b": ids[b], "links": np.int64(0)})])


def _compare(frames: Iterator[pd.DataFrame], rows: int, threshold: float, packed: type) -> Iterator[pd.DataFrame]:
    """Frames sorted by run; a run is at most two parts long and may go on into the next frame."""
    rest: pd.DataFrame | None = None

    def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for _, run in frame.groupby(["dim", "tab", "code", "pair"], sort=False):
            if len(run) > 1:
                if (out := _verified(run, threshold, *plan(rows, int(run["dim"].iloc[0]), threshold), packed)) is not None:
                    yield out

    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame])
        if not len(frame):
            continue
        last = frame.iloc[-1]
        open_ = ((frame["tab"] == last["tab"]) & (frame["code"] == last["code"]) & (frame["pair"] == last["pair"]) & (frame["dim"] == last["dim"])).to_numpy()
        yield from done(frame[~open_])
        rest = frame[open_]
    if rest is not None:
        yield from done(rest)


def embedding_links(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Near-duplicate vectors by cosine.

    Returns one row per input row: ``(id_col, n_links, component_id, kept)``: how many other vectors are linked directly
    (cosine >= threshold, in double precision), the smallest identifier reachable by links, and whether that is the
    row's own. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
    different lengths do not link. Equal vectors always link and are hashed once. No pair below the threshold is
    returned; of those at it about ``RECALL`` are found. Labels and other columns are ignored; an empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    vec = F.col(vec_col).cast("array<double>")
    good = F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, vec).alias("vec"))
    reps = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    reps = scratch.save(reps.select("rep", "size", "vec"), "reps")
    n = reps.count()
    key = "dim int, tab int, code bigint"
    # Single-precision input moves as such, which loses nothing; it is compared in double precision all the same.
    packed = np.float32 if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else np.float64
    kind = vectors.schema[id_col].dataType.simpleString()
    codes = reps.mapInPandas(lambda f: _hashed(f, n, threshold, True), key)
    sizes = codes.groupBy("dim", "tab", "code").count().where("count > 1")
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("count") / PART)).drop("count"), "sizes")
    keyed = reps.mapInPandas(lambda f: _hashed(f, n, threshold, False, packed), f"{key}, rep {kind}, size bigint, vec binary")
    keyed = keyed.join(sizes, ["dim", "tab", "code"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    keyed = keyed.withColumn("pair", F.explode(pair))
    low, high = F.expr("pair div parts"), F.expr("pair % parts")
    keyed = keyed.withColumn("side", ((low != high) & (F.col("own") == high)).cast("int")).drop("parts", "own")
    keyed = keyed.repartition("dim", "tab", "code", "pair").sortWithinPartitions("dim", "tab", "code", "pair")
    found = scratch.save(keyed.mapInPandas(lambda f: _compare(f, n, threshold, packed), f"a {kind}, b {kind}, links bigint"), "found")
    joined = connected_components(found.where("links = 0").select("a", "b"), scratch)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    info = reps.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    info = info.select("vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(info, "vec", "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))
