"""SimHash near-duplicates: fingerprints of word shingles, compared exactly in tiles by exclusive-or and bit counts.

Where the radius is small, fingerprints within it agree in some of their bit blocks, so only rows that share a choice of
blocks meet; the more rows, the more and wider choices. Where it is large, rows meet that share the shingle which hashes
lowest, under one of several hashes: texts of similarity s do so with probability 1 - (1 - s) ** sketches. Either way rows
meet in runs; a run is cut into tiles ordered by bit count, and tile pairs whose counts differ beyond the radius are skipped.
Runs longer than a bound are dealt out as pairs of parts, so no task holds a whole hot run.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty
from tideform.llm.components import connected_components

SEED = 42
TILE = 256
ROWS_EACH = 64  # rows that may meet by chance under one value of a mask, on average
PART = 2048  # rows of a run that one task compares with as many others
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _shingles(text: str, size: int) -> tuple[Iterator[bytes], int]:
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and split at \x20 and \x09-\x0D only
    if not words:
        return iter(()), 0
    if len(words) < size:
        return iter((b" ".join(words),)), 1
    return map(b" ".join, zip(*(words[i:] for i in range(size)))), len(words) - size + 1


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Word k of a longer fingerprint comes from the same hashes, mixed anew (multiply and shift)."""
    if k == 0:
        return h
    h = (h ^ (h >> np.uint64(32))) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprint(text: str, size: int, words: int = 1, sketches: int = 0) -> tuple[list[int], list[int]]:
    """Fingerprint of ``words`` x 64 bits (repeats count), and the lowest shingle hash under each of ``sketches`` hashes."""
    parts, n = _shingles(text, size)
    if not n:
        return [0] * words, [0] * sketches
    base = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)
    out = []
    for k in range(words):
        octets = _mixed(base, k).view(np.uint8).reshape(n, 8)
        if n < 400:
            counts = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0]))
    return out, [int(_mixed(base, words + k).min()) for k in range(sketches)]


def fingerprints(docs: DataFrame, size: int = 3, words: int = 1, sketches: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp array<bigint>, low array<bigint>)`` per row; null texts count as empty, whose fingerprint is zero."""

    def signed(x: list[int]) -> list[int]:
        return np.array(x, np.uint64).view(np.int64).tolist()

    @F.pandas_udf("fp array<bigint>, low array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        got = [fingerprint(t, size, words, sketches) for t in texts]
        return pd.DataFrame({"fp": [signed(f) for f, _ in got], "low": [signed(m) for _, m in got]})

    return docs.select(F.col(id_col).alias("doc_id"), run(text_or_empty(text_col)).alias("s")).select("doc_id", "s.*")


def _roots(match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest left row that each left and right row of a bipartite match reaches; the width where it reaches none."""
    n, m = match.shape
    left, right = np.arange(n), np.full(m, n)
    while True:
        right = np.where(match, left[:, None], n).min(0, initial=n)
        new = np.minimum(left, np.where(match, right[None, :], n).min(1, initial=n))
        if (new == left).all():
            return left, right
        left = new


def tile_links(fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of one run that keep its components: pairs of row numbers, fewer than there are rows.

    ``fps`` is rows x words. ``side`` tells two parts of a run apart: each met itself elsewhere, and only pairs across are
    compared; a run of one part has side 0.
    """
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pops = np.bitwise_count(fps).sum(1, dtype=np.int64)
    order = np.lexsort((pops, side))
    f, p, s = fps[order], pops[order], side[order]
    cuts = sorted({0, len(f), *range(0, len(f), TILE), *(np.flatnonzero(np.diff(s)) + 1).tolist()})
    tiles = list(zip(cuts[:-1], cuts[1:]))
    two = bool(s.any())
    out = []
    for i, (a, b) in enumerate(tiles):
        for c, d in tiles[i:]:
            if two and s[a] == s[c]:
                continue
            if p[c] - p[b - 1] > radius or p[a] - p[d - 1] > radius:
                continue  # bit counts further apart than the radius
            dist = np.bitwise_count(f[a:b, None, 0] ^ f[None, c:d, 0]).astype(np.uint16)
            for w in range(1, f.shape[1]):
                dist += np.bitwise_count(f[a:b, None, w] ^ f[None, c:d, w])
            match = dist <= radius
            if a == c:
                if int(match.sum()) == b - a:
                    continue
            elif not match.any():
                continue
            left, right = _roots(match)
            pairs = [(a + x, a + y) for x, y in enumerate(left.tolist()) if x != y]
            pairs += [(c + x, a + y) for x, y in enumerate(right.tolist()) if y < b - a]
            for x, y in pairs:
                u, v = root(x), root(y)
                if u != v:
                    parent[u] = v
                    out.append((int(order[x]), int(order[y])))
    return out


def _runs(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by run to links; a run may go on into the next frame, and is at most two parts long."""
    rest: list[pd.DataFrame] = []

    def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(frame) < 2:
            return
        key = frame[["block", "value", "pair"]].to_numpy()
        at = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        fps = np.stack(frame["fp"].to_numpy()).astype(np.int64).view(np.uint64)
        side, a, b = frame["side"].to_numpy(), [], []
        for lo, hi in zip([0, *at], [*at, len(frame)]):
            if hi - lo > 1:
                for x, y in tile_links(fps[lo:hi], side[lo:hi], radius):
                    a.append(lo + x)
                    b.append(lo + y)
        if a:
            ids = frame["rep"].to_numpy()
            yield pd.DataFrame({"a": ids[a], "b": ids[b]})

    for frame in frames:
        if not len(frame):
            continue
        last = frame.iloc[-1]
        open_ = (frame["block"] == last["block"]) & (frame["value"] == last["value"]) & (frame["pair"] == last["pair"])
        n = int((~open_).sum())
        if n or (rest and tuple(rest[-1][["block", "value", "pair"]].iloc[-1]) != tuple(last[["block", "value", "pair"]])):
            yield from done(pd.concat([*rest, frame.iloc[:n]]))
            rest = []
        rest.append(frame.iloc[n:])
    if rest:
        yield from done(pd.concat(rest))


def block_masks(radius: int, rows: int, bits: int = 64) -> list[int]:
    """Bit masks of which two fingerprints within the radius agree on one at least.

    Of m blocks of bits, ``radius`` differing bits leave m - radius alike, so each choice of so many is a mask. More rows
    get more blocks, and masks so wide that few unlike rows meet under one.
    """
    blocks = radius + 1
    while rows > ROWS_EACH << (bits * (blocks - radius) // blocks) and blocks < bits:
        blocks += 1
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in itertools.combinations(own, blocks - radius)]


def fingerprint_links(reps: DataFrame, radius: int, scratch: Scratch, sketches: int = 0, rows: int = 0) -> DataFrame:
    """Links ``(a, b)`` between representatives whose fingerprints differ in at most ``radius`` bits.

    ``reps``: (rep, fp, low), fingerprints distinct, so many ``rows`` of them. Returns links that keep every component (not each pair). With
    ``sketches`` rows meet by their lowest shingles instead of by bit blocks.
    """
    if sketches:
        keys = F.transform("low", lambda v, i: F.struct(i.alias("block"), v.alias("value")))
    else:
        masks = np.array(block_masks(radius, rows), np.uint64).view(np.int64).tolist()
        keys = F.array(*[F.struct(F.lit(i).alias("block"), F.element_at("fp", 1).bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    keyed = reps.select("rep", "fp", F.explode(keys).alias("k")).select("rep", "fp", "k.*")
    sizes = reps.select(F.explode(keys).alias("k")).groupBy("k.block", "k.value").count().where("count > 1")
    sizes = scratch.save(sizes.select("block", "value", F.ceil(F.col("count") / PART).alias("parts")), "sizes")
    keyed = keyed.join(sizes, ["block", "value"])
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    # A run of p parts becomes p * (p + 1) / 2 pairs of parts; a row goes to the p pairs that its part is in.
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    keyed = keyed.withColumn("own", own).withColumn("pair", F.explode(pair))
    low, high = F.expr("pair div parts"), F.expr("pair % parts")
    side = ((low != high) & (F.col("own") == high)).cast("int")
    keyed = keyed.select("rep", "fp", "block", "value", "pair", side.alias("side"))
    rows = keyed.repartition("block", "value", "pair").sortWithinPartitions("block", "value", "pair")
    return rows.mapInPandas(lambda frames: _runs(frames, radius), reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).schema)


def simhash_components(docs: DataFrame, size: int = 5, words: int = 4, radius: int = 40, sketches: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups.

    Returns one row per input row: ``(id_col, fp array<bigint>, component_id)``; the component is the smallest
    identifier reachable by links, the row's own included. Null texts count as empty; texts without words have a zero
    fingerprint and link like any other. Equal fingerprints always link. A repeated identifier
    keeps its rows, each in the group of its own fingerprint. Rows without identifier belong to the group of their
    fingerprint like others and never name it: a group of such rows only has a null component, and a fingerprint that
    only they have makes no links to other fingerprints. Empty tables give empty
    results; extra columns are ignored.

    The radius bounds differing bits, which follow similarity only roughly: at a shingle similarity of 0.8 about 38.8 of
    256 bits differ, give or take six. Where similarity itself decides, see ``near``. Without sketches every pair within the
    radius is found.
    """
    if not sketches and words != 1:
        raise ValueError("bit blocks are cut from one word; longer fingerprints need sketches")
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs, size, words, sketches, id_col, text_col), "prints")
    reps = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.min("low").alias("low"))
    reps = scratch.save(reps, "reps")
    links = fingerprint_links(reps.select("rep", "fp", "low"), radius, scratch, sketches, reps.count())
    joined = connected_components(scratch.save(links, "links"), scratch)
    groups = reps.select("fp", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = scratch.save(groups.select("fp", F.coalesce("component", "rep").alias("component_id")), "groups")
    return prints.select(F.col("doc_id").alias(id_col), "fp").join(groups, "fp", "left").select(id_col, "fp", "component_id")
