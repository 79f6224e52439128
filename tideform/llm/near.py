"""Near copies by shingle similarity: lowest shingles bring rows together, exact Jaccard of the shingle sets decides.

Rows meet that share the shingle which hashes lowest, under one of several hashes; a pair of similarity s fails to meet
with probability (1 - s) ** sketches. Two passes over the meetings: the first sees fingerprints only and marks rows that
may have a near copy there; the second reads the texts of those rows and compares their shingle sets. Only the second
makes links. A pair that met under an earlier hash counts there only, so a text seldom travels to more than one meeting.
Large meetings are dealt out as pairs of parts, so no task holds a whole hot one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty
from tideform.llm.components import connected_components
from tideform.llm.exact import bits_for, filter_of, may_contain
from tideform.llm.simhash import _BITS, SEED, _mixed, _shingles

WORDS = 4  # a fingerprint is of 4 x 64 bits
# Fixed value: at similarity 0.8 about 39 bits differ (48 for texts of five shingles), 6 more or less; so no pair is lost.
RADIUS = 80
TILE = 256
PART_ROWS, PART_BYTES = 2048, 16 << 20  # of a meeting, what one task compares with as much again
KEYS = ["block", "value", "pair"]


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles."""
    parts, n = _shingles(text, size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def sketch(text: str, size: int, sketches: int) -> tuple[bytes, int, list[int], list[int]]:
    """Digest and size of the shingle set, its fingerprint, and its lowest hash under each of ``sketches`` hashes."""
    base = shingle_set(text, size)
    n = len(base)
    fp = []
    for k in range(WORDS if n else 0):
        octets = _mixed(base, k).view(np.uint8).reshape(n, 8)
        counts = np.concatenate([np.bincount(octets[:, j], minlength=256) @ _BITS for j in range(8)])
        fp.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0]))
    low = [int(_mixed(base, WORDS + k).min().view(np.int64)) for k in range(sketches if n else 0)]
    return xxhash.xxh3_128_digest(base.tobytes()), n, fp, low


def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[tuple[int, int]]]]:
    """Frames sorted by meeting, cut anew so that each meeting is whole, with where its meetings begin and end."""

    def cut(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
        frame = pd.concat(parts, ignore_index=True)
        key = frame[KEYS].to_numpy()
        at = (np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()
        return frame, [(lo, hi) for lo, hi in zip([0, *at], [*at, len(frame)]) if hi - lo > 1]

    rest: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        key = frame[KEYS].to_numpy()
        still_open = (key == key[-1]).all(1)
        if not still_open.all() or rest and (rest[-1][KEYS].to_numpy()[-1] != key[-1]).any():
            yield cut([*rest, frame[~still_open]])
            rest = []
        rest.append(frame[still_open])
    if rest:
        yield cut(rest)


def _words(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).view(np.uint64)


def may_be_near(fps: np.ndarray, sizes: np.ndarray, side: np.ndarray, similarity: float, earlier: np.ndarray) -> np.ndarray:
    """Which rows of a meeting have another one that their sizes and fingerprints do not rule out.

    ``side`` tells two parts apart, of which only pairs across are compared; a meeting of one part has side 0. ``earlier``
    holds a column for each earlier hash; rows that are equal in one have met there.
    """
    met = earlier[:, 0] if earlier.shape[1] else np.arange(len(fps))
    order = np.lexsort((sizes, met, side))
    f, n, s, e, m = fps[order], sizes[order], side[order], earlier[order], met[order]
    cuts = sorted({0, len(f), *range(0, len(f), TILE), *(np.flatnonzero(np.diff(s)) + 1).tolist()})
    tiles = [(a, b, int(n[a:b].min()), int(n[a:b].max()), m[a] if m[a] == m[b - 1] else None) for a, b in zip(cuts[:-1], cuts[1:])]
    two = bool(s.any())
    out = np.zeros(len(f), bool)
    for i, (a, b, small, large, all_met) in enumerate(tiles):
        for c, d, small_2, large_2, all_met_2 in tiles[i:]:
            if two and s[a] == s[c] or large < similarity * small_2 or large_2 < similarity * small or all_met is not None and all_met == all_met_2:
                continue
            if out[a:b].all() and out[c:d].all():
                continue
            x, y = n[a:b, None], n[None, c:d]
            match = np.minimum(x, y) >= similarity * np.maximum(x, y)
            for k in range(e.shape[1]):
                match &= e[a:b, None, k] != e[None, c:d, k]
            if a == c:
                np.fill_diagonal(match, False)
            if not match.any():
                continue
            dist = sum(np.bitwise_count(f[a:b, None, w] ^ f[None, c:d, w]).astype(np.uint16) for w in range(f.shape[1]))
            match &= dist <= RADIUS
            out[a:b] |= match.any(1)
            out[c:d] |= match.any(0)
    return order[out]


def near_links(texts: list[str], fps: np.ndarray, sizes: np.ndarray, side: np.ndarray, size: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of rows of a meeting whose shingle sets are that similar, as many as keep its components."""
    order = np.argsort(sizes, kind="stable")
    f, n, s = fps[order], sizes[order], side[order]
    two = bool(s.any())
    sets: dict[int, np.ndarray] = {}

    def shingles(x: int) -> np.ndarray:
        if (got := sets.get(x)) is None:
            got = sets[x] = shingle_set(texts[order[x]], size)
        return got

    group = np.arange(len(f))
    out = []
    for x in range(len(f) - 1):
        rest = slice(x + 1, len(f))
        open_ = (n[x] / n[rest] >= similarity) & (group[rest] != group[x])
        if two:
            open_ &= s[rest] != s[x]
        open_ &= np.bitwise_count(f[rest] ^ f[x]).sum(1, dtype=np.int64) <= RADIUS
        for y in (np.flatnonzero(open_) + x + 1).tolist():
            if group[y] != group[x] and similarity_of(shingles(x), shingles(y)) >= similarity:
                group[group == group[y]] = group[x]
                out.append((int(order[x]), int(order[y])))
        sets.pop(x, None)
    return out


def _dealt(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows sorted by meeting. One of p parts becomes p * (p + 1) / 2 pairs of parts; a row goes to the p its part is in."""
    keyed = keyed.join(sizes, ["block", "value"])
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    pair = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own")))
    keyed = keyed.withColumn("own", own).withColumn("pair", F.explode(pair))
    low, high = F.expr("pair div parts"), F.expr("pair % parts")
    keyed = keyed.withColumn("side", ((low != high) & (F.col("own") == high)).cast("int")).drop("own", "parts")
    return keyed.repartition(*KEYS).sortWithinPartitions(*KEYS)


def near_components(docs: DataFrame, size: int = 5, similarity: float = 0.8, sketches: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of rows joined by pairs whose sets of ``size``-word shingles have that Jaccard similarity or more.

    Returns one row per input row: ``(id_col, component_id)``; the component is the smallest identifier reachable by
    such pairs, the row's own included. No pair below the similarity is ever linked; at 0.8, eight sketches let 3 in a
    million of the pairs above it not meet. Equal sets always link, so do texts without words. Null texts count as
    empty; identifiers must be unique and not null (see ``common.numbered``). Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    @F.pandas_udf("digest binary, n int, fp array<bigint>, low array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, size, sketches) for t in texts], columns=["digest", "n", "fp", "low"])

    prints = scratch.save(rows.select("doc_id", F.length("text").alias("chars"), run("text").alias("s")).select("doc_id", "chars", "s.*"), "prints")
    # One row for each set; all values but the identifier and the length follow from the digest.
    reps = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("chars", "doc_id").alias("chars"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("low").alias("low"))
    reps = scratch.save(reps, "reps")

    # Of earlier hashes 32 bits are enough to tell rows apart that did not meet there.
    meeting = F.transform("low", lambda v, i: F.struct(i.alias("block"), v.alias("value"), F.transform(F.slice("low", 1, i), lambda x: F.hash(x)).alias("earlier")))
    keyed = reps.select("rep", "chars", "n", "fp", F.explode(meeting).alias("k")).select("rep", "chars", "n", "fp", "k.*")
    counts = keyed.groupBy("block", "value").agg(F.count("*").alias("rows")).where("rows > 1")
    counts = scratch.save(counts.select("block", "value", F.ceil(F.col("rows") / PART_ROWS).alias("parts")), "counts")

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, runs in _whole(frames):
            if not runs:
                continue
            fps, sizes, side, earlier = _words(frame["fp"]), frame["n"].to_numpy(), frame["side"].to_numpy(), frame["earlier"]
            at = np.concatenate([lo + may_be_near(fps[lo:hi], sizes[lo:hi], side[lo:hi], similarity, np.stack(earlier[lo:hi].to_numpy())) for lo, hi in runs])
            yield frame.iloc[at][["rep", "chars", "n", "fp", "block", "value"]]

    marked = _dealt(keyed, counts).mapInPandas(mark, f"rep {kind}, chars int, n int, fp array<bigint>, block int, value bigint")
    marked = scratch.save(marked.dropDuplicates(["rep", "block", "value"]), "marked")
    loads = marked.groupBy("block", "value").agg(F.count("*").alias("rows"), F.sum("chars").alias("chars"))
    loads = scratch.save(loads.select("block", "value", F.ceil(F.greatest(F.col("rows") / PART_ROWS, F.col("chars") / PART_BYTES, F.lit(1.0))).alias("parts")), "loads")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, runs in _whole(frames):
            if not runs:
                continue
            fps, sizes, side, ids, texts = _words(frame["fp"]), frame["n"].to_numpy(), frame["side"].to_numpy(), frame["rep"].to_numpy(), frame["text"].to_numpy()
            pairs = [(lo + x, lo + y) for lo, hi in runs for x, y in near_links(texts[lo:hi], fps[lo:hi], sizes[lo:hi], side[lo:hi], size, similarity)]
            if pairs:
                a, b = zip(*pairs)
                yield pd.DataFrame({"a": ids[list(a)], "b": ids[list(b)]})

    # Texts that a filter rules out stay where they are; the others travel once to their meetings' list, then to each of them.
    own = marked.groupBy("rep").agg(F.collect_list(F.struct("n", "fp", "block", "value")).alias("meetings"))
    own = scratch.save(own, "own")
    bits = bits_for(own.count())
    known = scratch.save(filter_of(own.select(F.col("rep").alias("digest")), bits), "filter")
    texts = may_contain(rows.withColumnRenamed("doc_id", "digest"), known, bits).where("hit").select(F.col("digest").alias("rep"), "text")
    full = texts.join(own, "rep").select("rep", "text", F.explode("meetings").alias("k")).select("rep", "text", "k.*")
    full = _dealt(full, loads)
    links = scratch.save(full.mapInPandas(link, f"a {kind}, b {kind}"), "links")
    joined = connected_components(links, scratch)
    groups = reps.select("digest", "rep").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    groups = groups.select("digest", F.coalesce("component", "rep").alias("component_id"))
    return prints.select(F.col("doc_id").alias(id_col), "digest").join(groups, "digest", "left").select(id_col, "component_id")
