"""Removal of repeated word passages by seed and extend.

Seeds are winnowed: of the strings of GRAM words inside each window of ``length`` words the one that hashes lowest is that
window's anchor, so equal windows have the same anchor at the same place, and one word in some fifteen is an anchor.
Documents are joined on anchors. An anchor that occurs once has no repeat around it. Occurrences whose windows cover the
same words (a digest of 128 bits tells) are copies as they stand and need no text. For the others one occurrence of each
kind is extended, word by word to both sides, all kinds of an anchor at once: kinds that agree so far form a class, which
splits where their words differ. Windows that lie in one class are repeated; consecutive ones are a maximal repeat.
Anchors with very many kinds are not extended in one task: their windows are counted by digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, numbered

LENGTH, GRAM = 35, 8
HOT = 5_000  # kinds of one anchor that one task extends together
PIECE = 1 << 17  # words worked on at once
STEP = 256  # texts taken from a batch at once
BATCH = 20_000  # kinds extended at once, and the rest of the last anchor's
_MASK = np.uint64((1 << 18) - 1)  # takes the place of a word within a piece
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but ASCII white space."""
    return text.encode("utf-8").split()


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, _BASE)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * n, np.uint64(_inverse(int(_BASE))))]), dtype=np.uint64)
        return self.up, self.down


_POWERS = Powers()


def _anchors_of(group: list[tuple[int, int, list[bytes]]], length: int, gram: int) -> pd.DataFrame | None:
    """Anchors of some documents: their words are laid end to end, and windows lie within one document."""
    sizes = np.array([len(w) for _, _, w in group])
    whole = b" ".join(b" ".join(w) for _, _, w in group)
    b = np.frombuffer(whole, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    n = len(starts)
    if n < length:
        return None
    up, down = _POWERS.get(len(b) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], dtype=np.uint64)])
    h = _spread((total[ends[gram - 1 :]] - total[starts[: n - gram + 1]]) * down[starts[: n - gram + 1]])
    w = length - gram + 1
    key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    rows = np.concatenate([key, np.full(-len(key) % w, ~np.uint64(0))]).reshape(-1, w)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    m = n - length + 1
    at = (np.minimum(tail[:m], head[w - 1 : w - 1 + m]) & _MASK).astype(np.int64)
    bounds = np.cumsum(sizes)
    owner = np.searchsorted(bounds, np.arange(m), side="right")
    start = np.flatnonzero(np.arange(m) + length <= bounds[owner])
    if not len(start):
        return None
    a, own = at[start], owner[start]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:] != own[:-1])]))
    x, first, last, own = a[new], start[new], start[np.concatenate([new[1:], [len(a)]]) - 1], own[new]
    cover = np.frombuffer(b"".join(xxhash.xxh3_128_digest(whole[i:j]) for i, j in zip(starts[first].tolist(), ends[last + length - 1].tolist())), "<i8").reshape(-1, 2)
    base = (bounds - sizes)[own] - np.array([o for _, o, _ in group])[own]
    return pd.DataFrame({"gram": h[x].view(np.int64), "c1": cover[:, 0], "c2": cover[:, 1], "lo": (x - first).astype(np.int32), "hi": (x - last).astype(np.int32),
                         "key": np.array([k for k, _, _ in group], np.int64)[own], "at": x - base})


def anchors(keys: list[int], texts: list[str], length: int = LENGTH, gram: int = GRAM) -> Iterator[pd.DataFrame]:
    """Anchors of all windows: their hash, the digest of the words that their windows cover, how many words before the
    anchor the first and the last of these windows begin, and where it stands."""
    group: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for key, text in zip(keys, texts):
        words = words_of(text)
        for o in range(0, len(words) - length + 1, PIECE):  # long texts in pieces that share all windows' words
            part = words[o : o + PIECE + length - 1]
            if group and size + len(part) > PIECE + length:
                if (out := _anchors_of(group, length, gram)) is not None:
                    yield out
                group, size = [], 0
            group.append((key, o, part))
            size += len(part)
    if group and (out := _anchors_of(group, length, gram)) is not None:
        yield out


def _covers(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The words that the windows of each open anchor cover, joined by spaces."""
    for batch in batches:
        cols: dict[str, list] = {n: [] for n in ("gram", "key", "at", "lo", "hi", "n", "cover")}
        for key, text, spots in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = words_of(text)
            for s in spots:
                at, lo, hi = s["at"], s["lo"], s["hi"]
                for name, v in zip(cols, (s["gram"], key, at, lo, hi, s["n"], b" ".join(words[at - lo : at - hi + length]))):
                    cols[name].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(cols.values(), kinds)], names=list(cols))


def _split(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes after one more word: those of equal class and word stay together."""
    return np.unique(classes * (words.max(initial=0) + 1) + words, return_inverse=True)[1]


def extended(gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, covers: list[bytes], length: int) -> np.ndarray:
    """Which windows of each kind stand in another kind of its anchor too: rows x (words from the window's start to the anchor).

    Kinds are extended to the left from the word before the anchor and to the right from the anchor's first word; a window
    is shared where both extensions reach its ends.
    """
    split = [c.split(b" ") for c in covers]
    sizes = np.array([len(s) for s in split])
    base = np.cumsum(sizes) - sizes
    flat = pd.factorize(pd.Series([w for s in split for w in s], dtype=object))[0] + 1
    anchor = base + lo
    rows = len(gram)
    start = np.unique(gram, return_inverse=True)[1]
    most = int(lo.max())
    left, right = [start], [start]
    for k in range(1, most + 1):  # words that lie outside a kind's cover are classes of their own and never met
        inside = k <= lo
        word = np.where(inside, flat[np.where(inside, anchor - k, 0)], 0)
        left.append(_split(left[-1], word))
    reach = sizes - lo
    for k in range(1, length - int(hi.min()) + 1):
        inside = k <= reach
        word = np.where(inside, flat[np.where(inside, anchor + k - 1, 0)], 0)
        right.append(_split(right[-1], word))
    out = np.zeros((rows, most + 1), bool)
    for o in range(most + 1):
        here = np.flatnonzero((hi <= o) & (o <= lo))
        if len(here) > 1:
            pair = left[o][here] * (rows + 1) + right[length - o][here]
            _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
            out[here, o] = count[inverse] > 1
    return out


def _repeats(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Frames sorted by anchor to maximal repeats of the kinds that occur once: (key, first, last) window."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        lo, hi = frame["lo"].to_numpy().astype(np.int64), frame["hi"].to_numpy().astype(np.int64)
        met = extended(frame["gram"].to_numpy(), lo, hi, frame["cover"].tolist(), length) & (frame["n"].to_numpy() == 1)[:, None]
        # Column o is the window that begins o words before the anchor: runs go from high to low o.
        edge = np.diff(np.pad(met[:, ::-1], ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edge == 1)
        z = np.nonzero(edge == -1)[1]
        begin = frame["at"].to_numpy()[row] - (met.shape[1] - 1)
        return pd.DataFrame({"key": frame["key"].to_numpy()[row], "first": begin + a, "last": begin + z - 1})

    rest: list[pd.DataFrame] = []
    for frame in frames:
        rest.append(frame)
        if sum(map(len, rest)) >= BATCH:
            whole = pd.concat(rest, ignore_index=True)
            open_ = whole["gram"] == whole["gram"].iloc[-1]
            if not open_.all():
                yield work(whole[~open_])
                rest = [whole[open_]]
    if rest and sum(map(len, rest)):
        yield work(pd.concat(rest, ignore_index=True))


def _each_window(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for key, at, lo, hi, n, cover in zip(*(frame[c] for c in ("key", "at", "lo", "hi", "n", "cover"))):
            words = cover.split(b" ")
            for i in range(lo - hi + 1):
                d = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + length]))
                out.append(((d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63, key, at - lo + i, n))
        yield pd.DataFrame(out, columns=["d1", "d2", "key", "at", "n"])


def repeated_windows(rows: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(key, first, last)``: runs of windows, by the number of their first word, whose words also stand elsewhere. ``rows``: (key, text)."""

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                for out in anchors(part.column(0).to_pylist(), part.column(1).to_pylist(), length, gram):
                    yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    found = scratch.save(rows.mapInArrow(seeds, "gram bigint, c1 bigint, c2 bigint, lo int, hi int, key bigint, at bigint"), "seeds")
    # Counts are written before they are joined: Spark can then split the large groups of a join, which nothing needs together.
    twice = scratch.save(found.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1").select("gram"), "twice")
    shared = scratch.save(found.join(twice, "gram", "left_semi"), "shared")
    kind = ["gram", "c1", "c2", "lo", "hi"]
    kinds = shared.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    kinds = scratch.save(kinds.select(*kind, "n", "one.key", "one.at"), "kinds")
    copies = shared.join(kinds.where("n > 1").select(*kind), kind, "left_semi").select("key", (F.col("at") - F.col("lo")).alias("first"), (F.col("at") - F.col("hi")).alias("last"))
    open_ = kinds.groupBy("gram").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1")
    open_ = scratch.save(open_.select("gram", "kinds"), "anchors")
    met = kinds.join(open_, "gram").select("key", F.struct("gram", "at", "lo", "hi", "n").alias("s"), "kinds")
    met = scratch.save(met, "open")
    by_doc = met.groupBy("key").agg(F.collect_list("s").alias("spots"))  # as many as a document has
    covers = rows.join(by_doc, "key").select("key", "text", "spots").mapInArrow(lambda b: _covers(b, length), "gram bigint, key bigint, at bigint, lo int, hi int, n bigint, cover binary")
    many = scratch.save(met.where(F.col("kinds") > hot).select("s.gram").distinct(), "hot")
    if many.isEmpty():
        few, rest = covers, None
    else:
        covers = scratch.save(covers, "covers")
        few, rest = covers.join(many, "gram", "left_anti"), covers.join(many, "gram", "left_semi")
    few = few.repartition("gram").sortWithinPartitions("gram").mapInPandas(lambda f: _repeats(f, length), "key bigint, first bigint, last bigint")
    out = copies.unionByName(few)
    if rest is not None:
        windows = scratch.save(rest.mapInPandas(lambda f: _each_window(f, length), "d1 bigint, d2 bigint, key bigint, at bigint, n bigint"), "windows")
        again = scratch.save(windows.groupBy("d1", "d2").agg(F.sum("n").alias("times")).where("times > 1").select("d1", "d2"), "again")
        hits = windows.where("n = 1").join(again, ["d1", "d2"], "left_semi")
        out = out.unionByName(hits.select("key", F.col("at").alias("first"), F.col("at").alias("last")))
    return out


def _without(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digests = [], [], []
        for text, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            words = words_of(text)
            n = len(words)
            gone = 0
            if firsts:
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, np.array(firsts), 1)
                np.add.at(edge, np.array(lasts) + length, -1)
                keep = np.cumsum(edge)[:n] == 0
                gone = n - int(keep.sum())
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            total.append(n), removed.append(gone), digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["id", "n_words", "n_removed", "kept_sha256"])


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Remove each word covered by a window of ``length`` words whose words also stand anywhere else, all copies alike.

    Words are maximal runs of anything but ASCII white space, compared byte by byte; windows never cross documents and are
    judged on the input. Returns one row per input row: ``(doc_id, n_words, n_removed, kept_sha256)``, the digest of the
    kept words joined by one space. Null texts have no words. Rows are documents of their own even where identifiers
    repeat or are missing, so such rows with equal texts are copies. Extra columns are ignored; an empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    rows = numbered(docs, id_col, text_col, scratch, [F.col(id_col).alias("id")])
    found = repeated_windows(rows.select("key", "text"), scratch, length, gram, hot)
    spans = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("s")).select("key", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"))
    joined = rows.join(spans, "key", "left").select("id", "text", "firsts", "lasts")
    kind = docs.schema[id_col].dataType.simpleString()
    out = joined.mapInArrow(lambda b: _without(b, length), f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
