"""Removal of repeated byte passages by a sparse, range-partitioned suffix array.

A string of LENGTH bytes starts at every position; writing each of those suffixes out would take LENGTH times the corpus.
Instead each window of LENGTH bytes names one of its suffixes, its anchor: the one whose first GRAM bytes hash lowest. Equal
windows name the same anchor, and about one suffix in forty is named. Named suffixes are dealt out in byte order by
splitters, sampled over (first GRAM bytes, hash of all bytes that the anchor's windows cover, document), so that even a
passage that a third of all documents share spreads over buckets. A bucket sorts by multikey quicksort. Neighbours with equal
first bytes, equal cover hash (64 bits) and equal reach are copies of the first. Where neighbours agree in the first bytes
only, and at bucket boundaries, the windows themselves are compared byte by byte, from the text of the first of each kind.
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

LENGTH, GRAM = 100, 32
BUCKET_ROWS = 1_000_000  # suffixes of a bucket aimed at; a task holds one bucket at a time
MAX_BUCKETS, MAX_TASKS = 1_000_000, 20_000  # bound what is sent to tasks (48 bytes a splitter), and how many deal at once
#: Keys that splitters are taken from: so many for each bucket, within bounds, at most SAMPLE_EACH of one document.
SAMPLE_KEYS, SAMPLE_LEAST, SAMPLE_MOST, SAMPLE_EACH = 24, 48_000, 2_000_000, 24
HOT = 20_000  # kinds of one leading string that one task compares; more are compared window by window, dealt by their bytes
SMALL_RUN = 4_096  # rows that quicksort leaves to the library's sort
PIECE = 1 << 19  # bytes worked on at once; fewer than the position mask below allows
_MASK = np.uint64((1 << 20) - 1)
_P = 0x100000001B3
LEADS = [f"lead{k}" for k in range(GRAM // 8)]
ANCHOR = np.dtype([*((n, ">u8") for n in LEADS), ("cover", ">u8"), ("doc", ">u8"), ("pos", ">u4"), ("lo", "u1"), ("hi", "u1")])
KEY = np.dtype([(n, ANCHOR[n]) for n in (*LEADS, "cover", "doc")])


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position (GRAM is a power of two: halves are joined)."""
    h, width, p = b.astype(np.uint64) + np.uint64(1), 1, _P
    while width < GRAM:
        h = h[:-width] * np.uint64(p) + h[width:]
        p = p * p & (2**64 - 1)
        width *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _window_anchors(b: np.ndarray) -> np.ndarray:
    """Anchor of the window from each position: where the lowest gram hash stands, the first of equals."""
    w = LENGTH - GRAM + 1
    h = _gram_hashes(b)
    key = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, w)
    head = np.minimum.accumulate(rows, 1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n = len(b) - LENGTH + 1
    return (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & _MASK).astype(np.int64)


def anchors(ids: list[int], texts: list[bytes]) -> np.ndarray:
    """Anchors of all windows of some documents, as ANCHOR records; lo and hi reach to its first and last window's start."""
    out = []
    group: list[tuple[int, int, bytes]] = []

    def work() -> None:
        whole = b"".join(t for _, _, t in group)
        b = np.frombuffer(whole, np.uint8)
        if len(b) < LENGTH:
            return
        at = _window_anchors(b)
        ends = np.cumsum([len(t) for _, _, t in group])
        owner = np.searchsorted(ends, np.arange(len(at)), side="right")
        fits = np.arange(len(at)) + LENGTH <= ends[owner]  # windows within one document
        start = np.flatnonzero(fits)
        if not len(start):
            return
        a, own = at[start], owner[start]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (own[1:] != own[:-1])]))
        last = np.concatenate([new[1:], [len(a)]]) - 1
        x, first, final, own = a[new], start[new], start[last], own[new]
        rec = np.empty(len(x), ANCHOR)
        lead = np.lib.stride_tricks.sliding_window_view(b, GRAM)[x].view(">u8")
        for k, name in enumerate(LEADS):
            rec[name] = lead[:, k]
        rec["cover"] = [xxhash.xxh3_64_intdigest(whole[i : j + LENGTH]) for i, j in zip(first.tolist(), final.tolist())]
        base = np.concatenate([[0], ends[:-1]])[own]
        rec["doc"] = np.array([d for d, _, _ in group], np.int64)[own].view(np.uint64) ^ np.uint64(1 << 63)  # order of signed numbers
        rec["pos"] = x - base + np.array([o for _, o, _ in group])[own]
        rec["lo"], rec["hi"] = x - first, x - final
        out.append(rec)

    size = 0
    for doc, text in zip(ids, texts):
        for o in range(0, max(1, len(text) - LENGTH + 1), PIECE):  # long texts in pieces that share LENGTH - 1 bytes
            part = text[o : o + PIECE + LENGTH - 1]
            if size + len(part) > PIECE + LENGTH and group:
                work()
                group, size = [], 0
            group.append((doc, o, part))
            size += len(part)
    if group:
        work()
    return np.concatenate(out) if out else np.empty(0, ANCHOR)


def _keys(rec: np.ndarray) -> np.ndarray:
    """Sort keys as byte strings: leading bytes, what is covered, document."""
    out = np.empty(len(rec), KEY)
    for n in KEY.names:
        out[n] = rec[n]
    return out.view(f"S{KEY.itemsize}")


def multikey_sort(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows by their words: quicksort that splits in three by one word, and goes on to the next word among equals.

    Ranges of up to SMALL_RUN rows are left to the library's sort.
    """
    order = np.arange(len(words[0]))
    open_ = [(0, len(order), 0)]
    while open_:
        lo, hi, at = open_.pop()
        if hi - lo < 2 or at == len(words):
            continue
        rows = order[lo:hi]
        if hi - lo <= SMALL_RUN:
            order[lo:hi] = rows[np.lexsort([w[rows] for w in reversed(words[at:])])]
            continue
        word = words[at][rows]
        pivot = np.sort(word[:: max(1, len(word) // 63)])[32]
        less, same = word < pivot, word == pivot
        parts = rows[less], rows[same], rows[~(less | same)]
        order[lo:hi] = np.concatenate(parts)
        a, b = lo + len(parts[0]), hi - len(parts[2])
        open_ += [(lo, a, at), (a, b, at + 1), (b, hi, at)]
    return order


def _dealt(batches: Iterator[pa.RecordBatch], splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        texts = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size < 16 * PIECE):
                size += len(texts[end])
                end += 1
            rec = anchors(ids[at:end], texts[at:end])
            at = end
            if not len(rec):
                continue
            bucket = np.searchsorted(splitters, _keys(rec), side="right") if len(splitters) else np.zeros(len(rec), np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(rec[order], cuts)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][[0, *cuts]], pa.int32()), pa.array([_columns(p) for p in parts], pa.binary())], names=["bucket", "records"])


def _columns(rec: np.ndarray) -> bytes:
    """Records column by column, which the shuffle's compression likes better."""
    return b"".join(rec[n].astype(ANCHOR[n]).tobytes() for n in ANCHOR.names)


def _records(raw: bytes) -> np.ndarray:
    rec, at = np.empty(len(raw) // ANCHOR.itemsize, ANCHOR), 0
    for n in ANCHOR.names:
        size = len(rec) * ANCHOR[n].itemsize
        rec[n] = np.frombuffer(raw, ANCHOR[n], len(rec), at)
        at += size
    return rec


def _sorted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's buckets, one after the other, to runs of windows: removed (kind 0), or to be compared byte by byte (kind 1)."""
    now, raws = None, []
    for frame in frames:
        for bucket, raw in zip(frame["bucket"], frame["records"]):
            if bucket != now and raws:
                yield from _runs(raws)
                raws = []
            now = bucket
            raws.append(raw)
    if raws:
        yield from _runs(raws)


def _runs(raws: list[bytes]) -> Iterator[pd.DataFrame]:
    rec = np.concatenate([_records(r) for r in raws])
    raws.clear()
    native = {n: rec[n].astype(rec[n].dtype.newbyteorder("=")) for n in ANCHOR.names}
    del rec
    order = multikey_sort([native[n] for n in (*LEADS, "cover", "doc", "pos")])
    s = {n: v[order] for n, v in native.items()}
    del native
    leads = np.ones(len(order), bool)
    leads[1:] = np.any([s[n][1:] != s[n][:-1] for n in LEADS], axis=0)
    first = leads.copy()
    for n in ("cover", "lo", "hi"):
        first[1:] |= s[n][1:] != s[n][:-1]
    lead_no = np.cumsum(leads) - 1
    kinds = np.bincount(lead_no[first])
    # The first and the last leading string may go on in another bucket.
    open_ = (kinds > 1)[lead_no] | (lead_no == 0) | (lead_no == lead_no[-1])
    for kind, pick in ((0, ~first), (1, first & open_)):
        p = np.flatnonzero(pick)
        if len(p):
            pos = s["pos"][p].astype(np.int64)
            lead = np.zeros(len(p), np.uint64)
            for n in LEADS if kind else []:  # only brings the strings together; equality is decided by their bytes
                lead = (lead ^ s[n][p]) * np.uint64(_P | 1 << 63)
                lead ^= lead >> np.uint64(29)
            yield pd.DataFrame({
                "doc_id": (s["doc"][p] ^ np.uint64(1 << 63)).view(np.int64), "kind": np.int32(kind), "lead": lead.view(np.int64),
                "first": pos - s["lo"][p], "last": pos - s["hi"][p],
            })


def _covers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes that the windows of each open anchor cover."""
    names = ["lead", "doc_id", "first", "last", "cover"]
    for batch in batches:
        cols = {n: [] for n in names}
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = text.encode("utf-8")
            for s in spans:
                for n, v in zip(names, (s["lead"], doc, s["first"], s["last"], raw[s["first"] : s["last"] + LENGTH])):
                    cols[n].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[n], pa.binary() if n == "cover" else pa.int64()) for n in names], names=names)


def _spans(doc: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
    """Runs of consecutive window starts."""
    i = 0
    while i < len(starts):
        j = i
        while j + 1 < len(starts) and starts[j + 1] == starts[j] + 1:
            j += 1
        yield doc, starts[i], starts[j]
        i = j + 1


class Windows:
    """Windows met so far, by digest, with the bytes they stand in; equal digests are compared byte by byte."""

    def __init__(self) -> None:
        self.at: dict[int, tuple[bytes, int]] = {}

    def met(self, cover: bytes, i: int) -> bool:
        """Whether the window from ``i`` was met before; if not, it is now."""
        window = cover[i : i + LENGTH]
        key = xxhash.xxh3_64_intdigest(window)
        while (known := self.at.get(key)) is not None:
            if known[0][known[1] : known[1] + LENGTH] == window:
                return True
            key += 1  # another window has this digest
        self.at[key] = cover, i
        return False


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames sorted by leading string, document and position: windows that one before holds too."""
    lead, seen = None, Windows()
    for frame in frames:
        out = []
        for key, doc, first, last, cover in zip(*(frame[n] for n in ("lead", "doc_id", "first", "last", "cover"))):
            if key != lead:
                lead, seen = key, Windows()
            out += _spans(doc, [first + i for i in range(last - first + 1) if seen.met(cover, i)])
        yield pd.DataFrame(out, columns=["doc_id", "first", "last"])


def _each_window(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(c[i : i + LENGTH], d, f + i) for d, f, e, c in zip(frame["doc_id"], frame["first"], frame["last"], frame["cover"]) for i in range(e - f + 1)]
        yield pd.DataFrame(rows, columns=["window", "doc_id", "at"])


def repeated_windows(docs: DataFrame, scratch: Scratch, hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, first, last)``: runs of starts of windows that also start earlier. ``docs``: (doc_id bigint, text)."""
    spark = docs.sparkSession
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS, max(tasks, int((size or 0) * 0.03 / bucket_rows) + 1))
    tasks = min(buckets, max(tasks, MAX_TASKS))
    keys = min(SAMPLE_MOST, max(SAMPLE_LEAST, buckets * SAMPLE_KEYS))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys = _keys(anchors([doc], [text.encode("utf-8")]))
                step = max(1, len(keys) // SAMPLE_EACH)
                yield pa.RecordBatch.from_arrays([pa.array([k.ljust(KEY.itemsize, b"\0") for k in keys[::step][:SAMPLE_EACH].tolist()], pa.binary())], names=["key"])

    # Splitters only steer the balance of the buckets; every suffix is dealt out below.
    near = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, keys / SAMPLE_EACH / max(1, n)) * (1 << 30)))
    sample = np.sort(np.array([r[0] for r in near.mapInArrow(picked, "key binary").collect()], f"S{KEY.itemsize}"))
    splitters = np.unique(sample[np.linspace(0, len(sample) - 1, buckets + 1).astype(int)[1:-1]]) if len(sample) else sample
    dealt = docs.mapInArrow(lambda b: _dealt(b, splitters), "bucket int, records binary")
    # A task takes a range of buckets and holds one of them at a time; Spark sorts the packed records and spills.
    dealt = dealt.repartitionById(tasks, F.expr(f"cast(cast(bucket as bigint) * {tasks} div {buckets} as int)")).sortWithinPartitions("bucket")
    runs = dealt.mapInPandas(_sorted, "doc_id bigint, kind int, lead bigint, first bigint, last bigint")
    runs = scratch.save(runs, "runs")
    open_ = runs.where("kind = 1")
    by_doc = open_.groupBy("doc_id").agg(F.collect_list(F.struct("lead", "first", "last")).alias("spans"))  # as many as a document has
    covers = docs.join(by_doc, "doc_id").select("doc_id", "text", "spans").mapInArrow(_covers, "lead bigint, doc_id bigint, first bigint, last bigint, cover binary")
    counts = open_.groupBy("lead").count()
    many = scratch.save(counts.where(F.col("count") > hot).select("lead"), "hot")
    if many.isEmpty():
        few, rest = covers, None
    else:
        covers = scratch.save(covers, "covers")
        few, rest = covers.join(many, "lead", "left_anti"), covers.join(many, "lead", "left_semi")
    found = few.repartition("lead").sortWithinPartitions("lead", "doc_id", "first").mapInPandas(_compared, "doc_id bigint, first bigint, last bigint")
    if rest is not None:
        windows = scratch.save(rest.mapInPandas(_each_window, "window binary, doc_id bigint, at bigint"), "windows")
        least = windows.groupBy("window").agg(F.min("doc_id").alias("least"))
        here = windows.join(least, "window")
        low = here.where("doc_id = least").groupBy("window").agg(F.min("at").alias("low"))
        late = here.join(low, "window").where("doc_id > least or at > low")
        found = found.unionByName(late.select("doc_id", F.col("at").alias("first"), F.col("at").alias("last")))
    found = scratch.save(found, "compared")
    return runs.where("kind = 0").select("doc_id", "first", "last").unionByName(found)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        ids, texts, firsts, lasts = (batch.column(i) for i in range(4))
        cols: dict[str, list] = {n: [] for n in names}
        for i, text in enumerate(texts.to_pylist()):
            raw = text.encode("utf-8")
            kept, removed, spans = [raw], 0, 0
            if firsts[i].is_valid:
                f, e = firsts[i].values.to_numpy(), lasts[i].values.to_numpy() + LENGTH
                order = np.argsort(f, kind="stable")
                f, e = f[order], np.maximum.accumulate(e[order])
                new = np.flatnonzero(np.concatenate([[True], f[1:] > e[:-1]]))  # touching runs are one
                starts, ends = f[new].tolist(), e[np.concatenate([new[1:], [len(f)]]) - 1].tolist()
                kept = [raw[a:b] for a, b in zip([0, *ends], [*starts, len(raw)])]
                removed, spans = sum(ends) - sum(starts), len(starts)
            for n, v in zip(names, (len(raw), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest())):
                cols[n].append(v)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(cols[n], pa.string() if n == "kept_sha256" else pa.int64()) for n in names)], names=["id", *names])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Remove each byte covered by a string of LENGTH bytes that also starts earlier.

    Texts are UTF-8 bytes (null: empty); earlier means a smaller identifier, or an earlier start in the same document;
    strings are judged on the input and never cross documents. Returns one row per input row:
    ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)``. Each row is a document of its own, also where identifiers
    repeat or are missing: rows without one come before all others, and rows that share one are in the order of their
    texts, so of two equal rows one is kept whole. Extra columns are ignored; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = numbered(docs, id_col, text_col, scratch, [F.col(id_col).alias("id")], nulls_first=True).withColumnRenamed("key", "doc_id")
    found = repeated_windows(rows.select("doc_id", "text"), scratch, hot, bucket_rows)
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("s")).select("doc_id", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"))
    joined = rows.join(spans, "doc_id", "left").select("id", "text", "firsts", "lasts")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_cut, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string").withColumnRenamed("id", id_col)
