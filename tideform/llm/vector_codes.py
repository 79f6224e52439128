"""Vector code compression: a codebook for each part of the vectors, trained by Yinyang Lloyd in whole numbers.

Codebook entries are clustered into groups. Each vector keeps, for each part, an upper bound of the distance to its entry
and one lower bound for each group; after a round the bounds move by how far the entries did (a group by its furthest).
Only groups whose lower bound does not stay above the upper one are scanned, with exact integer distances, and ties go to
the lower index. The vectors travel nowhere: a round is one pass that writes the next state, and one that sums by entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideform.llm.common import Scratch
from tideform.llm.whitening import finite, matrix

SCALE = 1024
GROUP = 20  # entries of a group on average
EXACT = 1 << 52  # sums of products up to here are exact in double precision
SLICE = 1 << 19  # entries worked on at once
FAR = np.float32(np.inf)


def _groups(book: np.ndarray) -> np.ndarray:
    """Group number of each entry: a few rounds of Lloyd's algorithm over the entries themselves."""
    k = max(1, len(book) // GROUP)
    points = book.astype(np.float64)
    centres = [points[0]]
    while len(centres) < k:  # the entry furthest from those chosen
        centres.append(points[np.min([((points - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    centres = np.array(centres)
    for _ in range(5):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(own):
            centres[g] = points[own == g].mean(0)
    return np.unique(own, return_inverse=True)[1]


class Book:
    """One part's entries, their groups, and how far they came in the last round."""

    def __init__(self, entries: np.ndarray, groups: np.ndarray | None = None, before: np.ndarray | None = None) -> None:
        self.entries = entries
        self.own = _groups(entries) if groups is None else groups
        self.members = [np.flatnonzero(self.own == g) for g in range(int(self.own.max()) + 1)]
        self.largest = int(max(abs(int(v)) for v in entries.ravel())) if entries.size else 0
        moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(1))
        self.drift = moved * (1 + 1e-12)
        self.drifts = np.array([self.drift[m].max() for m in self.members])

    def safe(self, x: np.ndarray) -> bool:
        """Whether double precision holds every squared distance exactly."""
        most = max(self.largest, int(np.abs(x).max(initial=0)))
        return 4 * max(1, x.shape[1]) * most * most < EXACT

    def distances(self, x: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Squared distances of rows to some entries, exact: rows x entries."""
        c = self.entries[some]
        if self.safe(x):
            a, b = x.astype(np.float64), c.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
        a, b = x.astype(object), c.astype(object)
        return np.stack([((a - e) ** 2).sum(1) for e in b], axis=1)

    def to_entries(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Squared distance of each row to its entry, exact."""
        gap = x - self.entries[entry] if self.safe(x) else x.astype(object) - self.entries[entry].astype(object)
        return (gap * gap).sum(1)


def assign(x: np.ndarray, book: Book, entry: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entry of each row (ties: the lowest index), new bounds, and how many distances were computed.

    ``entry``, ``upper`` and ``lower`` (rows x groups) are those of the round before, none in the first.
    """
    n, t = len(x), len(book.members)
    if not book.safe(x):  # numbers too large for bounds in single precision: compare with every entry
        d = book.distances(x, np.arange(len(book.entries)))
        return d.argmin(1).astype(np.uint16), np.full(n, FAR), np.zeros((n, t), np.float32), d.size
    first = entry is None
    if first:
        entry, lower, old = np.zeros(n, np.int64), np.zeros((n, t), np.float32), None
        open_ = np.ones(n, bool)
        best = np.full(n, np.iinfo(np.int64).max)
    else:
        entry = entry.astype(np.int64)
        loose = upper.astype(np.float64) + book.drift[entry]
        low = np.maximum(0, lower.astype(np.float64) - book.drifts[None])
        lower = np.nextafter(low.astype(np.float32), np.float32(-1))
        open_ = lower.min(1) <= loose  # else no group can hold a nearer entry, nor an equal one
        upper = np.nextafter(loose.astype(np.float32), FAR)
        best = np.zeros(n, np.int64)
        best[open_] = book.to_entries(x[open_], entry[open_])
        old = entry.copy()
    at = np.flatnonzero(open_)
    if not len(at):
        return entry, upper, lower, 0
    sure = np.sqrt(best[at].astype(np.float64)) * (1 + 1e-9) + 1e-6
    scan = np.ones((len(at), t), bool) if first else lower[at] <= sure[:, None]
    key = best[at].copy()  # squared distance, then index, of the nearest so far
    who = entry[at].copy()
    if first:
        who[:] = len(book.entries)
    cost = 0 if first else len(at)
    least = lower[at].astype(np.float64)
    nearest, second = np.zeros((len(at), t), np.int64), np.full((len(at), t), np.inf)
    for g, members in enumerate(book.members):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        d = book.distances(x[at[rows]], members)
        cost += d.size
        near = d.argmin(1)
        mine = d[np.arange(len(rows)), near]
        nearest[rows, g] = members[near]
        least[rows, g] = np.sqrt(mine.astype(np.float64))
        if len(members) > 1:
            second[rows, g] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
        better = (mine < key[rows]) | (mine == key[rows]) & (members[near] < who[rows])
        key[rows] = np.where(better, mine, key[rows])
        who[rows] = np.where(better, members[near], who[rows])
    # A group's bound leaves out the row's own entry: where that is the group's nearest, the second nearest counts.
    row = np.arange(len(at))
    g = book.own[who]
    own = scan[row, g] & (nearest[row, g] == who)
    least[row[own], g[own]] = second[row[own], g[own]]
    if old is not None:  # the entry that a row left counts in its group again
        left = np.flatnonzero(who != old[at])
        was = book.own[old[at[left]]]
        least[left, was] = np.minimum(least[left, was], np.sqrt(best[at[left]].astype(np.float64)))
    lower = lower.copy()
    lower[at] = np.nextafter((least * (1 - 1e-9)).astype(np.float32), np.float32(-1))
    upper = np.zeros(n, np.float32) if first else upper
    upper[at] = np.nextafter((np.sqrt(key.astype(np.float64)) * (1 + 1e-9)).astype(np.float32), FAR)
    entry[at] = who
    return entry, upper, lower, cost


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """The parts of the vectors, equal in length: zeros fill up the last one."""
    pad = -x.shape[1] % parts
    return np.split(np.concatenate([x, np.zeros((len(x), pad), x.dtype)], axis=1) if pad else x, parts, axis=1)


STATE = "id {kind}, label {label}, x array<bigint>, entries binary, uppers binary, lowers binary"


def _step(batches: Iterator[pa.RecordBatch], dim: int, books: list[Book]) -> Iterator[pa.RecordBatch]:
    """State of one round to that of the next: columns (id, label, x) and, but for the first round, the bounds."""
    step = max(1, SLICE // (dim + 64))
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            x, n = matrix(batch.column(2), dim), batch.num_rows
            entries, uppers, lowers = [], [], []
            if batch.num_columns > 3:
                entry = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(n, -1)
                upper = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<f4").reshape(n, -1)
                lower = np.frombuffer(b"".join(batch.column(5).to_pylist()), "<f4").reshape(n, -1)
            at_group = 0
            for p, (part, book) in enumerate(zip(_cut(x, len(books)), books)):
                t = len(book.members)
                known = (entry[:, p], upper[:, p], lower[:, at_group : at_group + t]) if batch.num_columns > 3 else (None,) * 3
                e, u, low, _ = assign(part, book, *known)
                at_group += t
                entries.append(e), uppers.append(u), lowers.append(low)
            packed = [[r.tobytes() for r in a] for a in (np.stack(entries, 1).astype("<u2"), np.stack(uppers, 1).astype("<f4"), np.concatenate(lowers, 1).astype("<f4"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(v, pa.binary()) for v in packed)], names=["id", "label", "x", "entries", "uppers", "lowers"])


def _sums(batches: Iterator[pa.RecordBatch], dim: int, parts: int, size: int) -> Iterator[pa.RecordBatch]:
    """Counts and sums of the rows of each entry that a task meets: one row for each part and entry at most."""
    width = -(-dim // parts)
    total = np.zeros((parts, size, width + 1), object)
    for batch in batches:
        x = matrix(batch.column(0), dim)
        entry = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(x), parts)
        for p, part in enumerate(_cut(x, parts)):
            order = np.argsort(entry[:, p], kind="stable")
            own, at = np.unique(entry[order, p], return_index=True)
            total[p, own, 1:] += np.add.reduceat(part[order], at, axis=0).astype(object)
            total[p, own, 0] += np.diff([*at, len(x)]).astype(object)
    p, e = np.nonzero(total[:, :, 0])
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "v"])


def _one_length(rows: DataFrame, dim: int, parts: int, size: int, rounds: int, scratch: Scratch) -> DataFrame:
    """``(id, label, code, error, codebooks_sha256)`` of the rows of one length."""
    name = f"state-{dim}-"
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(size).select("x").collect()  # one row for each entry
    books = [Book(p) for p in _cut(np.array([r["x"] for r in first], np.int64), parts)]
    schema = STATE.format(**{c: rows.schema[n].dataType.simpleString() for c, n in (("kind", "id"), ("label", "label"))})
    state = rows
    for k in range(rounds):
        state = scratch.save(state.mapInArrow(lambda b, books=books: _step(b, dim, books), schema), f"{name}{k}")
        if k:
            scratch.drop(f"{name}{k - 1}")
        sums = state.select("x", "entries").mapInArrow(lambda b: _sums(b, dim, parts, size), "part int, entry int, v array<bigint>")
        width = books[0].entries.shape[1] + 1
        total = sums.groupBy("part", "entry").agg(*[F.sum(F.col("v")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)])
        new = [b.entries.copy() for b in books]
        for r in total.collect():  # one row for each entry of the codebooks
            new[r["part"]][r["entry"]] = [int(s) // int(r["s0"]) for s in r[3:]]
        books = [Book(n, b.own, b.entries) for n, b in zip(new, books)]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b.entries.tolist() for v in e).encode()).hexdigest()
    digits = max(2, len(f"{size - 1:x}"))

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _step(batches, dim, books):
            x, n = matrix(batch.column(2), dim), batch.num_rows
            entry = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(n, parts)
            error = sum(b.to_entries(p, entry[:, k]).astype(object) for k, (p, b) in enumerate(zip(_cut(x, parts), books)))
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in entry.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(codes), pa.array([v if v < 1 << 63 else None for v in error], pa.int64())], names=["id", "label", "code", "error"])

    kinds = schema.split(", x ")[0]
    return state.mapInArrow(final, f"{kinds}, code string, error bigint").withColumn("codebooks_sha256", F.lit(digest))


def vector_codes(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Vectors as short codes: for each part the number of the nearest entry of its codebook.

    Components become floor(SCALE * x); a vector is cut into ``parts`` of equal length (zeros fill up a length that does not
    divide). A codebook starts as that part of the vectors with the ``entries`` smallest identifiers (missing ones last, ties
    by the vector); each of ``rounds`` rounds assigns parts to nearest entries and makes each entry the floor of its parts'
    mean. Returns one row per kept row: ``(id_col, code, error, label_error, codebooks_sha256)``; the error is the sum of
    squared distances (null where no long takes it), label_error its sum over rows of equal label (null labels together).
    Rows whose vector is null or empty, or holds a null, a NaN, an infinite component or one of 2^30 and more, are dropped.
    Vectors of different lengths have codebooks of their own. Fewer rows than entries make shorter codebooks. Extra columns
    are ignored; an empty table gives an empty result.
    """
    if not 1 <= entries <= 1 << 16:
        raise ValueError(f"entries: {entries}")
    scratch = Scratch(vectors.sparkSession, "vector-codes")
    vec = F.col(vec_col).cast("array<double>")
    good = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.when(finite(vec), vec).alias("v")).where("size(v) > 0")
    rows = good.select("id", "label", F.transform("v", lambda v: F.floor(v * SCALE)).alias("x"))
    out = None
    for r in rows.groupBy(F.size("x").alias("dim")).count().orderBy("dim").collect():  # the lengths that vectors have
        some = _one_length(rows.where(F.size("x") == r["dim"]), r["dim"], parts, min(entries, r["count"]), rounds, scratch)
        out = some if out is None else out.unionByName(some)
    if out is None:
        out = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit("").alias("codebooks_sha256"))
    coded = scratch.save(out, "coded")
    labels = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")
