"""Whitening and vector codes against plain versions."""

import hashlib
import math

import numpy as np
import pytest

from tideform.llm import vector_codes, whitening

DATA = "/root/testdata/sf0.001"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def odd_rows(dim=8, n=400, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).round(3).tolist(), i % 3) for i in range(n)]
    rows += [(n + k, rows[0][1], None) for k in range(50)]  # repeated vectors
    rows += [(7, rows[3][1], 5), (None, rows[9][1], 5), (None, rng.normal(size=dim).tolist(), None)]  # repeated and missing identifiers
    rows += [(9001, None, 1), (9002, [None] * dim, 1), (9003, [float("nan")] + [0.0] * (dim - 1), 1), (9004, [float("inf")] + [0.0] * (dim - 1), 1), (9005, [], 1), (9006, [0.0] * dim, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 3) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, x string, id int")


# 11


def check_whitening(rows, got, k=16):
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, _ in rows if usable(v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.int64)
    n, s = len(fit), fit.sum(0)
    z = (n * fit - s) / n
    cov = z.T @ z / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(k, len(e))
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(got) == k * len(kept)
    signs = {}
    for i, x in kept:
        c = [n * a - int(b) for a, b in zip(x, s)]
        mine = by[i, sum(d * d for d in c)]
        assert sorted(mine) == list(range(1, k + 1))
        for j in range(1, k + 1):
            want = float(np.array(c) / n @ u[:, j - 1]) / math.sqrt(e[j - 1])
            for r in mine[j]:
                if abs(want) > 1e-3:
                    signs.setdefault(j, np.sign(want) * np.sign(r.whitened))
                    assert signs[j] == np.sign(want) * np.sign(r.whitened)
                assert abs(abs(r.whitened) - abs(want)) < 1e-8
                assert r.n == n and abs(r.explained - e[j - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9


def test_whitening_matches_a_dense_solution(spark):
    for dim in (8, 3, 90):  # more, and fewer, dimensions than a block takes
        rows = odd_rows(dim, 300)
        check_whitening(rows, whitening.whitened(frame(spark, rows)).collect())


def test_whitening_of_odd_tables(spark):
    f = frame(spark, odd_rows())
    assert whitening.whitened(f.where("false")).count() == 0
    assert whitening.whitened(f.where("vec_id >= 9001 and vec_id < 9006")).count() == 0
    assert whitening.whitened(f.where("vec_id = 9006")).count() == 0  # one vector has no variance
    flat = frame(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(9)])
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    mixed = frame(spark, [*[(i, [i * 0.5, (i * i) % 7 * 1.0], 0) for i in range(9)], *[(20 + i, [i * 0.5], 0) for i in range(5)]])
    got = whitening.whitened(mixed).collect()
    assert {(r.n, r.component) for r in got} == {(9, 1), (9, 2), (5, 1)} and len(got) == 23


def test_lobpcg_needs_many_rounds_and_certifies():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    e = np.concatenate([np.linspace(9, 8, 16), np.linspace(7.9, 0.1, 384)])
    a = (q * e) @ q.T
    rounds = []
    values, vectors = whitening.leading_pairs(lambda b: rounds.append(b.shape) or a @ b, 400, 16)
    assert len(rounds) > 3 and max(s[1] for s in rounds) <= 3 * (16 + whitening.GUARD)
    assert np.abs(values - e[:16]).max() < 1e-11 and np.abs(np.abs((q[:, :16] * vectors).sum(0)) - 1).max() < 1e-10


# 12


def plain_codes(rows, parts=4, size=256, rounds=4):
    kept = [(i, lab, [math.floor(1024 * c) for c in v]) for i, v, lab in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = -(-len(kept[0][2]) // parts)
    cut = [[(x + [0] * (width * parts))[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in kept]
    books = [[list(c[p]) for c in cut[:size]] for p in range(parts)]

    def nearest(p):
        x, b = np.array([c[p] for c in cut], object), np.array(books[p], object)
        d = np.stack([((x - e) ** 2).sum(1) for e in b], 1)
        own = [min(range(len(b)), key=lambda j: (row[j], j)) for row in d]
        return own, [row[j] for row, j in zip(d, own)]

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = nearest(p)[0]
            book = [list(e) for e in books[p]]
            for j in set(own):
                mine = [c[p] for c, o in zip(cut, own) if o == j]
                book[j] = [sum(col) // len(mine) for col in zip(*mine)]
            new.append(book)
        books = new
    final = [nearest(p) for p in range(parts)]
    error = [sum(f[1][k] for f in final) for k in range(len(kept))]
    labels = {}
    for (_, lab, _), e in zip(kept, error):
        labels[lab] = labels.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{f[0][k]:02x}" for f in final), error[k], labels[lab], digest) for k, (i, lab, _) in enumerate(kept))


@pytest.mark.parametrize("dim,n", [(8, 700), (4, 60), (6, 400)])
def test_codes_match_plain_lloyd(spark, dim, n):
    rows = odd_rows(dim, n, seed=dim)
    got = vector_codes.vector_codes(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_codes_with_many_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(0, 3, 4) / 1024).tolist(), None) for i in range(500)]
    got = vector_codes.vector_codes(frame(spark, rows), entries=16).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, size=16)


def test_codes_of_large_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 1e5).tolist(), 1) for i in range(40)]
    got = vector_codes.vector_codes(frame(spark, rows), entries=4).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows, size=4)


def test_codes_of_odd_tables(spark):
    f = frame(spark, odd_rows())
    assert vector_codes.vector_codes(f.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.vector_codes(f.where("vec_id >= 9001 and vec_id < 9006")).count() == 0
    mixed = frame(spark, [(1, [0.5, 0.25], None), (2, [0.5], None), (3, [0.5, 0.25, 0.0, 1.0], 2)])
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.vector_codes(mixed).orderBy("vec_id").collect()] == [(k, "00000000", 0) for k in (1, 2, 3)]


def test_bounds_save_distances():
    rng = np.random.default_rng(6)
    centres = rng.integers(-900, 900, (64, 16))
    x = centres[rng.integers(0, 64, 4000)] + rng.integers(-20, 20, (4000, 16))
    book = vector_codes.Book(x[:64].astype(np.int64))
    entry, upper, lower, full = vector_codes.assign(x, book, None, None, None)
    costs = []
    for _ in range(4):
        new = book.entries.copy()
        for j in np.unique(entry):
            new[j] = x[entry == j].sum(0) // (entry == j).sum()
        book = vector_codes.Book(new, book.own, book.entries)
        entry, upper, lower, cost = vector_codes.assign(x, book, entry, upper, lower)
        d = ((x[:, None, :] - book.entries[None]) ** 2).sum(2)
        assert (entry == d.argmin(1)).all()
        costs.append(cost)
    assert full == 4000 * 64 and costs[-1] < full / 4
