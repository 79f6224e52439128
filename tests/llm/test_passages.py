"""Repeated word passages against a dictionary of all windows."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from tideform.llm import passages

DATA = "/root/testdata/sf0.001"


def plain(rows, length):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    counts = {}
    for w in split:
        for i in range(len(w) - length + 1):
            counts[tuple(w[i : i + length])] = counts.get(tuple(w[i : i + length]), 0) + 1
    out = []
    for (i, _), w in zip(rows, split):
        gone = set()
        for s in range(len(w) - length + 1):
            if counts[tuple(w[s : s + length])] > 1:
                gone |= set(range(s, s + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def planted(seed, docs=120, vocabulary=400):
    rnd = random.Random(seed)
    word = lambda: "w%d" % rnd.randrange(vocabulary)
    shared = [[word() for _ in range(rnd.choice([34, 35, 36, 50, 90]))] for _ in range(6)]
    rows = []
    for i in range(docs):
        text = [word() for _ in range(rnd.randrange(0, 200))]
        for _ in range(rnd.randrange(0, 3)):
            p = list(rnd.choice(shared))
            if rnd.random() < 0.4:
                p[rnd.randrange(len(p))] = word()  # one word differs
            at = rnd.randrange(0, len(text) + 1)
            text[at:at] = p[rnd.randrange(0, 5) :]
        rows.append((i, rnd.choice([" ", "  ", "\n", "\t "]).join(text)))
    same = " ".join(f"u{k}" for k in range(60))
    rows += [(1000 + k, same) for k in range(5)] + [(7, rows[7][1]), (7, "other " * 40), (None, same), (None, None), (None, "x"), (None, rows[3][1])]
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "a " * 300), (2004, "a b " * 40), (2005, "é ü " * 50), (2006, "a\x1cb " * 36), (2007, "y" * 5000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, key int, id int, cover string")


@pytest.mark.parametrize("seed,length,gram,hot", [(1, 35, 8, 5000), (2, 35, 8, 3), (3, 12, 3, 5000), (4, 9, 8, 2), (5, 5, 1, 5000)])
def test_matches_all_windows(spark, seed, length, gram, hot):
    rows = planted(seed, vocabulary=400 if length > 20 else 12)
    assert result(passages.remove_passages(frame(spark, rows), length, gram, hot=hot)) == plain(rows, length)


def test_on_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(passages.remove_passages(docs))
    assert got == plain(rows, 35) and any(r[2] for r in got)
    assert got == result(passages.remove_passages(docs.repartition(7), hot=1))
    assert passages.remove_passages(docs.where("false")).count() == 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rnd = random.Random(9)
    words = ["v%d" % rnd.randrange(900) for _ in range(3000)]
    words[2000:2100] = words[400:500]
    rows = [(0, " ".join(words)), (1, " ".join(words[1000:1100]))]
    want = {(k, i): w for k, (_, t) in enumerate(rows) for i, w in [(0, t)]}
    monkeypatch.setattr(passages, "PIECE", 256)
    met = pd.concat(passages.anchors([0, 1], [t for _, t in rows]))
    # Every window has one anchor: the runs cover all starts of both texts once.
    starts = sorted((k, s) for k, at, lo, hi in zip(met["key"], met["at"], met["lo"], met["hi"]) for s in range(at - lo, at - hi + 1))
    assert starts == [(0, s) for s in range(3000 - 34)] + [(1, s) for s in range(100 - 34)]
    assert len(want) == 2 and len(met) < 3100 / 10


def test_equal_windows_have_one_anchor():
    rnd = random.Random(2)
    common = ["c%d" % rnd.randrange(30) for _ in range(60)]
    a = ["a"] * 3 + common + ["b"] * 40
    b = ["z"] * 50 + common
    found = pd.concat(passages.anchors([0, 1], [" ".join(a), " ".join(b)]))
    at = {}
    for k, g, x, lo, hi in zip(found["key"], found["gram"], found["at"], found["lo"], found["hi"]):
        for s in range(x - lo, x - hi + 1):
            at[k, s] = (g, x - s)
    for i in range(60 - 34):
        assert at[0, 3 + i] == at[1, 50 + i]


def test_extension_splits_where_words_differ():
    covers = [b"x p q a b c d y", b"w p q a b c d z", b"w p r a b c d z"]  # anchor "a" at 3, windows of five words
    met = passages.extended(np.array([5, 5, 5]), np.array([3, 3, 3]), np.array([0, 0, 0]), covers, 5)
    # Windows begin o words before the anchor: "p q a b c" and "q a b c d" are shared by the first two, "a b c d z" by the last two.
    assert met.tolist() == [[False, True, True, False], [True, True, True, False], [True, False, False, False]]
