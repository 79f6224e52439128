"""The training-data operators against brute force, on small tables with the odd cases in them."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tideform.llm import bpe, embeddings, exact, html, licenses, mixing, ordinal, queries, simhash, suffixes, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [None, "", "a", "a", "  \n\t ", "É", "x" * 3000, "ab" * 2000, "the cat sat on the mat and the dog", "The cat sat on the mat and the dog", "0 1 2", "a\x1cb", "😀 😀"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i - 3, t, "en", -1, "clash") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, id int, digest string")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def empty(df):
    return df.where("false")


# 1


def test_licenses(spark, odd):
    known = spark.createDataFrame([("L", "The Licence,\nof Organisation!"), ("M", "permission   granted")], "license_id string, text string")
    rows = [(1, "# Copyright (c) 2020 Somebody\nthe license OF organization"), (2, "Permission granted."), (3, "permission granted twice"), (4, None), (5, "licence licence"), (6, "license LICENSE")]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id int, text string"), known).collect()}
    assert [got[i].license_id for i in range(1, 7)] == ["L", "M", None, None, None, None]
    assert got[5].canonical_sha256 == got[6].canonical_sha256
    assert licenses.license_scan(odd, known).count() == len(ODD) and licenses.license_scan(empty(odd), known).count() == 0


def test_built_in_licenses_match_themselves(spark):
    known = licenses.known_licenses(spark)
    docs = known.select(F.monotonically_increasing_id().alias("doc_id"), F.upper("text").alias("text"), "license_id")
    assert licenses.license_scan(docs, known).where("license_id is null").count() == 0


def test_licenses_in_several_typesettings(spark):
    """Both engines know each licence again however it is typeset, and agree on all digests."""
    known = licenses.license_rows() + licenses.full_rows()
    rows, want = [], {}

    def add(text, name):
        want[len(rows)] = name
        rows.append((len(rows), text))

    for name, text in known:
        add(text, name)
        add("# Copyright (c) 2019, 2021 \u00c9mile Zola\r\n * \u00a9 Somebody\n\n" + text.upper(), name)
        add("Copyright 2020 A\nCopyright 2021 B\nCopyright by C\n" + text.replace('"', "\u201d").replace("'", "\u2019").replace("-", "\u2014").replace(" ", "\u00a0", 40), name)
        add("\ufeff" + re.sub(r"\blicense\b", "licence", text.replace("\n", "\n\n \u2022 ")), name)
        add(text + "\nand more", None)
        add(text[: len(text) // 2], None)
    add("Copyright holders be liable", None)
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, licenses.known_licenses(spark)).collect()}
    same = {n: got[i].license_id for i, n in want.items() if n and rows[i][1] in dict(known).values()}  # names that share a form
    assert {i: got[i].license_id for i in want} == {i: n and same[n] for i, n in want.items()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    theirs = con.execute(queries.license_sql()).fetchall()
    assert {i: (n, h) for i, n, h in theirs} == {i: (r.license_id, r.canonical_sha256) for i, r in got.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    got = queries.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.select(cols).collect())


# 2


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.word_bpe_path())
    t.no_truncation(), t.no_padding()
    return t


def test_bpe(spark, odd, docs, word_bpe):
    rng = random.Random(3)
    extra = ["<|endoftext|>x <|startoftext|>", "ΑΣ Σ'LL don't", "é café", "the" * 3000, "#$" * 400] + ["".join(rng.choice("abcdethinrso '9") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 100).alias("doc_id"), "text")).unionByName(more)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.bpe_digests(every, queries.word_bpe_path()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts(every).items():
        ids = word_bpe.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(word_bpe.decode(ids, skip_special_tokens=False)))
    tokens = {r.doc_id: r for r in bpe.bpe_tokens(more, queries.word_bpe_path()).collect()}
    assert tokens[1000].decoded == word_bpe.decode(tokens[1000].ids, skip_special_tokens=False)
    assert bpe.bpe_digests(empty(odd), queries.word_bpe_path()).count() == 0


def test_transducer_streams(word_bpe):
    own = bpe.WordBpe(queries.word_bpe_path())
    rng = random.Random(5)
    piece = "".join(rng.choice("abcdethinrso") for _ in range(20 * own.lookahead))
    assert list(own.stream(piece.encode())) == word_bpe.encode(piece, add_special_tokens=False).tokens
    seen = 0

    def source():
        nonlocal seen
        for b in piece.encode():
            seen += 1
            yield b

    next(own.stream(source()))
    assert seen <= 4 * own.lookahead  # the first token leaves long before the end


def test_incremental_decoding():
    own = bpe.WordBpe(queries.word_bpe_path())
    ids = [i for part in own.portions("naïve 😀 text") for i in part]
    d = bpe.Decoder(own, byte_level=True)
    assert "".join(d.feed([i]) for i in ids) + d.feed([], True) == "naïve 😀 text "


def test_digests_come_from_the_ids(word_bpe):
    """Other ids give another decoded text, and a long word leaves in portions of a bounded size."""
    own = bpe.WordBpe(queries.word_bpe_path())
    ids = [i for part in own.portions("some words to change") for i in part]
    n, a, b = bpe.digests_of([ids], bpe.Decoder(own))
    assert n == len(ids) and bpe.digests_of([ids[:2], ids[2:]], bpe.Decoder(own)) == (n, a, b)
    other = bpe.digests_of([[*ids[:-1], ids[0]]], bpe.Decoder(own))
    assert other[1] != a and other[2] != b
    word = "".join(random.Random(2).choices("abcdethinrso", k=300_000))
    parts = list(own.portions(word))
    assert len(parts) > 2 and max(map(len, parts)) <= bpe.PORTION
    assert [i for p in parts for i in p] == word_bpe.encode(word, add_special_tokens=False).ids


# 3


def plain_print(s, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s))
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd, docs):
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 100).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in simhash.simhash_components(every, size=3, words=1, radius=2, sketches=0).collect()}
    prints = {i: plain_print(t) for i, t in texts(every).items()}
    ids = sorted(prints)
    near = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    want = components(ids, near)
    assert {i: (got[i].fp[0] & (2**64 - 1), got[i].component_id) for i in ids} == {i: (prints[i], want[i]) for i in ids}
    assert simhash.simhash_components(empty(odd)).count() == 0


def test_tiles_keep_components():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = np.repeat(base, 60)[:, None] ^ (np.uint64(1) << rng.integers(0, 64, 720).astype(np.uint64))[:, None]
    old = simhash.TILE
    simhash.TILE = 50
    try:
        for side in (np.zeros(720, int), rng.integers(0, 2, 720)):
            links = simhash.tile_links(fps, side, 2)
            dist = np.bitwise_count(fps[:, None, 0] ^ fps[None, :, 0])
            want = [(a, b) for a, b in zip(*np.nonzero(dist <= 2)) if a < b and (not side.any() or side[a] != side[b])]
            assert components(range(720), links) == components(range(720), want) and len(links) < 720
    finally:
        simhash.TILE = old


def test_bit_blocks(spark, monkeypatch):
    """Fingerprints within the radius agree under a mask at least, however many rows; wider masks for more rows."""
    rng = np.random.default_rng(7)
    for rows, count, width in ((10**6, 3, 21), (10**9, 6, 32), (10**12, 10, 38)):
        masks = simhash.block_masks(2, rows)
        assert len(masks) == count and min(m.bit_count() for m in masks) >= width
        for _ in range(300):
            x = int(rng.integers(0, 2**63))
            y = x ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False))
            assert any(x & m == y & m for m in masks)
    rows = [(i, " ".join(f"w{(i // 4) * 100 + j}" for j in range(60)) + (" x" if i % 4 else "") * (i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {tuple(r) for r in simhash.simhash_components(df, 3, 1, 2, 0).select("doc_id", "component_id").collect()}
    monkeypatch.setattr(simhash, "block_masks", lambda radius, rows, f=simhash.block_masks: f(radius, 10**10))
    assert {tuple(r) for r in simhash.simhash_components(df, 3, 1, 2, 0).select("doc_id", "component_id").collect()} == few


def test_long_runs_are_dealt_in_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + f" tail{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {tuple(r) for r in simhash.simhash_components(df, 3, 1, 20, 0).select("doc_id", "component_id").collect()}
    monkeypatch.setattr(simhash, "PART", 2)
    assert {tuple(r) for r in simhash.simhash_components(df, 3, 1, 20, 0).select("doc_id", "component_id").collect()} == whole


# 4


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    x = np.concatenate([centre[rng.integers(0, 20, 250)] + 0.15 * rng.normal(size=(250, 16)), rng.normal(size=(100, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(900, rows[3][1], 0), (901, rows[3][1], 0), (902, None, 0), (903, [], 0), (904, [0.0] * 16, 0), (905, [float("nan")] * 16, 0), (906, [None] * 16, 0), (907, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {i: np.array(v, float) for i, v, _ in rows if i < 902}
    ids = sorted(good)
    m = np.stack([good[i] for i in ids])
    cos = m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1))
    near = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(cos >= 0.9)) if a < b]
    links = {i: sum(i in p for p in near) for i in ids}
    for part in (embeddings.PART, 8):
        monkeypatch.setattr(embeddings, "PART", part)
        got = {r.vec_id: r for r in embeddings.embedding_links(df).collect()}
        assert all(got[i].n_links <= links[i] for i in ids)
        assert sum(got[i].n_links for i in ids) >= 0.97 * sum(links.values())
        assert all(tuple(got[i])[1:] == (0, i, True) for i in range(902, 908))
        assert got[900].n_links == got[3].n_links and got[900].component_id == got[3].component_id and not got[901].kept
    assert embeddings.embedding_links(empty(df)).count() == 0


# 5


def plain_cut(rows, size):
    seen, out = set(), {}
    for d, t in sorted(rows.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 3, "bucket_rows": 40}])
def test_suffixes(spark, odd, docs, limits):
    rng = random.Random(9)
    shared = ["".join(rng.choice(["the ", "xé", "Orre ", "\n", "and "]) for _ in range(rng.randint(20, 120))) for _ in range(8)]
    rows = [(500 + i, "".join(rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdef ") for _ in range(rng.randint(1, 120))) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    every = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") - 100).alias("doc_id"), "text")).unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(every, **limits).collect()}
    assert got == plain_cut(texts(every), suffixes.LENGTH)
    assert suffixes.remove_repeats(empty(odd)).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(5)
    for n, spread in ((0, 1), (1, 1), (50_000, 3), (50_000, 10**6), (20_000, 1)):
        words = [rng.integers(0, spread, n).astype(np.uint64) for _ in range(4)] + [np.arange(n)]
        assert (suffixes.multikey_sort(words) == np.lexsort(words[::-1])).all()


def test_windows_with_colliding_digests(monkeypatch):
    monkeypatch.setattr(suffixes.xxhash, "xxh3_64_intdigest", lambda b: len(b) % 7)
    rng = random.Random(2)
    cover = bytes(rng.choice(b"ab") for _ in range(400))
    cover = cover + cover[50:200]
    seen, met = suffixes.Windows(), []
    for i in range(len(cover) - suffixes.LENGTH + 1):
        met.append(seen.met(cover, i))
    want = [cover[i : i + suffixes.LENGTH] in {cover[j : j + suffixes.LENGTH] for j in range(i)} for i in range(len(met))]
    assert met == want and any(met)


def test_suffixes_of_rows_without_or_with_one_identifier(spark):
    """Each row is a document: rows without identifier first, rows of one identifier in the order of their texts."""
    rng = random.Random(1)
    a, b, c = ("".join(rng.choices("abcdefgh", k=n)) for n in (408, 250, 130))
    rows = [(None, a), (None, "x" * 20), (None, b), (3, "x" + a), (5, c), (5, b), (5, "y" + c), (-1, b)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in got) == Counter(
        [(None, 408, 0), (None, 20, 0), (None, 250, 0), (-1, 250, 250), (3, 409, 408), (5, 130, 0), (5, 250, 250), (5, 131, 130)]
    )
    twice = suffixes.remove_repeats(spark.createDataFrame([(4, a), (4, a)], "doc_id int, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in twice) == [(4, 0), (4, 408)]


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    rng = random.Random(4)
    a = "".join(rng.choice("abcdef") for _ in range(5000)).encode()
    rec = suffixes.anchors([1, 2], [a, a[1000:4000]])
    covered = {(d, p) for d, x, lo, hi in zip(rec["doc"], rec["pos"].astype(int), rec["lo"].astype(int), rec["hi"].astype(int)) for p in range(x - lo, x - hi + 1)}
    assert len(covered) == (5000 - 99) + (3000 - 99)


# 6


def test_quality(spark, docs, odd):
    rng = random.Random(1)
    word = lambda: rng.choice(["Lorem", "ipsum", "dolor", "sit", "amet", "sed"])
    rows = []
    for i in range(300):
        g = i % 3
        rows.append((i, " ".join(word() + ("!!" if rng.random() < (2 - g) / 2 else "") for _ in range(60)), g))
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    got = {r.doc_id: r for r in ordinal.quality_scores(df.drop("grade"), df.select("doc_id", "grade").where("doc_id < 200"), "grade").collect()}
    held = [(got[i].expected_grade, i % 3) for i in range(200, 300)]
    assert np.mean([abs(a - b) for a, b in held]) < 0.35 and np.mean([got[i].kept == (i % 3 == 2) for i in range(200, 300)]) > 0.9
    ratings = spark.createDataFrame([(-3, 1), (-1, None), (77, 0)], "doc_id long, quality int")
    assert ordinal.quality_scores(odd, ratings).count() == len(ODD)
    none = ordinal.quality_scores(odd, ratings.where("false")).collect()
    assert all(r.kept and r.tail_prob is None for r in none) and ordinal.quality_scores(empty(odd), ratings).count() == 0


# 7


def test_html(spark):
    pages = [
        (1, "http://a.example/1", "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>H &amp; x</h1><p>one\n two<p>th<b>r</b>ee<br>four<div class='comments'><p>rude</p></div></article><footer>f</footer>"),
        (2, "http://a.example/2", None), (3, None, ""), (4, "http://a.example/4", "<article><p>a < b &lt;c&gt;<script>var t='</p>';</script><!-- no --> d</p></article>"),
        (5, "http://a.example/5", "plain & simple"), (6, "::", "<div><p>x</p><div class=ad>buy</div></div>"),
    ]
    pages += [(10 + i, f"http://b.example/{i}", f"<html><body><div class=top>Our site</div><div class=x><p>story {i}</p></div><div>All rights</div></body></html>") for i in range(6)]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, host int")
    got = {r.page_id: r.text for r in html.extract_main_text(df).collect()}
    assert got[1] == "H & x\n\none two\n\nthree four" and got[2] == got[3] == "" and got[4] == "a < b <c> d"
    assert got[5] == "plain & simple" and got[6] == "x"
    assert [got[10 + i] for i in range(6)] == [f"story {i}" for i in range(6)]
    assert html.extract_main_text(empty(df)).count() == 0


def test_pages_against_plain_reading(spark):
    import html as entities

    got = {r.page_id: r for r in queries.op7_html_text(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_html_template_decides(spark):
    """Element and class names say nothing here: what every page of the host repeats is template, the rest is the article."""
    words = "amber bridge cedar delta ember forest garden harbor island jungle".split()
    rng = random.Random(3)

    def story() -> list[str]:
        return [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) + f" {rng.random()}" for _ in range(rng.randint(1, 5))]

    stories = [story() for _ in range(12)]
    pages = []
    for i, paras in enumerate(stories):
        body = "".join(f"<p>{p}</p>" for p in paras)
        odd = '<div class="k9"><p>Special offer</p></div>' if i % 2 else ""
        page = f'<div class="a1"><div>Start</div><div>Find</div></div><div class="b2">note {i}</div><div class="c3" id="s{i}"><h1>T{i}</h1><div>Share this</div>{body}{odd}</div><div class="d4">All rights</div>'
        pages.append((i, "https://x.example/p", page))
    pages += pages[:4]  # rows repeat
    few = [(100 + i, "https://y.example/p", page) for i, (_, _, page) in enumerate(pages[:2])]  # no template from two pages
    got = html.extract_main_text(spark.createDataFrame(pages + few, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 18
    for r in got:
        if r.page_id < 100:
            assert r.text == "\n\n".join([f"T{r.page_id}", *stories[r.page_id]])
        else:
            assert "All rights" in r.text and "note" in r.text


def test_html_classes_by_brute_force(spark):
    """Vectors, order and nesting of classes, gathered in parts, against counting each token on each page."""
    pages = [f"<ul>{'<li><i>x</i></li>' * (n % 3 + 1)}</ul><b>same</b>{'<s>old</s>' if n % 2 else ''}{'<u>a</u><em>b</em>' if n % 4 else '<em>b</em><u>a</u>'}" for n in range(8)]
    frame = pd.DataFrame({"page_id": range(8), "host": "h", "html": pages})
    parts = pd.concat(html._vectors(iter([frame[:3], frame[3:]])))
    counts = [html.tokens(p) for p in pages]
    vectors = {t: tuple(c.get(t, [0])[0] for c in counts) for c in counts for t in c}
    summed = parts.groupby("token")[["pages", "n", "low", "high"]].sum()
    summed.index = summed.index.to_numpy().view(np.uint64)
    assert set(summed.index) == set(vectors)
    for t, v in vectors.items():
        assert summed.pages[t] == sum(n > 0 for n in v) and summed.n[t] == sum(v)
        assert {x for x in vectors if vectors[x] == v} == {x for x in vectors if (summed.low[x], summed.high[x]) == (summed.low[t], summed.high[t])}
    # Classes as templates() would pack them; u and em change places, so their class (that of each page) would not be valid.
    groups: dict = {}
    for t, v in vectors.items():
        groups.setdefault((v, counts[1].get(t, [0, 0, 0])[2] and t), []).append(t)
    rows = []
    for no, ((v, text), ts) in enumerate(sorted(groups.items(), key=str)):
        page = next(c for c in counts if ts[0] in c)
        ts.sort(key=lambda t: page[t][1])
        rows += [(np.uint64(t).astype(np.int64), no, i, len(ts), int(bool(text)), max(v) == 1, all(v), hash(v) % 1000, 8) for i, t in enumerate(ts)]
    classes = html.Classes(np.array(rows, np.int64).tobytes())
    facts = np.tile(np.array(html._START, np.int64), (len(rows), 1))
    for p in pages:
        html.place(p, classes, facts)
    bad = {classes.own[r] for r in range(len(rows)) if facts[r, 0]}
    page_class = classes.own[classes.row[html.PAGE]]
    assert page_class in bad  # it holds u and em
    li = next(c for c, t in ((classes.own[r], t) for t, r in classes.row.items()) if vectors[t] == tuple(n % 3 + 1 for n in range(8)))
    assert li not in bad


# 8


def test_restore_forms():
    """Each way of disguise brings back the word; decoding is the best of all readings; tokens of any length are read."""
    text = "grumble is what old windows do when winter comes and people grumble too " * 30
    counts = np.zeros(toxicity.SIZE**3)
    x = toxicity._CODE[np.frombuffer(f"  {text} ".encode(), np.uint8)].astype(np.int64)
    np.add.at(counts, (x[:-2] * toxicity.SIZE + x[1:-1]) * toxicity.SIZE + x[2:], 1)
    model = toxicity.log_model(counts)
    scorer = toxicity._Scorer({"grumble$": 0.97}, model)
    forms = "6rumbl3|g.r.u.m.b.l.e|g r u m b l e|a g r u m b l e|g r u m b l e.|(g r u m b l e)|g  r  u  m  b  l  e|gr um bl e|grruumble|gr_umble|9 r u m b l 3|g-r-u-m-b-l-e"
    for form in [*forms.split("|"), "g" + "r" * 10_000 + "umble", "g r u m b l e w i n d o w s"]:
        assert scorer.score(f"the {form} end") >= 0.9, form
    for clean in ["grum", "all is well in an old house", "1 2 3 4 5 6 7 8", "", " ", "x" * 20_000, "a b c d", "it is to be or no"]:
        assert scorer.score(clean) < 0.1, clean
    long = toxicity._Scorer({"grumbl": 0.95}, model)
    assert long.score("grumble" * 5_000) >= 0.9 and long.score("0" * 20_000 + "x") < 0.1

    def readings(word: str, at: int, a: int, b: int, last: str, cost: float, out: str):
        if at == len(word):
            yield cost - model[a][b][toxicity.EDGE], out
            return
        ch = word[at]
        run = max(len(m[0]) for m in re.finditer(r"(.)\1*", word, re.S) if m.start() <= at < m.end())
        if ch == " ":
            yield from readings(word, at + 1, a, b, last, cost + toxicity.COST_JOIN, out)
            if b != toxicity.EDGE:
                yield from readings(word, at + 1, b, toxicity.EDGE, " ", cost - model[a][b][toxicity.EDGE], out + " ")
            return
        for letter in ch if ch.isalpha() else toxicity.STANDS_FOR.get(ch, ""):
            price = 0.0 if ch.isalpha() else toxicity.COST_SWAP
            k = toxicity.LETTERS.find(letter) if letter in toxicity.LETTERS else toxicity.OTHER
            keep = toxicity.COST_KEEP_REPEAT if letter == last and run > 2 else 0.0
            yield from readings(word, at + 1, b, k, letter, cost + price - model[a][b][k] + keep, out + letter)
            if letter == last and run > 1:
                yield from readings(word, at + 1, a, b, last, cost + price + (toxicity.COST_REPEAT if run > 2 else toxicity.COST_DOUBLE), out)
        if not ch.isalpha():
            noise = run > 2 or ch not in toxicity.STANDS_FOR and not ch.isalnum()
            drop = toxicity.COST_DROP_NOISE if noise else toxicity.COST_DROP_DIGIT if ch.isalnum() else toxicity.COST_DROP_SIGN
            yield from readings(word, at + 1, a, b, last, cost + drop, out)

    rng = random.Random(8)
    for _ in range(150):
        word = "".join(rng.choice("grumble01!| .") for _ in range(rng.randint(1, 8)))
        best = sorted(readings(word, 0, toxicity.EDGE, toxicity.EDGE, "", 0.0, ""))
        assert toxicity.decode(word, model) in {t for c, t in best if c <= best[0][0] + 1e-9}


def test_toxicity(spark, odd):
    rng = random.Random(6)
    bad = ["vrelk", "stumor", "gobbin"]
    fill = ["the", "cat", "sat", "upon", "many", "green", "mats", "while", "singing", "softly", "house", "window"]
    spoil = [lambda w: w, lambda w: w.replace("o", "0").replace("e", "3"), lambda w: ".".join(w), lambda w: " ".join(w), lambda w: w[:2] + w[2] * 5 + w[3:]]
    rows = []
    for i in range(600):
        words = [rng.choice(fill) for _ in range(30)]
        if i % 5 == 0:
            words.insert(rng.randint(0, 29), rng.choice(spoil if i >= 400 else spoil[:1])(rng.choice(bad)))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(df.drop("toxic"), df.select("doc_id", "toxic").where("doc_id < 400")).collect()}
    assert np.mean([got[i].predicted == 1 for i in range(400, 600) if i % 5 == 0]) >= 0.85
    assert all(got[i].predicted == 0 for i in range(600) if i % 5)
    labels = spark.createDataFrame([(-3, 1), (-2, None), (50, 1)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity_scores(odd, labels).collect()} == {0}
    assert toxicity.toxicity_scores(empty(odd), labels).count() == 0


def test_restore():
    counts = np.ones(toxicity.SIZE**3)
    model = toxicity.log_model(counts)
    assert toxicity.restore("plain", model) == "plain" and toxicity.restore("", model) == ""
    assert toxicity.restore("m0r0n", model) == "moron" and toxicity.restore("soooo", model) in ("so", "soo")


def test_words_cut_in_pieces_of_any_length():
    """Pieces that spell a rule are decoded together, whatever their length; neighbours that are words by themselves stay apart."""
    text = "the stupid station of this district stood in distant dust and studied the lapidary inscription " * 30
    counts = np.zeros(toxicity.SIZE**3)
    x = toxicity._CODE[np.frombuffer(f"  {text} ".encode(), np.uint8)].astype(np.int64)
    counts += np.bincount((x[:-2] * toxicity.SIZE + x[1:-1]) * toxicity.SIZE + x[2:], minlength=len(counts))
    scorer = toxicity._Scorer({"stupid$": 0.95, "lapi": 0.95}, toxicity.log_model(counts))
    for cut in ("stu pid", "s tupid", "stup id", "st upid", "stu p1d", "stu pid!", "s t u p i d", "stu\n\npid", "$tu pid", "lap idary"):
        assert scorer.score(f"the district {cut} stood") >= toxicity.CERTAIN, cut
    for clean in ("the district stood", "stu and pid", "distupid", "dust upon", "the stu pi"):
        assert scorer.score(clean) < toxicity.CERTAIN, clean


# 9


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, odd, keep):
    got = {r.doc_id: r for r in exact.exact_groups(odd, keep).collect()}
    rows = texts(odd)
    for i, t in rows.items():
        same = [j for j, u in rows.items() if u == t]
        k = min(same) if keep == "smallest" else max(same)
        assert tuple(got[i])[1:] == (k, len(same), i == k, hashlib.sha256(t.encode()).hexdigest())
    assert exact.exact_groups(empty(odd)).count() == 0


def test_index_merges_runs(spark):
    index = exact.DigestIndex(spark, memtables=3)
    for part in ([(5, b"a"), (2, b"b")], [(1, b"a"), (9, b"a")]):
        index.flush(spark.createDataFrame(part, "id long, digest binary"))
    level = index.compact()
    assert sorted((bytes(r.digest), r.min_id, r.max_id, r.n) for r in level.collect()) == [(b"a", 1, 9, 3), (b"b", 2, 2, 1)]
    index.flush(spark.createDataFrame([(0, b"b")], "id long, digest binary"))
    assert {bytes(r.digest): r.min_id for r in index.compact().collect()} == {b"a": 1, b"b": 0}
    bits = exact.filter_of(level)
    assert {bytes(r.digest) for r in exact.may_contain(level.select("digest"), bits).collect()} == {b"a", b"b"}


# 10


def test_mixing(spark, odd):
    rows = [(i, " ".join(["le", "la", "et"] * 20) if i % 4 == 0 else " ".join(["the", "of", "and"] * 20), "fr" if i % 4 == 0 else "en") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = df.where("doc_id < 200").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mixing_rates(df, labelled, {"fr": 1, "en": 1}).join(df.select("doc_id", "lang"), "doc_id")
    mass = {r.lang: r.t for r in got.groupBy("lang").agg(F.sum(F.expr("rate * n_tokens")).alias("t")).collect()}
    assert mass["fr"] == pytest.approx(12000, rel=1e-3) and mass["en"] == pytest.approx(12000, rel=1e-3)
    capped = mixing.mixing_rates(df, labelled, {"fr": 1, "en": 1}, total="within", cap=1.0)
    assert capped.agg(F.max("rate")).first()[0] <= 1 and capped.where("rate < 0").count() == 0
    # The same steps in numpy.
    names, post = mixing.domain_posteriors(df, labelled)
    p = np.array([[*r.posterior, r.n_tokens] for r in post.orderBy("doc_id").collect()])
    q, n, rate = p[:, :-1], p[:, -1], np.ones(len(p))
    own = (q * n[:, None]).sum(0)
    for _ in range(mixing.PASSES):
        now = (q * (n * rate)[:, None]).sum(0)
        if abs(now - 12000).max() <= mixing.CLOSE * n.sum():
            break
        rate = np.maximum(0, rate - q @ ((now - 12000) / own))
    mine = np.array([r.rate for r in got.orderBy("doc_id").collect()])
    assert np.allclose(mine, rate, atol=1e-6) and names == ["en", "fr"]
    assert mixing.mixing_rates(odd, labelled.where("false"), 0.7).where("rate = 1").count() == len(ODD)
    assert mixing.mixing_rates(odd, odd.select("doc_id", F.col("lang").alias("domain")), 0.7).count() == len(ODD)
    assert mixing.mixing_rates(empty(odd), labelled, 0.7).count() == 0


def test_copies(spark):
    got = spark.range(4000).select(mixing.copies_of(F.lit(1.25), F.col("id")).alias("c")).groupBy("c").count().collect()
    assert {r.c for r in got} == {1, 2} and abs(sum(r.c * r["count"] for r in got) / 4000 - 1.25) < 0.03


# the pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    clean = p.drop_toxic(spark, docs, DATA)
    assert clean.columns == docs.columns
    assert clean.join(labels.where("toxic = 0"), "doc_id").count() >= 0.98 * docs.join(labels.where("toxic = 0"), "doc_id").count()
    one = p.drop_copies(spark, docs, DATA)
    want = {}
    for i, t in texts(docs).items():
        want[t] = min(i, want.get(t, i))
    assert sorted(r.doc_id for r in one.collect()) == sorted(want.values())
    near = p.drop_near_copies(spark, one, DATA)
    assert near.columns == docs.columns and near.count() <= one.count()
    out = p.run(spark, DATA)
    assert 0 < out.count() <= near.count() and out.columns[0] == "doc_id"


def _shingle_sets(rows):
    out = {}
    for i, t in rows:
        words = t.lower().split()
        out[i] = {tuple(words[j : j + 5]) for j in range(len(words) - 4)} or {tuple(words)}
    return out


def test_near_copies_are_those_of_similarity_080(spark, monkeypatch):
    import corpus_pipeline as p
    from tideform.llm import near

    rng = random.Random(8)
    rows = []
    for k in (4, 5, 6, 6, 7, 8, 9) * 20:  # 274 words, so 270 shingles: k lone changes leave a similarity of (54 - k) / (54 + k)
        words = [f"w{rng.randrange(10**6)}" for _ in range(274)]
        other = list(words)
        for at in rng.sample(range(4, 264, 6), k):
            other[at] += "x"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    line = " ".join(f"c{j}" for j in range(30))
    rows += [(len(rows) + j, line + " " + " ".join(rng.choices("abcdefgh", k=40))) for j in range(40)]  # one common line
    rows += [(len(rows), "a b c"), (len(rows) + 1, "A  b c"), (len(rows) + 2, ""), (len(rows) + 3, " ")]
    sets = _shingle_sets(rows)
    near_pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert 70 < len(near_pairs) < 110
    want = sorted({v for v in components(sorted(sets), near_pairs).values()})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, df, DATA).collect()) == want
    monkeypatch.setattr(near, "PART_ROWS", 3)
    assert sorted(r.doc_id for r in p.drop_near_copies(spark, df, DATA).collect()) == want


def test_full_licenses_and_wrapped_lines(spark):
    rows = dict(licenses.license_rows())
    bsd = rows["BSD-3-Clause"]
    at = bsd.index("COPYRIGHT HOLDER OR CONTRIBUTORS")
    with open("/usr/share/common-licenses/GPL-2") as f, open("/usr/share/common-licenses/Apache-2.0") as g:
        gpl, apache = f.read(), g.read()
    mit = " ".join(rows["MIT"].removeprefix("MIT License").split())
    wrapped = bsd[:at].rstrip() + "\n" + bsd[at:]
    items = [gpl, apache, wrapped, "Copyright (c) 2020 Some Body " + mit, "© 2019 A\n# Copyright 2020 B\nCopyright by C\n" + mit, bsd[:at] + bsd[at + 32 :], "(c) You must retain"]
    df = spark.createDataFrame(list(enumerate(items)), "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, licenses.known_licenses(spark)).collect()}
    assert [got[i].license_id for i in range(7)] == ["GPL-2.0", "Apache-2.0", "BSD-3-Clause", "MIT", "MIT", None, None]
    assert got[6].canonical_sha256 == hashlib.sha256(b"c  you  must  retain").hexdigest()
