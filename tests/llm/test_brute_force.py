"""Classifiers and pipeline stages against plain versions of the same, and rows that repeat."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tideform.llm import bpe, exact, html, licenses, mixing, ordinal, queries, simhash, suffixes, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    """Documents with nulls, empty and long texts, and rows that repeat."""
    rows = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "one word", None, "s", 8), (-3, "one word", None, "s", 8), (-4, "y" * 10_000, "xx", None, 10_000), (-5, "a b c d e f g " * 400, "en", "s", 1), (-6, "\n \t", "en", "", 3)]
    return spark.createDataFrame(rows, docs.schema)


def test_quality_by_hand(spark):
    """Scores from the fitted weights, feature by feature, and grades from scores; tokens that differ late are told apart."""
    rng = random.Random(4)
    long = "q" * 10_000
    rows = [(i, " ".join([rng.choice(["alpha", "Beta", "gamma!", "delta"]), *(["good"] * (i % 4)), *(["bad"] * (3 - i % 4)), long + str(i % 2), "the", "the"]), i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = ordinal.fit_quality(df.drop("quality"), df.select("doc_id", "quality"))
    got = {r.doc_id: r for r in ordinal.quality_scores(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    assert ordinal.slots(long + "0") != ordinal.slots(long + "1")
    for i, text, _ in rows:
        tokens = text.split()
        n, score = len(tokens), 0.0
        for t in tokens:
            kind = ordinal.shape(t)
            score += model.weights[2 + xxhash.xxh32_intdigest(kind) % (ordinal.DIM // 4 - 2)] / n
            score += model.weights[ordinal.DIM // 4 + xxhash.xxh32_intdigest(t.lower(), 1) % (ordinal.DIM - ordinal.DIM // 4)] / n
        score += model.weights[0] * sum(a == b for a, b in zip(tokens, tokens[1:])) / n + model.weights[1] * (len(set(tokens)) / n - min(1.0, 3 / n**0.3))
        above = [1 / (1 + math.exp(c - score)) for c in model.cuts]
        chances = np.diff([0.0, *(1 - p for p in above), 1.0])
        assert got[i].expected_grade == pytest.approx(sum(g * p for g, p in zip(model.grades, chances)), abs=1e-6) and got[i].tail_prob == pytest.approx(chances[-1], abs=1e-6)
    assert all(a < b for a, b in zip(model.cuts, model.cuts[1:]))
    grades = df.select("doc_id", (F.col("doc_id") % 100).alias("quality"))
    assert ordinal.quality_scores(df.drop("quality"), grades).where("expected_grade between 0 and 99").count() == 120


def test_domains_by_hand(spark):
    """Posteriors of a plain naive Bayes over the same words; more domains than are told apart are pooled."""
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choices(vocab, [1 + 4 * ((k + i) % 3 == 0) for k in range(30)], k=rng.randint(1, 25))), f"d{i % 3}") for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    names, post = mixing.domain_posteriors(df.drop("domain"), df.select("doc_id", "domain"), vocabulary=12)
    sizes = Counter(d for _, _, d in rows)
    holds = {(w, d): sum(w in t.split() for _, t, x in rows if x == d) for w in vocab for d in sizes}
    apart = {w: sum(abs(holds[w, d] / sizes[d] - sum(holds[w, x] for x in sizes) / 240) * sizes[d] / 240 for d in sizes) for w in vocab}
    best = sorted(vocab, key=lambda w: (-round(apart[w], 12), w))[:12]
    got = {r.doc_id: r.posterior for r in post.collect()}
    assert names == sorted(sizes)
    for i, text, _ in rows:
        logs = []
        for d in names:
            total = math.log(sizes[d] / 240)
            for w in best:
                p = (holds[w, d] + 0.5) / (sizes[d] + 1)
                total += math.log(p if w in text.split() else 1 - p)
            logs.append(total)
        e = [math.exp(x - max(logs)) for x in logs]
        assert got[i] == pytest.approx([x / sum(e) for x in e], abs=1e-4)
    many = df.select("doc_id", F.concat(F.lit("d"), F.col("doc_id") % 100).alias("domain"))
    assert len(mixing.fit_domains(df.drop("domain"), many)[0]) == 100
    names, post = mixing.domain_posteriors(df.drop("domain"), many, domains=64)
    assert len(names) == 64 and mixing.OTHERS in names and post.where(f"size(posterior) = {len(names)}").count() == 240


def test_rows_that_repeat(spark, docs):
    """Two equal rows give two equal results (but for op5, which keeps the first of them whole)."""
    some = docs.orderBy("doc_id").limit(30).select("doc_id", "text")
    twice = some.unionByName(some)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(20)
    for f in (
        lambda d: licenses.license_scan(d, licenses.known_licenses(spark)), lambda d: bpe.bpe_digests(d, queries.word_bpe_path()), simhash.simhash_components,
        lambda d: ordinal.quality_scores(d, labels), lambda d: toxicity.toxicity_scores(d, labels.select("doc_id", "toxic")), exact.exact_groups,
    ):
        seen = Counter(tuple(map(str, r)) for r in f(twice).collect())
        assert set(seen.values()) == {2} and len(seen) == 30
    seen = Counter(tuple(r) for r in html.extract_main_text(pages.unionByName(pages)).collect())
    assert set(seen.values()) == {2} and len(seen) == 20


def test_exact_without_identifiers(spark):
    """Ties: null identifiers come last in either order of keeping, and stay only among their own kind."""
    rows = [(None, "same"), (5, "same"), (2, "same"), (None, "own"), (None, "own"), (7, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for keep, kept in (("smallest", 2), ("largest", 5)):
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(df, keep).collect())
        assert got == Counter([(None, kept, 3, False), (5, kept, 3, kept == 5), (2, kept, 3, kept == 2), (7, 7, 1, True), (None, None, 2, True), (None, None, 2, True)])


def test_pipeline_stages_on_odd_rows(spark, odd, docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out = stage(spark, odd, DATA)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert stage(spark, odd.where("false"), DATA).count() == 0, name
        if name in ("toxicity", "mixing"):
            assert set(ids) <= {-1, -2, -3, -4, -5, -6} and (name == "mixing" or len(ids) == 7)
        if name == "exact_dedup":  # null and "" are one text; of two equal rows that share an identifier one stays
            assert sorted(ids) == [-6, -5, -4, -3, -2]
        if name == "simhash_near_dedup":  # no words: null, empty and white space
            assert sorted(ids) == [-6, -5, -4, -3]
        if name == "bpe":
            assert len(ids) == 7
        else:
            assert out.columns == docs.columns


def test_pipeline_keeps_rows_without_identifier(spark, docs):
    """Every stage decides about rows: a missing or shared identifier loses none, and of copies exactly one stays."""
    import corpus_pipeline as p

    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, long), (None, "another " * 9 + "text"), (4, "third text of its own"), (None, long), (7, long + " more"), (4, "a fourth text that shares an identifier"), (9, "third text of its own")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = lambda stage: sorted((str(r.doc_id), r.text) for r in stage(spark, df, DATA).collect())
    want = [("4", rows[2][1]), ("4", rows[5][1]), ("7", rows[4][1]), ("None", rows[1][1]), ("None", long)]
    assert kept(p.drop_copies) == sorted(want)
    assert kept(p.drop_near_copies) == sorted(w for w in want if w != ("None", long))  # near copies keep the one that has an identifier
    assert kept(p.drop_toxic) == sorted((str(i), t) for i, t in rows)
    assert kept(p.mix_domains) == sorted((str(i), t) for i, t in rows)  # no labelled rows: all are drawn


def test_stages_by_brute_force(spark, docs):
    """Exact dedup, mixing and encoding against plain versions over the same rows."""
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rows = {r.doc_id: r for r in docs.collect()}
    best: dict = {}
    for i, r in rows.items():
        best[r.text or ""] = min(i, best.get(r.text or "", i))
    assert sorted(r.doc_id for r in p.drop_copies(spark, docs, DATA).collect()) == sorted(best.values())
    labelled = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    rates = {r.doc_id: r.rate for r in mixing.mixing_rates(docs, labelled, p.TEMPER, total="within", cap=1.0).collect()}
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("h")).collect()}
    want = [i for i in rows if math.floor(rates[i] + hashed[i] % 2**32 / 2**32) > 0]
    assert sorted(r.doc_id for r in p.mix_domains(spark, docs, DATA).collect()) == sorted(want)
    tok = Tokenizer.from_file(queries.word_bpe_path())
    tok.no_truncation()
    tok.no_padding()
    for r in p.encode(spark, docs.orderBy("doc_id").limit(60), DATA).collect():
        ids = tok.encode(rows[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
