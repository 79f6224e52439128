"""One query for each operator of this subpackage over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideform.llm import bpe, embeddings, exact, html, licenses, mixing, ordinal, passages, simhash, suffixes, toxicity, vector_codes, whitening
from tideform.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), word_bpe_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), size=3, words=1, radius=2, sketches=0)
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return ordinal.quality_scores(docs, labels.where(~toxicity.held_out()), "quality")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = toxicity.toxicity_scores(docs, labels.where(~toxicity.held_out()))
    return scores.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as domains: the text tells them, unlike ``source``, whose names say nothing about the text."""
    docs = table(spark, sf_dir, "documents")
    labelled = table(spark, sf_dir, "labels").select("doc_id").join(docs.select("doc_id", F.col("lang").alias("domain")), "doc_id")
    rates = mixing.mixing_rates(docs, labelled, 0.7)
    return rates.select("doc_id", "n_tokens", "rate", mixing.copies_of(F.col("rate"), F.col("doc_id")).alias("copies"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_passages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def license_sql(documents: str = "documents") -> str:
    """The same in DuckDB's SQL: all built-in texts, short and full, written out, and each line freed of its notice."""

    def canonical(x: str) -> str:
        lines = f"string_split(replace(lower({x}), chr(13), chr(10)), chr(10))"
        out = f"array_to_string(list_transform({lines}, lambda line: regexp_replace(line, '{licenses.COPYRIGHT_NOTICE}', '\\1', 's')), chr(10))"
        out = f"' ' || trim(regexp_replace({out}, '{licenses.NOT_WORD}', '  ', 'g'), ' ') || ' '"
        for a, b in licenses.SPELLINGS:
            a, b = a.replace(" ", "  "), b.replace(" ", "  ")
            out = f"replace({out}, ' {a} ', ' {b} ')"
        return f"trim({out}, ' ')"

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.license_rows() + licenses.full_rows())
    return f"""
WITH known AS (
  SELECT sha256(c) AS h, min(license_id) AS license_id
  FROM (SELECT license_id, {canonical("text")} AS c FROM (VALUES {values}) AS v(license_id, text)) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({canonical("coalesce(text, '')")}) AS canonical_sha256 FROM {documents})
SELECT d.doc_id, known.license_id, d.canonical_sha256 FROM d LEFT JOIN known ON known.h = d.canonical_sha256"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_sql(),
        "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    }
