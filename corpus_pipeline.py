"""A training corpus from raw documents: toxic texts go, copies and near copies go, domains are mixed, texts are encoded.

Each stage reads all that the one before kept; ``run`` writes each result to the shared folder and reads it again. Stages
decide about rows, not identifiers: where those are missing or shared, rows are numbered first. Part of the subpackage
``tideform.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideform.llm import bpe, exact, mixing, near, queries, toxicity
from tideform.llm.common import Scratch, numbered, table

#: Exponent that tempers the domains' own shares; rates stay within 0 and 1, so no document repeats.
TEMPER = 0.9
#: SQL cannot express the classifiers; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _keyed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(key, text, row)``: the row's own key, in the order of (doc_id, text), rows without doc_id last, and all its columns."""
    return numbered(docs, "doc_id", "text", Scratch(spark, "keyed"), [F.struct(*docs.columns).alias("row")])


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose keys are in ``kept``, with their own columns."""
    return rows.select("key", "row").join(kept.select("key"), "key", "left_semi").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below 0.7. Rules are learnt from labelled documents outside the held-out third."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    model = toxicity.log_model(toxicity.trigram_counts(docs))
    rules = toxicity.fit_rules(docs, labels, model)
    return toxicity.without(docs, rules, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the smallest doc_id."""
    rows = _keyed(spark, docs)
    return _only(rows, exact.exact_groups(rows.select("key", "text"), keep="smallest", id_col="key").where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8 or more): that with the smallest doc_id."""
    rows = _keyed(spark, docs)
    return _only(rows, near.near_components(rows.select("key", "text"), id_col="key").where("key = component_id"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the languages to tempered shares of the tokens."""
    rows = _keyed(spark, docs)
    marked = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = rows.select("key", "row.doc_id", F.col("row.lang").alias("domain")).join(marked, "doc_id", "left_semi").select(F.col("key").alias("doc_id"), "domain")
    rates = mixing.mixing_rates(rows.select(F.col("key").alias("doc_id"), "text"), labelled, TEMPER, total="within", cap=1.0)
    return _only(rows, rates.where(mixing.copies_of(F.col("rate"), F.col("doc_id")) > 0).select(F.col("doc_id").alias("key")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.bpe_digests(docs, queries.word_bpe_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
