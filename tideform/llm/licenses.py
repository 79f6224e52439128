"""Licence scan by canonical digest: whole texts are normalised and their digests joined with those of known licences."""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideform.llm.common import text_or_empty

# Equivalent spellings (the pairs that licence matching guidelines publish), as (variant, canonical).
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"),
    ("modelling", "modeling"), ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"),
    ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("sub licenses", "sublicenses"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)
# A notice opens a line: a copyright mark, whatever comment sign stands before it, with a year (or the place for one), a second
# mark or "by", up to the line's end or to where the licence itself begins on that line. Other lines that begin with the word
# belong to the licence ("copyright holders be liable"). Kept free of look-around, so that other engines read it too.
COPYRIGHT_NOTICE = (
    r"^[^a-z0-9]*(?:(?:copyright|copr\.|©)[^a-z0-9]*(?:\(c\)|©|[12][0-9]{3}|19yy|<?\[?(?:year|yyyy)\b|by )|©|\(c\)[^a-z0-9]*(?:copyright|[12][0-9]{3}))"
    r".*?($|permission is hereby granted|permission to use,|redistribution and use|this software is provided|licensed under)"
)
# What separates words: anything in ASCII but letters and digits, no-break and other wide spaces, and typographic quotes, dashes,
# bullets and signs (Latin-1 signs, general punctuation, CJK punctuation, byte order mark).
NOT_WORD = r"[^a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{2FFF}\x{3040}-\x{FEFE}\x{FF00}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices, words joined by two spaces, one spelling for each word.

    Equal texts up to these have equal canonical forms; a text of punctuation only becomes empty.
    """
    out = F.lower(F.replace(text, F.lit("\r"), F.lit("\n")))
    out = F.array_join(F.transform(F.split(out, "\n"), lambda line: F.regexp_replace(line, COPYRIGHT_NOTICE, "$1")), "\n")
    # Two spaces between words give each word a space of its own on either side, so neighbours are replaced alike.
    out = F.regexp_replace(out, NOT_WORD, "  ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for variant, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {one.replace(' ', '  ')} "))
    return F.trim(out)


def license_rows() -> list[tuple[str, str]]:
    """Built-in licence texts as (name, text)."""
    raw = resources.files("tideform.llm").joinpath("license_texts.txt").read_text("utf-8")
    parts = (p.partition("\n") for p in raw.split("\n=== ")[1:])
    return [(name.strip(), text.strip()) for name, _, text in parts]


def full_rows() -> list[tuple[str, str]]:
    """Full texts of the longer licences as (name, text)."""
    folder = resources.files("tideform.llm").joinpath("license_full_texts")
    return sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in folder.iterdir())


def known_licenses(spark: SparkSession) -> DataFrame:
    """Those texts as (license_id, text); any table of that form can take its place."""
    return spark.createDataFrame(license_rows() + full_rows(), "license_id string, text string")


def license_scan(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Match whole texts with licences by canonical digest.

    Returns one row per input row: ``(id_col, license_id, canonical_sha256)``; license_id is null without a match. Null
    texts count as empty; an empty canonical form matches nothing. Two licences with one canonical form share the
    smaller name. The join is on the digest, so the licence table may be of any size; extra columns are ignored.
    """
    known = licenses.select(F.sha2(canonical(text_or_empty("text")), 256).alias("canonical_sha256"), "license_id", F.length(canonical(text_or_empty("text"))).alias("n"))
    known = known.where("n > 0").groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col), F.sha2(canonical(text_or_empty(text_col)), 256).alias("canonical_sha256"))
    return rows.join(known, "canonical_sha256", "left").select(id_col, "license_id", "canonical_sha256")
