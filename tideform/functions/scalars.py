"""Small checks and conversions of fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_ROWS = 10**12  # counts up to here times a million fit a long


def valid_date(day: Column) -> Column:
    """Whether a number like 20240131 is a date from 1970 to 2200; missing ones are not."""
    there = F.try_to_timestamp(day.cast("string"), F.lit("yyyyMMdd")).isNotNull()
    return F.coalesce(day.between(19700101, 22001231) & there, F.lit(False))


def valid_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def valid_name(text: Column) -> Column:
    """1 to 128 ASCII letters, digits, _ and -."""
    return F.coalesce(text.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def parts_per_million(part: Column, whole: Column) -> Column:
    """Whole parts per million, cut; 0 of nothing. Counts too large for exact arithmetic stop the job."""
    fits = (F.abs(part) <= MOST_ROWS) & (F.abs(whole) <= MOST_ROWS)
    exact = F.when(whole == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", part * F.lit(1_000_000).cast("bigint"), F.nullif(whole, F.lit(0))))
    return F.when(fits, exact).otherwise(F.raise_error(F.lit("count beyond the bound")).cast("bigint"))


def multiple(text: Column) -> Column:
    """The number in R<number>, AT<number>R... or <name>_AT_<number>R...; null for NONE, OFF and anything else."""
    number = r"([0-9]+(?:[.][0-9]+)?)"
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (rf"^R{number}$", rf"^AT{number}(?:R|$)", rf"_AT_{number}(?:R|$)")])
    return F.when(text.isin("NONE", "OFF"), None).otherwise(found.cast("double"))


def plain_decimal(value: Column) -> Column:
    """A decimal as text without trailing zeros, nor a point after which nothing stands; minus nought is 0."""
    text = value.cast("string")
    cut = F.when(F.contains(text, F.lit(".")), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "[.]$", "")).otherwise(text)
    return F.when(cut.isin("", "-0", "-"), "0").otherwise(cut)
