"""Sets of event numbers in packed form: delta-coded chunks, their index, classes of equal sets, and conjunctions by bitmaps.

A pack has one row for each chunk of a mask: the numbers of one span, the first in full and the others as 32-bit distances,
with their count, ends and digest. Counts and ends are columns, so a reader prunes by them (the index); chunks are bounded,
so no mask is held whole by a task. A mask's digest is that of its chunks' digests in order: equal for equal sets, whatever the
order in which they were gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

SPAN = 1 << 16


def _chunk(number: Column, span: int) -> Column:
    return ((number - F.pmod(number, F.lit(span))) / span).cast("bigint")


@F.pandas_udf(BinaryType())
def _coded(numbers: pd.Series) -> pd.Series:
    return pd.Series([np.diff(n, prepend=n[:1]).astype("<u4").tobytes() for n in numbers])


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def pack(rows: DataFrame, by: list[str], number: str = "number", span: int = SPAN, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``(*by, chunk, n, first, last, digest, deltas)`` of the sets that ``by`` tells apart; repeats count once, nulls not at all."""
    if not 0 < span <= 1 << 31:
        raise ValueError(f"span: {span}")
    some = rows.where(F.col(number).isNotNull()).select(*by, F.col(number).cast("bigint").alias("number"))
    own = some.groupBy(*by, _chunk(F.col("number"), span).alias("chunk")).agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return own.select(
        *by, "chunk", F.size("numbers").cast("bigint").alias("n"), F.element_at("numbers", 1).alias("first"), F.element_at("numbers", -1).alias("last"),
        digest(F.array_join(F.transform("numbers", lambda v: v.cast("string")), ",")).alias("digest"), _coded("numbers").alias("deltas"),
    )


def unpack(packed: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, number)``. A chunk whose length, order, ends or digest is not what its row says stops the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            numbers = []
            for n, first, last, raw in zip(f["n"], f["first"], f["last"], f["deltas"]):
                steps = np.frombuffer(raw if len(raw) == 4 * n else b"", "<u4").astype(np.int64)
                if not len(steps) or steps[0] or (steps[1:] == 0).any() or first + steps.sum() != last:
                    raise ValueError(f"damaged chunk: {n} numbers from {first} to {last}")
                numbers.append(first + np.cumsum(steps))
            yield f[by].assign(numbers=numbers, digest=f["digest"])

    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in by)
    out = packed.mapInPandas(run, f"{kinds}, numbers array<bigint>, digest string")
    text = F.array_join(F.transform("numbers", lambda v: v.cast("string")), ",")
    numbers = F.when(F.sha2(text, 256) == F.col("digest"), F.col("numbers")).otherwise(F.raise_error(F.lit("damaged chunk: its digest differs")).cast("array<bigint>"))
    return out.select(*by, F.explode(numbers).alias("number"))


def masks(packed: DataFrame, by: list[str]) -> DataFrame:
    """One row a mask: ``(*by, class_hash, events, chunks)``; a row for each chunk is gathered, never the numbers."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda p: p["digest"])
    return packed.groupBy(*by).agg(F.sha2(F.array_join(parts, ","), 256).alias("class_hash"), F.sum("n").alias("events"), F.count("*").alias("chunks"))


def aliases(packed: DataFrame, domain: list[str], config: str) -> DataFrame:
    """Every mask with the smallest name of its class, by content: ``(*domain, config, class_hash, events, canonical, same)``.

    The digest brings masks together; ``same`` tells whether all chunks are those of the canonical mask, byte by byte.
    """
    own = masks(packed, [*domain, config])
    least = own.groupBy(*domain, "class_hash").agg(F.min(config).alias("canonical"))
    named = own.join(least, [*domain, "class_hash"])
    mine = packed.select(*domain, config, "chunk", "n", "first", "deltas").join(named.select(*domain, config, "canonical"), [*domain, config])
    theirs = packed.select(*domain, F.col(config).alias("canonical"), "chunk", F.col("n").alias("n_2"), F.col("first").alias("first_2"), F.col("deltas").alias("deltas_2"))
    met = mine.join(theirs, [*domain, "canonical", "chunk"]).where("n = n_2 and first = first_2 and deltas = deltas_2")
    equal = met.groupBy(*domain, config).agg(F.count("*").alias("equal"))
    joined = named.join(equal, [*domain, config], "left").join(own.select(*domain, F.col(config).alias("canonical"), F.col("chunks").alias("wanted")), [*domain, "canonical"])
    same = (F.coalesce("equal", F.lit(0)) == F.col("chunks")) & (F.col("chunks") == F.col("wanted"))
    return joined.select(*domain, config, "class_hash", "events", "canonical", same.alias("same"))


def classes(packed: DataFrame, domain: list[str], config: str, clash: str = "raise") -> DataFrame:
    """``(*domain, class_hash, representative, aliases, events, exact)``, a row for each set of equal masks.

    Digests that clash stop the job, or, with ``clash="show"``, leave a class that is not exact.
    """
    own = aliases(packed, domain, config)
    out = own.groupBy(*domain, "class_hash").agg(F.min("canonical").alias("representative"), F.count("*").alias("aliases"), F.max("events").alias("events"), F.bool_and("same").alias("exact"))
    if clash == "raise":
        out = out.withColumn("exact", F.when(F.col("exact"), True).otherwise(F.raise_error(F.lit("two masks share a digest")).cast("boolean")))
    return out


def conjunctions(rows: DataFrame, domain: list[str], config: str, number: str = "number") -> DataFrame:
    """``(*domain, config_a, config_b, both)``: how many numbers each two masks of a domain share, where they share any.

    Numbers become bits of bitmaps of 32,768; two masks meet once for each bitmap, not for each number.
    """
    bits = rows.where(F.col(number).isNotNull()).groupBy(*domain, config, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    a, b = (bits.select(*domain, "bucket", F.col(config).alias(f"{config}_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    pairs = a.join(b, [*domain, "bucket"]).where(f"{config}_a < {config}_b")
    keys = [*domain, f"{config}_a", f"{config}_b"]
    both = pairs.select(*keys, "bucket", F.explode(F.array("bits_a", "bits_b")).alias("bits")).groupBy(*keys, "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bits")).alias("n"))
    return both.groupBy(*keys).agg(F.sum("n").alias("both_n")).where("both_n > 0")


def sorted_roots(ids: DataFrame, shard: Column, column: str = "id") -> DataFrame:
    """``(shard, n, root)``: SHA-256 over a shard's distinct texts in order, each followed by a line feed.

    A shard's texts stream through one task, sorted by Spark, and are never held together.
    """
    import hashlib

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, n, state = None, 0, hashlib.sha256()
        for f in frames:
            for key, part in f.groupby("shard", sort=True):
                if key != now:
                    if n:
                        yield pd.DataFrame({"shard": [now], "n": [n], "root": [state.hexdigest()]})
                    now, n, state = key, 0, hashlib.sha256()
                n += len(part)
                state.update("".join(f"{x}\n" for x in part["id"]).encode())
        if n:
            yield pd.DataFrame({"shard": [now], "n": [n], "root": [state.hexdigest()]})

    rows = ids.select(shard.alias("shard"), F.col(column).alias("id")).where("id is not null").distinct()
    return rows.repartition("shard").sortWithinPartitions("shard", "id").mapInPandas(run, "shard string, n bigint, root string")
