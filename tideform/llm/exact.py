"""Exact deduplication by a log-structured merge index, with DataFrame operations only.

Rows go to memtables by a hash of their identifier. Each flush of a memtable is a run: its distinct digests in sorted
order, with the smallest and largest identifier and the number of rows, and a bit filter. Compaction asks the filters
first: a digest that no other run may hold stays as it is, only the others are read and merged. Every hit is then verified
byte by byte against the text of the row that stays; texts that share a digest without sharing their bytes are grouped by
those bytes instead. Groups that hold more than a small share of all rows are dealt out in parts, each with the keeper.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideform.llm.common import Scratch, text_or_empty

MEMTABLES = 4
#: Bits of a filter: BITS_EACH times the number of digests, up to a bound that fixes what is broadcast (MAX_BITS / 8 bytes,
#: 4 MB a filter). Beyond it a filter lets ever more digests through, which costs reading, never results.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 1 << 15, 1 << 25
#: A digest with more than this share of all rows is hot; there are at most 1 / HOT_SHARE of them, whatever the table.
HOT_SHARE, HOT_LEAST, PART_ROWS = 1e-4, 64, 64


def bits_for(digests: int) -> int:
    """Size of the filter for so many digests: a power of two within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << max(1, digests * BITS_EACH - 1).bit_length()))


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


def filter_of(digests: DataFrame, bits: int = MIN_BITS) -> DataFrame:
    """Bit filter over a digest column: at most ``bits`` / 32768 rows of 4 KB, whatever the number of digests."""
    p = _slot(bits)
    return digests.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))


def may_contain(rows: DataFrame, filter_: DataFrame, bits: int = MIN_BITS) -> Column | DataFrame:
    """Rows with ``hit``: false where their digest is certainly not in the filter."""
    octet = "cast(conv(hex(substring(bits, cast(bit_at div 8 as int) + 1, 1)), 16, 10) as int)"
    hit = F.coalesce(F.expr(f"({octet} & shiftleft(1, cast(bit_at % 8 as int))) != 0"), F.lit(False))
    keyed = rows.withColumns({"bucket": F.bitmap_bucket_number(_slot(bits)), "bit_at": F.bitmap_bit_position(_slot(bits))})
    return keyed.join(F.broadcast(filter_), "bucket", "left").withColumn("hit", hit).drop("bucket", "bits", "bit_at")


class DigestIndex:
    """Log-structured index of text digests in the shared folder: flushed runs with their filters, and the merged level."""

    def __init__(self, spark: SparkSession, memtables: int = MEMTABLES) -> None:
        self.scratch = Scratch(spark, "digest-index")
        self.memtables, self.flushed = memtables, 0
        self.runs: list[tuple[DataFrame, DataFrame, int]] = []  # run, filter, its bits

    def flush(self, rows: DataFrame) -> None:
        """Add (id, digest) rows: each memtable becomes a sorted run with a filter. Empty memtables leave none."""
        own = F.pmod(F.xxhash64("id"), F.lit(self.memtables)).cast("int").alias("run")
        out = rows.groupBy(own, "digest").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))
        saved = self.scratch.save(out.sortWithinPartitions("run", "digest"), f"flush-{self.flushed}")
        sizes = {r["run"]: r["count"] for r in saved.groupBy("run").count().collect()}  # one row for each memtable
        for k, size in sorted(sizes.items()):
            self._add(saved.where(F.col("run") == k).drop("run"), size)
        self.flushed += 1

    def _add(self, run: DataFrame, size: int) -> None:
        bits = bits_for(size)
        self.runs.append((run, self.scratch.save(filter_of(run, bits), f"filter-{self.flushed}-{len(self.runs)}"), bits))

    def compact(self) -> DataFrame:
        """Merge all runs into one with a row per digest, which becomes the only run.

        A run's digest is read into the merge only if the filter of another run may hold it.
        """
        alone, merged = [], []
        for i, (run, _, _) in enumerate(self.runs):
            asked = run.withColumn("met", F.lit(False))
            for j, (_, filter_, bits) in enumerate(self.runs):
                if i != j:
                    asked = may_contain(asked, filter_, bits).withColumn("met", F.col("met") | F.col("hit")).drop("hit")
            alone.append(asked.where("not met").drop("met"))
            merged.append(asked.where("met").drop("met"))
        union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
        same = union(merged).groupBy("digest").agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"))
        level = self.scratch.save(union([same, *alone]).select("digest", "min_id", "max_id", "n"), f"level-{self.flushed}")
        self.runs = []
        self._add(level, level.count())
        return level


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_groups(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Group rows with equal texts.

    Returns one row per input row: ``(id_col, keep_id, group_size, kept, text_sha256)``. A null text counts as empty;
    empty texts form a group like any other. ``keep`` is ``smallest`` or ``largest`` identifier. Rows that repeat one
    identifier and text count each towards the size and all are marked kept if theirs is the kept identifier. A null
    identifier is smaller than none and is kept only in a group of its own kind (keep_id null). Other columns are
    ignored, so clashing names do no harm. An empty table gives an empty result. ``digest`` only brings rows together:
    however often it collides, texts that differ are told apart.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    keeper, pick = ("min_id", F.min) if keep == "smallest" else ("max_id", F.max)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(spark)
    index.flush(base.select("id", "digest"))
    done = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)
    if not index.runs:
        return base.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), done.alias("text_sha256"))
    scratch = index.scratch
    hits = scratch.save(index.compact().where("n > 1").select("digest", F.col(keeper).alias("keep_id"), "n"), "hits")
    n_hits, rows = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = hits.where(F.col("n") > max(HOT_LEAST, int(rows * HOT_SHARE))).select("digest", F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    hot = F.broadcast(scratch.save(hot, "hot"))  # at most 1 / HOT_SHARE rows, since their counts add up to ``rows``

    def dealt(df: DataFrame, part: Column) -> DataFrame:
        return df.join(hot, "digest", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part).drop("parts")

    # Texts that the filter rules out have no copy and are done; only the others are shuffled.
    asked = may_contain(base, scratch.save(filter_of(hits, bits_for(n_hits)), "filter-hits"), bits_for(n_hits))
    single = asked.where("not hit").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("n"), done.alias("sha"))
    # The keeper's text is found by its identifier, then goes to every part of its group.
    found = asked.where("hit").join(hits.select("digest", F.col("keep_id").alias("id")), ["id", "digest"], "left_semi")
    found = scratch.save(found.groupBy("id", "digest").agg(F.min("text").alias("kept_text")), "keepers")
    known = hits.join(found.withColumnRenamed("id", "keep_id"), ["keep_id", "digest"], "left")
    known = dealt(known, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    met = dealt(asked.where("hit").drop("hit"), F.pmod(F.xxhash64("id"), F.col("parts"))).join(known, ["digest", "part"], "left")
    # Byte verification; a group whose keeper has no identifier is compared with nothing and checked as a collision.
    met = met.select("id", "digest", done.alias("sha"), "keep_id", "n", (F.col("n").isNotNull() & ~F.coalesce(F.col("text") == F.col("kept_text"), F.lit(False))).alias("differs"))
    met = scratch.save(met, "met")
    differ = met.where("differs").select("digest").distinct()
    if differ.isEmpty():  # one look for the whole table
        clash = met.where("false").select("id", "keep_id", "n", "sha")
    else:
        differ = scratch.save(differ, "collisions")
        apart = base.join(differ, "digest", "left_semi").select("id", "text")
        groups = apart.groupBy("text").agg(pick("id").alias("keep_id"), F.count("*").alias("n"))
        clash = apart.join(groups, "text").select("id", "keep_id", "n", F.sha2("text", 256).alias("sha"))
        met = met.join(differ, "digest", "left_anti")
    fine = met.select("id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("bigint")).alias("n"), "sha")
    out = single.unionByName(fine).unionByName(clash)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
