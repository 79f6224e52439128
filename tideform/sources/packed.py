"""Packed tapes: 17-byte little-endian records of time (ms), bid, ask and flags; and strict CSV tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = 17
BROADCAST_FILES = 50_000
CSV_SCHEMA = T.StructType([T.StructField(n, T.LongType(), False) for n in ("seq", "ts_ns", "session_day", "bid_u", "ask_u")])


def _little(start: int, size: int):
    """Unsigned little-endian number of some bytes of ``rec``: their hex digits, reversed by pairs."""
    parts = [F.hex(F.expr(f"substring(rec, {start + size - i}, 1)")) for i in range(size)]
    return F.conv(F.concat(*parts), 16, 10).cast("decimal(20,0)")


def _signed(start: int, size: int):
    v = _little(start, size)
    half, whole = (F.lit(str(2**n)).cast("decimal(20,0)") for n in (8 * size - 1, 8 * size))
    return F.when(v >= half, v - whole).otherwise(v).cast("bigint")


def read_packed(spark: SparkSession, path: str, first_seq: int = 1) -> DataFrame:
    """Tape of one or more packed files; a file's records are numbered on in path order. A truncated tail is an error.

    Files are split at record bounds, so a large one is read by many tasks. A record's number follows from its split's
    offset and its place in the split; only the list of paths and sizes (no content) is put in order in one place.
    """
    sizes = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    sound = F.when(F.col("length") % RECORD == 0, F.floor(F.col("length") / RECORD)).otherwise(F.raise_error(F.lit("truncated record")).cast("bigint"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.withColumn("n", sound).select("path", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), "n")
    jvm = spark.sparkContext._jvm
    records = spark.sparkContext._jsc.binaryRecords(path, RECORD).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    # The identifier counts rows within a partition in its low bits, and a partition is one split of one file.
    place = (F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.expr(f"input_file_block_start() div {RECORD}")).alias("place")
    rows = raw.select(F.input_file_name().alias("path"), place, F.col("value").alias("rec"))
    # Paths and counts of so many files at most are safe to broadcast; beyond that the sides meet by path.
    files = F.broadcast(files) if sizes.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else files
    rows = rows.join(files, "path").where("n >= 0").select((F.col("before") + F.col("place") + first_seq).alias("seq"), "rec")
    return rows.select("seq", (_signed(0, 8) * 1_000_000).alias("ts_ns"), _signed(8, 4).alias("bid_u"), _signed(12, 4).alias("ask_u"), _little(16, 1).cast("smallint").alias("flags"))


def read_csv_tape(spark: SparkSession, path: str) -> DataFrame:
    """CSV tape with exactly the five columns, in order; anything else fails the read."""
    return spark.read.schema(CSV_SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def conversion_parity(csv: DataFrame, packed: DataFrame) -> DataFrame:
    """One row: records of either tape, those missing in one, and those that differ."""
    both = csv.alias("a").join(packed.alias("b"), "seq", "full_outer")
    return both.agg(
        F.count("*").alias("records"), F.count_if(F.col("a.ts_ns").isNull() | F.col("b.ts_ns").isNull()).alias("missing"),
        F.count_if((F.col("a.ts_ns") != F.col("b.ts_ns")) | (F.col("a.bid_u") != F.col("b.bid_u")) | (F.col("a.ask_u") != F.col("b.ask_u"))).alias("different"),
    )
