"""Ledgers, masks and vendor files: strict readers, and sinks that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

_LONGS = ("entry_seq", "entry_ts_ns", "entry_u", "exit_seq", "exit_ts_ns", "exit_u", "net_u", "risk_u")
LEDGER = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("session_day", T.LongType()), T.StructField("intent_id", T.LongType()), T.StructField("side", T.IntegerType())]
    + [T.StructField(n, T.LongType()) for n in _LONGS]
    + [T.StructField("reason", T.StringType())]
)
#: A scenario: its anchor and its quotes, prices as decimal text.
SCENARIO = "scenario_id string, event_anchor struct<side string, trigger_ts bigint, close_ts bigint, stop string>, ticks array<struct<carrier_sequence: bigint, timestamp: bigint, bid: string, ask: string>>"


def content_digest(df: DataFrame) -> str:
    """Order-free digest of a table's rows: their number and the sum of their hashes. One aggregation, one row."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}"


def write_once(df: DataFrame, path: str, *partition: str) -> bool:
    """Write a table where there is none. The same rows again are fine (False); other rows at that place are an error."""
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path)
    except AnalysisException:
        df.write.partitionBy(*partition).mode("errorifexists").parquet(path)
        return True
    if sorted(known.columns) != sorted(df.columns) or content_digest(known.select(df.columns)) != content_digest(df):
        raise ValueError(f"{path} holds other rows")
    return False


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger CSV with exactly the known columns; a row that does not parse, does not add up or ends before it begins fails
    the read."""
    rows = spark.read.schema(LEDGER).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    sound = F.expr("net_u = side * (exit_u - entry_u) and side in (-1, 1) and exit_seq > entry_seq and exit_ts_ns >= entry_ts_ns and risk_u > 0")
    fail = F.raise_error(F.concat(F.lit("unsound ledger row "), F.coalesce(F.col("intent_id").cast("string"), F.lit("?"))))
    return rows.withColumn("intent_id", F.when(F.coalesce(sound, F.lit(False)), F.col("intent_id")).otherwise(fail.cast("bigint")))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario lines as one row per quote, prices as exact decimals."""
    rows = spark.read.schema(SCENARIO).option("mode", "FAILFAST").json(path)
    one = rows.select("scenario_id", "event_anchor.*", F.explode("ticks").alias("t"))
    price = lambda c: F.col(c).cast("decimal(38,18)")
    return one.select("scenario_id", "side", "trigger_ts", "close_ts", price("stop").alias("stop"), "t.carrier_sequence", "t.timestamp", price("t.bid").alias("bid"), price("t.ask").alias("ask"))


def scenario_outcomes(quotes: DataFrame) -> DataFrame:
    """Entry at the first quote from the trigger on; out at the first quote at or beyond the stop (the entry's own
    included), else at the last one by the close; R as an exact decimal. One row per scenario, result null without entry."""
    buy = F.col("side") == "BUY"
    live = quotes.where("timestamp >= trigger_ts and timestamp <= close_ts and ask > bid")
    first = live.groupBy("scenario_id").agg(F.min_by(F.struct("carrier_sequence", F.when(buy, F.col("ask")).otherwise(F.col("bid")).alias("price")), "carrier_sequence").alias("entry"))
    out = F.when(buy, F.col("bid")).otherwise(F.col("ask"))
    hit = F.when(buy, F.col("bid") <= F.col("stop")).otherwise(F.col("ask") >= F.col("stop"))
    quote = F.struct("carrier_sequence", out.alias("price"))
    ends = live.groupBy("scenario_id").agg(F.min(F.when(hit, quote)).alias("stopped"), F.max(quote).alias("last"))
    risk = F.abs(F.col("entry.price") - F.col("stop"))
    end = F.coalesce("stopped", "last")
    gain = F.when(buy, end["price"] - F.col("entry.price")).otherwise(F.col("entry.price") - end["price"])
    heads = quotes.select("scenario_id", "side", "stop").distinct()
    rows = heads.join(first, "scenario_id", "left").join(ends, "scenario_id", "left")
    reason = F.when(F.col("entry").isNull(), "NO_ENTRY").when(F.col("stopped").isNotNull(), "STOP").otherwise("TIME")
    return rows.select("scenario_id", reason.alias("reason"), F.col("entry.price").alias("entry"), end["price"].alias("exit"), F.try_divide(gain.cast("decimal(28,10)"), risk.cast("decimal(28,10)")).alias("r"))


def read_vendor_csv(spark: SparkSession, path: str, scale: int = 1) -> DataFrame:
    """``date,time,bid,ask`` text to (ts_ms, bid, ask): civil time without an offset, prices as integers of 10**-scale.
    A price with more digits than that is an error."""
    rows = spark.read.schema("date string, time string, bid string, ask string").option("header", True).option("mode", "FAILFAST").csv(path)

    def units(c: str) -> Column:
        exact = F.col(c).cast("decimal(30,12)") * F.lit(10**scale)
        return F.when(exact == F.floor(exact), exact.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("too many digits: "), c)).cast("bigint"))

    ts = F.to_timestamp_ntz(F.concat_ws(" ", "date", "time"), F.lit("yyyy.MM.dd HH:mm:ss[.SSS]"))
    ms = (F.unix_micros(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), ts).cast("timestamp")) / 1000).cast("bigint")
    return rows.select(ms.alias("ts_ms"), units("bid").alias("bid"), units("ask").alias("ask"))


def packed_records(tape: DataFrame) -> DataFrame:
    """(ts_ms, bid, ask, flags) as 17-byte little-endian records, column ``rec``, in the tape's own partitions."""

    def little(c: str, size: int) -> Column:
        digits = F.lpad(F.hex(F.col(c).cast("bigint")), 16, "0")
        return F.concat(*[F.unhex(F.substring(digits, 17 - 2 * (i + 1), 2)) for i in range(size)])

    return tape.select(F.concat(little("ts_ms", 8), little("bid", 4), little("ask", 4), little("flags", 1)).alias("rec"))
