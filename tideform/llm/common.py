"""What the operators share: the shared folder, written intermediate tables and null-safe inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Tables are read chunk by chunk: vectored reads keep a direct buffer of a whole column chunk in every reader thread,
#: outside the heap, and long texts make large chunks.
UNVECTORED = ("parquet.hadoop.vectored.io.enabled", "false")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of our own is made and set in local
    mode (as in tests); on a cluster it is an error, because executors would not see it.
    """
    known = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} is not set")
        known = tempfile.mkdtemp(prefix="tideform-")
        spark.conf.set(CHECKPOINT_KEY, known)
    return known.rstrip("/")


class Scratch:
    """Intermediate tables in the shared folder; each is written once and read by what follows.

    A written table cuts the lineage: losing an executor costs the tasks it ran, never a recomputation from the source.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.option(*UNVECTORED).schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table."""
    return spark.read.option(*UNVECTORED).parquet(f"{sf_dir}/{name}.parquet")


def numbered(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, columns: list[str] | None = None, nulls_first: bool = False) -> DataFrame:
    """``docs`` with a long ``key`` that is the row's own, ordered by (identifier, text), and its text; null counts as empty.

    Where identifiers are whole numbers, all there and all different, they are the keys. Else rows are sorted once over the
    whole cluster and written with a number, since a number must outlive the loss of a task; rows without identifier come
    after all others, or first. Returns ``(key, text, *columns)``.
    """
    rows = docs.select(F.col(id_col).alias("key"), text_or_empty(text_col).alias("text"), *(columns or []))
    if docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long"):
        n, ids = rows.agg(F.count("*"), F.count("key")).first()
        if n == ids and rows.groupBy("key").count().where("count > 1").isEmpty():
            return rows.withColumn("key", F.col("key").cast("bigint"))
    order = F.col("key").asc_nulls_first() if nulls_first else F.col("key").asc_nulls_last()
    return scratch.save(rows.orderBy(order, "text").withColumn("key", F.monotonically_increasing_id()), "numbered")
