"""Tables written once to the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; in local mode one of our own where it names none. On a cluster that is an error."""
    known = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} is not set")
        known = tempfile.mkdtemp(prefix="tideform-")
        spark.conf.set(KEY, known)
    return known.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read again: what follows starts from files, and so does a task that is run again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
