"""Imports that commit only what was verified, and records out of multi-part archives.

An import is written beside its place first. It moves there only once the digest of every source byte, the number of records and
their extents agree with its contract; else it is deleted and the job fails, so a damaged or short source leaves no output.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideform.sources.packed import RECORD
from tideform.sources.written import written

PIECE = 1 << 16  # records of a member that travel in one row
_KIND = np.dtype([("ms", "<i8"), ("bid", "<i4"), ("ask", "<i4"), ("flags", "u1")])


@dataclass(frozen=True)
class Contract:
    """What a source must be: SHA-256 of each file by its name, number of records, first and last time, and the budget."""

    digests: dict[str, str]
    rows: int
    first_ns: int
    last_ns: int
    max_rows: int = 2**63 - 1


def file_digests(spark: SparkSession, path: str, width: int = RECORD) -> DataFrame:
    """``(name, bytes, sha256)`` of files that consist of whole records.

    Splits are read in parallel by Spark's own reader; a file's bytes then stream through one task in order, never held together.
    """
    jvm = spark.sparkContext._jvm
    records = spark.sparkContext._jsc.binaryRecords(path, width).rdd()
    raw = DataFrame(spark._jsparkSession.createDataset(records, jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)
    rows = raw.select(F.input_file_name().alias("path"), F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("rec"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, size, state = None, 0, hashlib.sha256()
        for f in frames:
            for key, part in f.groupby("path", sort=False):
                if key != now:
                    if now is not None:
                        yield pd.DataFrame({"path": [now], "bytes": [size], "sha256": [state.hexdigest()]})
                    now, size, state = key, 0, hashlib.sha256()
                block = b"".join(part["rec"])
                size += len(block)
                state.update(block)
        if now is not None:
            yield pd.DataFrame({"path": [now], "bytes": [size], "sha256": [state.hexdigest()]})

    own = rows.repartition("path").sortWithinPartitions("path", "split", "n").mapInPandas(run, "path string, bytes bigint, sha256 string")
    return own.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")


def _check(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"import refused: {what}")


def commit_verified(tape: DataFrame, digests: DataFrame, contract: Contract, out: str) -> None:
    """Write ``tape`` (with ts_ns) to ``out`` if it and its source's ``digests`` (name, sha256) are what the contract says.

    ``out`` must not exist. Everything is checked on what was written, and before it can be seen.
    """
    spark = tape.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(out)
    files = target.getFileSystem(conf)
    _check(not files.exists(target), f"{out} exists")
    aside = f"{out.rstrip('/')}.unverified-{uuid.uuid4().hex}"
    try:
        tape.write.parquet(aside)
        done = spark.read.schema(tape.schema).parquet(aside)
        rows, first, last = done.agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns")).first()
        _check(rows <= contract.max_rows, f"{rows} records exceed the budget of {contract.max_rows}")
        _check(rows == contract.rows, f"{rows} records, not {contract.rows}")
        _check(not rows or (first, last) == (contract.first_ns, contract.last_ns), f"records from {first} to {last}")
        wanted = spark.createDataFrame(sorted(contract.digests.items()), "name string, wanted string")
        odd = digests.join(wanted, "name", "full").where("not coalesce(sha256 = wanted, false)").limit(5).collect()
        _check(not odd, f"bytes differ: {', '.join(r['name'] for r in odd)}")
        _check(files.rename(jvm.org.apache.hadoop.fs.Path(aside), target), f"{out} cannot be made")
    finally:
        files.delete(jvm.org.apache.hadoop.fs.Path(aside), True)


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """``(part, member, ordinal, n, sha256)`` of archives of packed records; parts by name, members in their archive's order.

    Parts are tasks; a member is unpacked piece by piece. A damaged archive, or a member with part of a record, stops the job.
    """
    return _members(spark, path).groupBy("part", "place", "member").agg(F.sum("n").alias("n"), F.max("sha256").alias("sha256")).select("part", "place", "member", "n", "sha256")


def _members(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of members; the last piece of each carries the digest of the whole member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["part"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for place, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
                        state, at, rest = hashlib.sha256(), 0, b""
                        with archive.open(info) as member:
                            while True:
                                raw = member.read(PIECE * RECORD)
                                state.update(raw)
                                rest += raw
                                whole = len(rest) // RECORD * RECORD
                                if not raw and rest:
                                    raise ValueError(f"{name}/{info.filename}: part of a record")
                                yield pd.DataFrame({"part": [name], "place": [place], "member": [info.filename], "at": [at], "n": [whole // RECORD], "records": [rest[:whole]], "sha256": [None if raw else state.hexdigest()]})
                                at, rest = at + whole // RECORD, rest[whole:]
                                if not raw:
                                    break

    parts = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("part"), "content")
    return parts.repartition("part").mapInPandas(run, "part string, place int, member string, at bigint, n bigint, records binary, sha256 string")


def read_archive(spark: SparkSession, path: str, digests: dict[str, str] | None = None, first: int | None = None) -> DataFrame:
    """Records of multi-part archives as one tape ``(seq, ts_ns, bid_u, ask_u, flags)``, all or exactly the ``first`` so many.

    ``digests`` (member to SHA-256) must name each member, and each must match, before any record is given out; so must there
    be enough records. Pieces beyond the prefix are not decoded.
    """
    pieces = written(_members(spark, path), "members")
    order = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    members = pieces.groupBy("part", "place", "member").agg(F.sum("n").alias("n"), F.max("sha256").alias("sha256"))  # one row a member
    members = written(members.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))), "member-list")
    if digests is not None:
        wanted = spark.createDataFrame(sorted(digests.items()), "member string, wanted string")
        odd = members.join(wanted, "member", "full").where("not coalesce(sha256 = wanted, false)").limit(5).collect()
        _check(not odd, f"members differ: {', '.join(r['member'] for r in odd)}")
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    _check(first is None or first <= total, f"{total} records, fewer than {first}")
    end = total if first is None else first

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for start, raw in zip(f["start"], f["records"]):
                r = np.frombuffer(raw, _KIND)[: max(0, end - start)]
                yield pd.DataFrame({"seq": start + 1 + np.arange(len(r)), "ts_ns": r["ms"] * 1_000_000, "bid_u": r["bid"].astype("i8"), "ask_u": r["ask"].astype("i8"), "flags": r["flags"].astype("i2")})

    ready = pieces.join(members.select("part", "place", "before"), ["part", "place"]).select((F.col("before") + F.col("at")).alias("start"), "records")
    return ready.where(F.col("start") < end).mapInPandas(run, "seq bigint, ts_ns bigint, bid_u bigint, ask_u bigint, flags smallint")
