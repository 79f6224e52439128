"""A streaming source over growing packed tapes, whose offset is a time and how many records of that time were taken.

Files of a folder, in the order of their names, hold one tape in time order; the last may still grow and others may follow. Where a
batch ends within a millisecond, the next one begins with the records of that same millisecond which were not taken yet, so
nothing is lost or read twice, also over restarts. Records have one length, so an offset is found by bisection; nothing before it is
read. The folder must be mounted on the driver and all executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tideform.sources.packed import RECORD

SCHEMA = "ms bigint, bid_u bigint, ask_u bigint, flags int"
SPLIT = 1 << 20  # records of a partition
_START = {"ms": -(2**63), "taken": 0}


def _ms(file, k: int) -> int:
    file.seek(k * RECORD)
    return int.from_bytes(file.read(8), "little", signed=True)


def _first(file, n: int, ms: int) -> int:
    """Number of the first of n records whose time is ``ms`` or later."""
    low, high = 0, n
    while low < high:
        middle = (low + high) // 2
        low, high = (middle + 1, high) if _ms(file, middle) < ms else (low, middle)
    return low


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int


class Tape:
    """Records of a folder as they stand now: a file's whole records only, a torn tail waits."""

    def __init__(self, folder: str) -> None:
        paths = sorted(os.path.join(folder, f) for f in os.listdir(folder) if not f.startswith((".", "_")))
        self.files = [(p, n) for p in paths if (n := os.path.getsize(p) // RECORD)]

    def position(self, offset: dict) -> list[int]:
        """For each file, how many records stand before the offset."""
        left, out = offset["taken"], []
        for path, n in self.files:
            with open(path, "rb") as f:
                at, end = _first(f, n, offset["ms"]), _first(f, n, offset["ms"] + 1)
            taken = min(left, end - at)
            left -= taken
            out.append(at + taken)
        return out

    def end(self) -> dict:
        if not self.files:
            return dict(_START)
        path, n = self.files[-1]
        with open(path, "rb") as f:
            ms = _ms(f, n - 1)
        taken = 0
        for path, n in reversed(self.files):  # a millisecond may go over files
            with open(path, "rb") as f:
                at = _first(f, n, ms)
            taken += n - at
            if at:
                break
        return {"ms": ms, "taken": taken}


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split

    def initialOffset(self) -> dict:
        return dict(_START)

    def latestOffset(self) -> dict:
        return Tape(self.folder).end()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        tape = Tape(self.folder)
        out = []
        for (path, _), begin, stop in zip(tape.files, tape.position(start), tape.position(end)):
            out += [Piece(path, k, min(k + self.split, stop)) for k in range(begin, stop, self.split)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kind = np.dtype([("ms", "<i8"), ("bid", "<i4"), ("ask", "<i4"), ("flags", "u1")])
        with open(partition.path, "rb") as f:
            f.seek(partition.begin * RECORD)
            raw = np.frombuffer(f.read((partition.end - partition.begin) * RECORD), kind)
        if len(raw) != partition.end - partition.begin:
            raise OSError(f"{partition.path} became shorter")
        columns = [raw["ms"], raw["bid"].astype("i8"), raw["ask"].astype("i8"), raw["flags"].astype("i4")]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["ms", "bid_u", "ask_u", "flags"])

    def commit(self, end: dict) -> None:
        pass


class TickCursor(DataSource):
    """``spark.readStream.format("tick_cursor").load(folder)`` once registered; option ``split``: records of a partition."""

    @classmethod
    def name(cls) -> str:
        return "tick_cursor"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))
