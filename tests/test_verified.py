"""Cursor source over restarts; verified imports; archives."""

import hashlib
import os
import random
import struct
import zipfile

import pytest

from tideform.sources import packed, verified
from tideform.streaming.cursor import Tape, TickCursor


def records(seed, n, start=1_000):
    rnd, ms, out = random.Random(seed), start, []
    for k in range(n):
        ms += rnd.choice([0, 0, 0, 1, 7])
        out.append((ms, 100 + k, 102 + k, k % 200))
    return out


def raw(rows):
    return b"".join(struct.pack("<qiiB", *r) for r in rows)


def test_cursor_within_a_millisecond(spark, tmp_path):
    """Batches and restarts end within runs of equal times, over files, and with half a record at the end."""
    spark.dataSource.register(TickCursor)
    folder = tmp_path / "tape"
    folder.mkdir()
    rows = records(1, 400)
    same = [(rows[-1][0], 9000 + k, 9001, 1) for k in range(30)]
    later = [(rows[-1][0] + k // 3, 20_000 + k, 1, 2) for k in range(50)]
    every = [*rows, *same, *later]
    steps = [(100, "a"), (137, "a"), (405, "b"), (431, "b"), (431, "c"), (len(every), "c")]
    seen, at = [], 0
    for k, (upto, name) in enumerate(steps):
        whole = raw(every[at:upto])
        with open(folder / f"{name}.bin", "ab") as f:
            f.write(whole)
        tail = raw(every[upto : upto + 1])[:9]
        (folder / "_partial").write_bytes(tail)  # not part of the tape
        at = upto
        q = spark.readStream.format("tick_cursor").option("split", "64").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start() if k % 2 else (
            spark.readStream.format("tick_cursor").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        seen = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
        assert seen == sorted(every[:upto])
    with open(folder / "c.bin", "ab") as f:
        f.write(raw(every[:1])[:9])
    assert Tape(str(folder)).end()["ms"] == every[-1][0]


@pytest.fixture
def tape(spark, tmp_path):
    rows = records(2, 5000)
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:3000], rows[3000:])):
        (tmp_path / "in" / f"{k}.bin").write_bytes(raw(part))
    digests = {f: hashlib.sha256((tmp_path / "in" / f).read_bytes()).hexdigest() for f in ("0.bin", "1.bin")}
    return str(tmp_path / "in"), rows, digests


def test_verified_import(spark, tape, tmp_path):
    path, rows, digests = tape
    good = verified.Contract(digests, 5000, rows[0][0] * 1_000_000, rows[-1][0] * 1_000_000, 6000)

    def run(contract, out):
        verified.commit_verified(packed.read_packed(spark, path), verified.file_digests(spark, path), contract, out)

    run(good, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5000
    with pytest.raises(ValueError, match="exists"):
        run(good, str(tmp_path / "out"))
    bad = [
        ("bytes differ: 1.bin", {"digests": digests | {"1.bin": "0" * 64}}), ("bytes differ: 2.bin", {"digests": digests | {"2.bin": "0" * 64}}), ("bytes differ: 0.bin", {"digests": {"1.bin": digests["1.bin"]}}),
        ("not 4999", {"rows": 4999}), ("budget", {"max_rows": 4999}), ("records from", {"first_ns": 0}), ("records from", {"last_ns": 0}),
    ]
    for what, change in bad:
        with pytest.raises(ValueError, match=what):
            run(verified.Contract(**{**good.__dict__, **change}), str(tmp_path / "no"))
        assert not [f for f in os.listdir(tmp_path) if f.startswith("no")]
    with open(os.path.join(path, "1.bin"), "r+b") as f:  # one byte flipped after the contract was made
        f.seek(16)
        f.write(b"\xff")
    with pytest.raises(ValueError, match="bytes differ: 1.bin"):
        run(good, str(tmp_path / "no"))
    with open(os.path.join(path, "1.bin"), "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="truncated"):
        run(good, str(tmp_path / "no"))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("no")]


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verified, "PIECE", 100)
    rows = records(3, 1000)
    members = {"m0": rows[:333], "m1": [], "m2": rows[333:340], "z": rows[340:]}
    for part, names in (("p1.zip", ["m0", "m1"]), ("p2.zip", ["m2", "z"])):
        with zipfile.ZipFile(tmp_path / part, "w", zipfile.ZIP_DEFLATED) as z:
            for n in names:
                z.writestr(n, raw(members[n]))
    digests = {n: hashlib.sha256(raw(r)).hexdigest() for n, r in members.items()}
    path = str(tmp_path / "*.zip")
    for first in (None, 0, 1, 100, 333, 338, 999, 1000):
        got = sorted(verified.read_archive(spark, path, digests, first).collect())
        want = rows if first is None else rows[:first]
        assert [tuple(r) for r in got] == [(k + 1, r[0] * 1_000_000, *r[1:]) for k, r in enumerate(want)]
    assert {r.member: (r.n, r.sha256) for r in verified.archive_members(spark, path).collect()} == {n: (len(r), digests[n]) for n, r in members.items()}
    with pytest.raises(ValueError, match="fewer than 1001"):
        verified.read_archive(spark, path, digests, 1001)
    for odd in (digests | {"m2": "0"}, {n: d for n, d in digests.items() if n != "z"}, digests | {"more": "0"}):
        with pytest.raises(ValueError, match="members differ"):
            verified.read_archive(spark, path, odd)
    data = bytearray((tmp_path / "p2.zip").read_bytes())
    data[120] ^= 0xFF
    (tmp_path / "p2.zip").write_bytes(bytes(data))
    with pytest.raises(Exception):
        verified.read_archive(spark, path).collect()
    with zipfile.ZipFile(tmp_path / "p2.zip", "w") as z:
        z.writestr("torn", raw(rows[:3])[:-1])
    with pytest.raises(Exception, match="part of a record"):
        verified.read_archive(spark, path).collect()
