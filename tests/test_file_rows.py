"""Files written and read by the executors."""

from __future__ import annotations

import os
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillspark.sources import file_rows as R

ROWS = [("a.txt", b"one"), ("b/c.json", b"{}"), ("b/d/e.bin", bytes(range(256))), ("empty", None), ("./b/x.PDF", b"x" * 100_000)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, content binary").repartition(parts)


def left(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())


def test_rows_become_files_and_rows_again(spark, tmp_path):
    folder = str(tmp_path / "store")
    assert R.read_files(spark, folder).count() == 0
    R.write_files(frame(spark, ROWS), folder)
    got = {r.path: (r.size, r.contentType, bytes(r.content)) for r in R.read_files(spark, folder).collect()}
    assert got == {
        "a.txt": (3, "text/plain", b"one"), "b/c.json": (2, "application/json", b"{}"), "b/d/e.bin": (256, None, bytes(range(256))),
        "empty": (0, None, b""), "b/x.PDF": (100_000, "application/pdf", b"x" * 100_000),
    }
    times = {r.path: r.t for r in R.read_files(spark, folder).select("path", F.unix_micros("lastModified").alias("t")).collect()}
    assert all(abs(t / 1e6 - os.stat(f"{folder}/{p}").st_mtime) < 0.01 for p, t in times.items())
    assert R.read_files(spark, f"file://{folder}", split=1).rdd.getNumPartitions() == 5
    assert not [p for p in os.listdir(folder) if p.startswith("_pending")]
    R.write_files(frame(spark, ROWS).limit(0), folder)
    assert len(left(folder)) == 5


@pytest.mark.parametrize("bad", [[("../out.txt", b"x")], [("/abs", b"x")], [("", b"x")], [(None, b"x")], [("a/../../y", b"x")], [("same", b"1"), ("./same", b"2")]])
def test_bad_paths_write_nothing_at_all(spark, tmp_path, bad):
    folder = str(tmp_path / "store")
    with pytest.raises(PySparkException):
        R.write_files(frame(spark, [*ROWS, *bad]), folder)
    assert left(folder) == []
    assert left(tmp_path) == []


def test_files_that_are_there_stay_unless_told_otherwise(spark, tmp_path):
    folder = str(tmp_path / "store")
    R.write_files(frame(spark, [("a.txt", b"old")]), folder)
    with pytest.raises(PySparkException, match="FileExistsError"):
        R.write_files(frame(spark, [("new.txt", b"n"), ("a.txt", b"new")]), folder)
    assert left(folder) == ["a.txt"] and Path(folder, "a.txt").read_bytes() == b"old"
    R.write_files(frame(spark, [("a.txt", b"new")]), folder, overwrite=True)
    assert Path(folder, "a.txt").read_bytes() == b"new"


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    folder = str(tmp_path / "store")
    rows = spark.range(0, 400, numPartitions=4).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"),
        F.when(F.col("id") == 399, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.lit("x")).cast("binary").alias("content"),
    )
    with pytest.raises(PySparkException):
        R.write_files(rows, folder)
    assert left(folder) == []


def test_attempts_that_do_not_count_leave_no_file(tmp_path):
    """Two attempts of one task, of which the driver takes one."""
    writer = R._Writer(str(tmp_path), False)
    rows = [{"path": f"p{k}", "content": b"x"} for k in range(3)]
    first, second = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.files != second.files
    writer.commit([second, None])
    assert left(tmp_path) == ["p0", "p1", "p2"]
    lost = R._Writer(str(tmp_path), False)
    lost.write(iter([{"path": "q", "content": b"x"}]))
    assert R._Reader(str(tmp_path), 10**9).partitions()[0].paths == [f"{tmp_path}/p{k}" for k in range(3)]  # none pending
    lost.abort([])
    assert left(tmp_path) == ["p0", "p1", "p2"]


def test_deleting(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(f"d{k % 3}/{k}", b"x") for k in range(50)]
    R.write_files(frame(spark, rows), folder)
    random.Random(1).shuffle(rows)
    gone = R.delete_files(frame(spark, [*rows[:20], ("nowhere", b"")]), folder).collect()
    assert {(r.path, r.there) for r in gone} == {*((p, True) for p, _ in rows[:20]), ("nowhere", False)}
    assert left(folder) == sorted(p for p, _ in rows[20:])
