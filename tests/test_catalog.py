"""Every query with a DuckDB counterpart gives the same rows on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
PLAIN = [k for k in entry.catalog.QUERIES if k in ORACLES]


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.parametrize("name", PLAIN)
def test_parity(spark, sf_dir, database, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    found = database.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in found.fetchall())
    assert got == expected


def test_entry_and_metadata(spark, sf_dir):
    assert entry.entry(spark).columns == ["event_id", "k", "kind"]
    from quillspark.sources.storage import metadata_table

    rows = metadata_table(spark, sf_dir).collect()
    assert {Path(r.path).name for r in rows} == {p.name for p in Path(sf_dir).glob("*.parquet")}


def test_struct_paths_prune_columns(spark, tmp_path):
    from quillspark.operators.paths import path_get

    spark.sql("SELECT named_struct('a', named_struct('b', 1, 'c', 'x'), 'd', 2) AS r").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    plan = frame.select(path_get(frame["r"], frame.schema["r"].dataType, "a.b").alias("y"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "struct<r:struct<a:struct<b:int>>>" in text
