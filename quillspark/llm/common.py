"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import make_importable

#: Characters of text that one step of a vectorised loop takes at once.
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; null texts become empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor`` (null ids: remainder of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % divisor


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = named or tempfile.mkdtemp(prefix="quillspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a small table that share a partition.
ROWS_PER_PART = 100_000


def settled(df: DataFrame, rows: int = ROWS_PER_PART) -> DataFrame:
    """A checkpoint in as few partitions as its rows need, so that small tables don't shuffle as large ones do."""
    done = checkpoint(df)
    return done.coalesce(max(1, -(-done.count() // rows)))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that are written and read again."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def release() -> None:
    """Gives freed memory back to the system; later tasks reuse the worker, and executors have one limit for all of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def row_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into row slices of about ``limit`` bytes of text, whole texts only."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index("text"))).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < len(sizes):
            yield batch.slice(start)
    release()


def text_slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same slices, with their texts."""
    for part in row_slices(batches, limit):
        yield part, part.column(part.schema.get_field_index("text")).to_pylist()


#: Ids up to which a list of them is broadcast (16 MB); a longer one is shuffled.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is not in ``ids(doc_id)``; rows with a null id stay."""
    gone = checkpoint(ids.select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["__gone"], "left_anti")
