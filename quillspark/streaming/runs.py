"""Runs of a stream over the files that are there, which can be stopped and go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet table at ``path``, be it a folder or one file, with that table's schema."""
    table = spark.read.parquet(path)
    files, whole = table.inputFiles(), path.rstrip("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == whole.rpartition("/")[2]:
        whole = f"{whole[:-1]}[{whole[-1]}]"  # streams read folders and patterns
    reader = spark.readStream.schema(table.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(whole)


def run_available(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """The rows that ``transform`` makes of all that is available, written below ``folder`` once each.

    The checkpoint and the sink's log in ``folder`` make a later call with the same folder go on
    after the last whole micro-batch: nothing is written twice, and files that came since are
    taken. Only rows of finished micro-batches are read.
    """
    query = transform(stream).writeStream.format("parquet").outputMode("append")
    query = query.option("checkpointLocation", f"{folder}/progress").option("path", f"{folder}/rows")
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(transform(stream).schema).parquet(f"{folder}/rows")
