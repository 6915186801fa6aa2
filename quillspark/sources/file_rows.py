"""Files as rows and rows as files, read and written by the executors.

``FileRows`` is a Python data source, ``filerows``: its reader gives a row for each file below a
folder, its writer makes a file of each row ``(path, content)``. Listing is the driver's part;
contents never pass through it.

A write has two phases. Tasks write to a pending folder of their attempt, below the target; the
commit renames what the attempts that count have written to its place. A task that is killed or
run twice so leaves nothing in the store, and an aborted write removes its pending folder.
Renames are one by one: a reader that comes in between sees some of the files, each whole.

Any file system that Arrow knows can be named (a plain path, ``file:``, ``hdfs:``, ``s3:``,
``gs:``); all executors and the driver must see it.

Defined results: paths are below the folder and must not leave it, must not be empty, and two
rows must not have the same one (the whole write is an error then); a file that is there is
replaced only in mode ``overwrite``, otherwise it is an error; NULL content is an empty file;
an empty table writes nothing.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .storage import content_type

SCHEMA = "path string, size bigint, contentType string, lastModified timestamp, etag string, content binary"
#: Bytes of files that a task reads at least, if there are as many.
SPLIT = 64_000_000
PENDING = "_pending"
#: Times that removing a folder is tried again.
RETRIES = 10


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder or folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").strip("/")
    found, root = fs.FileSystem.from_uri(folder)
    return found, root.rstrip("/")


def _below(path: str | None) -> str:
    """The path in its plain form; an error if it is none below the folder."""
    plain = posixpath.normpath(path) if path else ""
    if not plain or plain in (".", "..") or plain.startswith(("/", "../", f"{PENDING}-")):
        raise ValueError(f"no path below the store: {path!r}")
    return plain


@dataclass
class Files(InputPartition):
    paths: list[str]

    def __post_init__(self) -> None:
        super().__init__(None)


@dataclass
class Written(WriterCommitMessage):
    """(pending file, path below the folder) of a task."""

    files: list[tuple[str, str]]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, split: int) -> None:
        self.folder, self.split = folder, split

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.folder)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out, held = [Files([])], 0
        for info in sorted(found, key=lambda i: i.path):
            if info.type != fs.FileType.File or f"/{PENDING}-" in info.path:
                continue
            if held >= self.split:
                out, held = [*out, Files([])], 0
            out[-1].paths.append(info.path)
            held += info.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, root = _open(self.folder)
        for path in partition.paths:
            info = store.get_file_info(path)
            with store.open_input_stream(path) as source:
                yield path.removeprefix(f"{root}/"), info.size, content_type(path), info.mtime, "", source.read()


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.pending = f"{PENDING}-{uuid.uuid4().hex}"
        store, root = _open(folder)
        store.create_dir(f"{root}/{self.pending}")

    def write(self, rows: Iterator) -> Written:
        store, root = _open(self.folder)
        attempt = f"{root}/{self.pending}/{uuid.uuid4().hex}"
        # Not its parents: a task that outlives an aborted write must not bring its folder back.
        store.create_dir(attempt, recursive=False)
        files = []
        for n, row in enumerate(rows):
            path = _below(row["path"])
            with store.open_output_stream(f"{attempt}/{n}") as out:
                out.write(bytes(row["content"] or b""))
            files.append((f"{attempt}/{n}", path))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _open(self.folder)
        moves = [move for m in messages if m is not None for move in m.files]
        try:
            if len({path for _, path in moves}) < len(moves):
                raise ValueError("two rows have the same path")
            if not self.overwrite:
                there = store.get_file_info([f"{root}/{path}" for _, path in moves])
                taken = [i.path for i in there if i.type != fs.FileType.NotFound]
                if taken:
                    raise FileExistsError(taken[0])
            for folder in sorted({posixpath.dirname(path) for _, path in moves}):
                store.create_dir(f"{root}/{folder}".rstrip("/"))
            for pending, path in moves:
                store.move(pending, f"{root}/{path}")
        finally:
            self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.folder))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        """Removes the pending folder; tasks that are about to be killed may still write to it meanwhile."""
        pending = f"{root}/{self.pending}"
        for left in range(RETRIES, -1, -1):
            if store.get_file_info(pending).type != fs.FileType.Directory:
                return
            try:
                store.delete_dir(pending)
            except OSError:
                if not left:
                    raise
                time.sleep(0.2)


class FileRows(DataSource):
    """Options: ``path``, the folder; ``split``, bytes of files in a task of the reader."""

    @classmethod
    def name(cls) -> str:
        return "filerows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row of ``files(path, content)`` below ``folder``: all of them, or none."""
    files.sparkSession.dataSource.register(FileRows)
    rows = files.select(F.col("path").cast("string"), F.col("content").cast("binary"))
    rows.write.format("filerows").mode("overwrite" if overwrite else "append").option("path", folder).save()


def read_files(spark: SparkSession, folder: str, split: int = SPLIT) -> DataFrame:
    """path (below ``folder``), size, contentType, lastModified, etag and content of all files."""
    spark.dataSource.register(FileRows)
    return spark.read.format("filerows").option("path", folder).option("split", split).load()


def delete_files(files: DataFrame, folder: str) -> DataFrame:
    """Deletes the files that ``files(path)`` names, in tasks, when the result is read: ``path`` and whether it was there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            there = []
            for path in batch.column(0).to_pylist():
                at = f"{root}/{_below(path)}"
                there.append(store.get_file_info(at).type == fs.FileType.File)
                if there[-1]:
                    store.delete_file(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there, pa.bool_())], names=["path", "there"])

    return files.select(F.col("path").cast("string")).mapInArrow(run, "path string, there boolean")
