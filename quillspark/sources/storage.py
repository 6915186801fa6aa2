"""A small file store over Hadoop's file systems, and its metadata as a DataFrame.

Paths are opened as given, on whatever file system their scheme names. ``base_url`` is for
URLs only. Signed URLs are plain URLs here, and etags are empty.
"""

from __future__ import annotations

import io
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from typing import BinaryIO, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.strings import WHITESPACE


@dataclass(frozen=True)
class StorageMetadata:
    path: str
    size: int
    content_type: str | None
    last_modified: datetime
    etag: str = ""


@dataclass(frozen=True)
class SignedUrlOptions:
    expires_in: timedelta
    read_only: bool = True
    headers: Mapping[str, str] = field(default_factory=dict)

    @classmethod
    def default_read(cls, expires_in: timedelta) -> SignedUrlOptions:
        return cls(expires_in)


class StorageService(Protocol):
    """What a store can do."""

    def upload(self, path: str, data: bytes | BinaryIO, content_type: str | None = None) -> None: ...

    def download(self, path: str) -> BinaryIO: ...

    def delete(self, path: str) -> None: ...

    def exists(self, path: str) -> bool: ...

    def url(self, path: str) -> str: ...

    def signed_url(self, path: str, options: SignedUrlOptions) -> str: ...

    def metadata(self, path: str) -> StorageMetadata: ...


def clean_base(base_url: str | None) -> str:
    """Without trailing slashes, then without white space at either end; None is empty."""
    return (base_url or "").rstrip("/").strip(WHITESPACE)


def url_column(base_url: str | None, path: Column) -> Column:
    """``base/path`` for a column of paths."""
    return F.concat(F.lit(clean_base(base_url) + "/"), path.cast("string"))


#: File extensions whose type is known.
EXTENSIONS = {
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "json": "application/json", "xml": "text/xml",
    "pdf": "application/pdf", "zip": "application/zip", "gz": "application/gzip", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "mp4": "video/mp4",
    "mp3": "audio/mpeg", "parquet": "application/vnd.apache.parquet", "md": "text/markdown", "css": "text/css",
    "js": "text/javascript", "htm": "text/html", "avif": "image/avif", "webp": "image/webp", "tar": "application/x-tar",
}


def content_type(path: str) -> str | None:
    """The type that the extension names, in either case; None for others."""
    name = path.rpartition("/")[2]
    return EXTENSIONS.get(name.rpartition(".")[2].lower()) if "." in name else None


class _Download(io.RawIOBase):
    """A file of a Hadoop file system, read as it is asked for."""

    def __init__(self, source) -> None:
        self._source = source

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = bytes(self._source.readNBytes(len(buffer)))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._source.close()
        super().close()


def metadata_table(spark: SparkSession, path: str) -> DataFrame:
    """path, size, contentType, lastModified and etag of all files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(
        F.regexp_replace("path", r"^file:(//)?", "").alias("path"),
        F.col("length").alias("size"),
        F.try_element_at(kinds, extension).alias("contentType"),
        F.col("modificationTime").alias("lastModified"),
        F.lit("").alias("etag"),
    )


class FileStorage:
    """A store on any file system that Hadoop can open."""

    CHUNK = 1 << 20

    def __init__(self, spark: SparkSession, base_url: str | None = None) -> None:
        self._spark = spark
        self._jvm = spark.sparkContext._jvm
        self._base = clean_base(base_url)

    def _open(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())

    def upload(self, path: str, data: bytes | BinaryIO, content_type: str | None = None) -> None:
        """Writes a new file; an existing target or a missing folder is an error."""
        where, fs = self._open(path)
        if fs.exists(where):
            raise FileExistsError(path)
        if where.getParent() is not None and not fs.exists(where.getParent()):
            raise FileNotFoundError(f"no folder for {path}")
        out = fs.create(where, False)
        try:
            if isinstance(data, bytes | bytearray):
                out.write(bytes(data))
            else:
                while chunk := data.read(self.CHUNK):
                    out.write(chunk)
        finally:
            out.close()

    def download(self, path: str) -> BinaryIO:
        """The file as a stream, to be closed by the caller; a missing file is an error."""
        where, fs = self._open(path)
        if not fs.exists(where):
            raise FileNotFoundError(path)
        return io.BufferedReader(_Download(fs.open(where)), self.CHUNK)

    def delete(self, path: str) -> None:
        """Removes a file or an empty folder; a missing one is no error, a full folder is."""
        where, fs = self._open(path)
        if not fs.exists(where):
            return
        if fs.getFileStatus(where).isDirectory() and len(fs.listStatus(where)):
            raise OSError(f"folder is not empty: {path}")
        fs.delete(where, False)

    def exists(self, path: str) -> bool:
        where, fs = self._open(path)
        return fs.exists(where)

    def url(self, path: str) -> str:
        return f"{self._base}/{path}"

    def signed_url(self, path: str, options: SignedUrlOptions) -> str:
        """The plain URL; the options have no effect."""
        return self.url(path)

    def metadata(self, path: str) -> StorageMetadata:
        where, fs = self._open(path)
        if not fs.exists(where):
            raise FileNotFoundError(path)
        status = fs.getFileStatus(where)
        absolute = status.getPath().toUri().getPath()
        modified = datetime.fromtimestamp(status.getModificationTime() / 1000, UTC)
        return StorageMetadata(absolute, status.getLen(), content_type(path), modified)
