from __future__ import annotations

from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import clone as C
from quillspark.sources import storage as S


def frame(spark, data, *fields):
    return spark.createDataFrame([data], T.StructType(list(fields)))


def test_plain_copies_are_equal(spark):
    user = T.StructType.fromDDL("name string, address struct<city string>")
    lists = T.MapType(T.StringType(), T.ArrayType(T.IntegerType()))
    df = frame(spark, (("A", ("X",)), {"k": [1, 2]}, None), T.StructField("u", user), T.StructField("m", lists), T.StructField("n", user))
    copy = C.deep_clone(df)
    assert copy.collect() == df.collect()
    assert copy.schema == df.schema


def test_ignored_fields_and_types(spark):
    secret = T.StructType([T.StructField("public", T.StringType()), C.marked(T.StructField("key", T.StringType()))])
    df = frame(spark, (("p", "k"), [("p", "k"), None]), T.StructField("s", secret), T.StructField("a", T.ArrayType(secret)))
    got = C.deep_clone(df).first()
    assert (got.s.public, got.s.key) == ("p", None)
    assert got.a[0].key is None
    assert got.a[1] is None
    assert C.deep_clone(df).schema["s"].dataType["key"].metadata == {C.IGNORE: True}
    assert C.deep_clone(df).schema.simpleString() == df.schema.simpleString()
    gone = C.ClonerBuilder().ignore_type(secret).build().clone(df).first()
    assert gone.s is None
    assert gone.a == [None, None]


def test_immutable_mark_shares(spark):
    inner = T.StructType([C.marked(T.StructField("key", T.StringType()))])
    df = frame(spark, (("k",),), C.marked(T.StructField("s", inner), C.IMMUTABLE))
    assert C.deep_clone(df).first().s.key == "k"


class Mocked:
    def supports(self, kind):
        return isinstance(kind, T.StringType)

    def copy(self, column, kind, cloner):
        return F.lit("Mocked")


class Other(Mocked):
    def copy(self, column, kind, cloner):
        return F.lit("Other")


def test_custom_strategies_last_wins(spark):
    df = frame(spark, ({"a": "b"}, ["x"]), T.StructField("m", T.MapType(T.StringType(), T.StringType())), T.StructField("l", T.ArrayType(T.StringType())))
    got = C.ClonerBuilder().register_strategy(Mocked()).register_strategy(Other()).build().clone(df).first()
    assert got.m == {"Other": "Other"}
    assert got.l == ["Other"]


def test_urls(spark):
    assert S.FileStorage(spark, "http://h/x//").url("a.txt") == "http://h/x/a.txt"
    assert S.FileStorage(spark, None).url("a.txt") == "/a.txt"
    assert S.FileStorage(spark, "http://h").url("/a") == "http://h//a"
    assert S.FileStorage(spark, "http://h/ ").url("a") == "http://h//a"
    options = S.SignedUrlOptions.default_read(timedelta(hours=1))
    assert options.read_only
    assert options.headers == {}
    assert S.FileStorage(spark, "http://h").signed_url("a", options) == "http://h/a"


def test_files(spark, tmp_path):
    store = S.FileStorage(spark)
    path = str(tmp_path / "a.txt")
    store.upload(path, b"hello")
    with store.download(path) as source:
        assert source.read(2) + source.read() == b"hello"
    assert store.exists(path)
    with pytest.raises(FileExistsError):
        store.upload(path, b"again")
    with pytest.raises(FileNotFoundError):
        store.upload(str(tmp_path / "no" / "b.txt"), b"x")
    with (tmp_path / "a.txt").open("rb") as stream:
        store.upload(str(tmp_path / "c.json"), stream)
    meta = store.metadata(path)
    assert (meta.path, meta.size, meta.content_type, meta.etag) == (path, 5, "text/plain", "")
    rows = {r.path: r for r in S.metadata_table(spark, str(tmp_path)).collect()}
    assert rows[path].size == 5
    assert rows[path].contentType == "text/plain"
    with pytest.raises(OSError, match="empty"):
        store.delete(str(tmp_path))
    store.delete(path)
    store.delete(path)
    assert not store.exists(path)
    with pytest.raises(FileNotFoundError):
        store.download(path)


def test_download_takes_names_as_they_are_and_streams(spark, tmp_path):
    store = S.FileStorage(spark)
    path = str(tmp_path / "a[1]{x}*.TXT")
    data = bytes(range(256)) * 9000
    store.upload(path, data)
    with store.download(path) as source:
        assert source.read() == data
    assert store.metadata(path).content_type == "text/plain"


def test_types_of_files_agree(spark, tmp_path):
    for name in ("a.md", "b.parquet", "c.unknown", "noextension", "d.JPG"):
        (tmp_path / name).write_bytes(b"x")
    listed = {r.path.rpartition("/")[2]: r.contentType for r in S.metadata_table(spark, str(tmp_path)).collect()}
    assert listed == {n: S.content_type(n) for n in listed}
    assert (listed["a.md"], listed["c.unknown"], listed["d.JPG"]) == ("text/markdown", None, "image/jpeg")


def test_types_left_out_as_keys_are_an_error(spark):
    kind = T.MapType(T.StringType(), T.IntegerType())
    df = frame(spark, ({"a": 1},), T.StructField("m", kind))
    with pytest.raises(ValueError, match="keys"):
        C.ClonerBuilder().ignore_type(T.StringType()).build().clone(df)


def test_types_compare_without_nullability_and_metadata(spark):
    inner = T.StructType([T.StructField("key", T.StringType())])
    strict = T.StructType([T.StructField("key", T.StringType(), False, {"a": 1})])
    df = frame(spark, (("k",),), T.StructField("s", inner))
    assert C.ClonerBuilder().ignore_type(strict).build().clone(df).first().s is None
    left_out = T.StructType([C.marked(T.StructField("key", T.StringType()), C.TRANSIENT)])
    df = frame(spark, (("k",),), T.StructField("s", left_out))
    assert C.deep_clone(df).first().s.key is None
    assert C.ClonerBuilder().immutable_type(inner).build().clone(df).first().s.key == "k"
