from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import strings as S

T = None


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a session, so the shared one is made here."""
    global T
    T = F.col("t")


def run(spark, cases):
    """cases: (expression maker, text, expected); all in one row per text."""
    for k, (make, text, expected) in enumerate(cases):
        frame = spark.createDataFrame([(text,)], "t string")
        got = frame.select(make(T).alias("x")).first().x
        assert got == expected, (k, text, got, expected)


def batch(spark, make, pairs):
    """One job for many texts under the same expression."""
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string")
    got = {r.i: r.x for r in frame.select("i", make(T).alias("x")).collect()}
    for i, (text, expected) in enumerate(pairs):
        assert got[i] == expected, (text, got[i], expected)


def test_blank_and_empty(spark):
    blanks = [(None, True), ("   ", True), ("\t", True), ("\n", True), ("a", False), ("  a  ", False), ("", True), (" ", False), ("　", True)]
    batch(spark, S.is_blank, blanks)
    batch(spark, S.is_not_blank, [(t, not e) for t, e in blanks])
    empties = [(None, False), ("", True), (" ", False), ("a", False)]
    batch(spark, S.is_empty, empties)
    batch(spark, S.is_not_empty, [(t, not e) for t, e in empties])


def test_equality(spark):
    rows = [(None, None), (None, "a"), ("a", "a"), ("a", "b")]
    got = spark.createDataFrame(rows, "t string, u string").select(S.equals(T, F.col("u")).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True, False]
    rows = [
        ("ABC", "abc", True), ("abc", "def", False), (None, None, True), (None, "abc", False), (None, "", True),
        ("ß", "SS", False), ("İ", "i", True), ("ßss", "ssß", False), ("a.c", "abc", False), (r"\Ex", r"\ex", True),
    ]
    frame = spark.createDataFrame(rows, "t string, u string, e boolean")
    for r in frame.select("*", S.equals_ignore_case(T, F.col("u")).alias("x")).collect():
        assert r.x == r.e, r


def test_reverse_and_strip(spark):
    batch(spark, S.reverse, [(None, ""), ("", ""), ("abc", "cba"), ("a😀b", "b😀a")])
    batch(spark, S.strip, [("  abc  ", "abc"), (None, ""), ("\t\n x ", "x"), ("abc\n", "abc"), (" x", " x"), ("　x ", "x")])
    batch(spark, lambda c: S.strip(c, False), [(None, None), (" a ", "a")])


@pytest.mark.parametrize(
    ("text", "piece", "repeat", "expected"),
    [
        ("foobar", "foo", False, "bar"), ("foofoobar", "foo", True, "bar"), ("foobar", "bar", True, "foobar"), (None, "a", True, None),
        ("abc", None, True, "abc"), ("foofoobar", "foo", False, "foobar"), ("abc", "", True, "abc"), ("\\Ex", "\\E", True, "x"),
    ],
)
def test_strip_left(spark, text, piece, repeat, expected):
    frame = spark.createDataFrame([(text, piece)], "t string, p string")
    r = frame.select(S.strip_left(T, piece, repeat).alias("a"), S.strip_left(T, F.col("p"), repeat).alias("b")).first()
    assert (r.a, r.b) == (expected, expected)


@pytest.mark.parametrize(
    ("text", "piece", "repeat", "expected"),
    [
        ("foobar", "bar", False, "foo"), ("foobarbar", "bar", True, "foo"), ("foobar", "foo", True, "foobar"), (None, "a", True, None),
        ("abc", None, True, "abc"), ("baaa", "aa", True, "ba"), ("x\n", "x", True, "x\n"),
    ],
)
def test_strip_right(spark, text, piece, repeat, expected):
    frame = spark.createDataFrame([(text, piece)], "t string, p string")
    r = frame.select(S.strip_right(T, piece, repeat).alias("a"), S.strip_right(T, F.col("p"), repeat).alias("b")).first()
    assert (r.a, r.b) == (expected, expected)


SPLITS = [
    ("a,b,c", 0, False, ["a", "b", "c"]), ("a,,b", 0, False, ["a", "", "b"]), ("a,b,", 0, False, ["a", "b"]), ("", 0, False, [""]), (None, 0, False, []),
    ("a,b,", 0, True, ["a", "b", ""]), (",", 0, True, ["", ""]), ("", 0, True, [""]), (",", 0, False, []),
    ("a,b,c,d", 2, True, ["a", "b,c,d"]), ("a,b,c,d", 3, True, ["a", "b", "c,d"]), ("a,b,c", 2, False, ["a", "b", "c"]),
    ("a,,b,", 3, True, ["a", "", "b,"]), ("a,,b,", 0, True, ["a", "", "b", ""]), (None, 2, True, []), ("a,b,", -1, False, ["a", "b", ""]), ("a,b", 1, True, ["a,b"]),
]
RSPLITS = [
    ("a,b,c,d", 2, True, ["a,b,c", "d"]), ("a,b,c,d", 3, True, ["a,b", "c", "d"]), ("a,b,c,d", 10, True, ["a", "b", "c", "d"]),
    ("a,,b,", 3, True, ["a,", "b", ""]), ("a,,b,", 0, True, ["a", "", "b", ""]), ("a,b,", 0, False, ["a", "b"]), ("abc", 2, True, ["abc"]), ("", 2, True, [""]),
    (None, 2, True, []), ("a,b,c", 2, False, ["a,b", "c"]), (",", 2, False, []), ("a,b,c", 1, False, ["a,b,c"]), ("a,b,c,", 2, True, ["a,b,c", ""]),
]


def test_split_vectors(spark):
    run(spark, [(lambda c, n=n, p=p: S.split(c, ",", n, p), t, e) for t, n, p, e in SPLITS])
    run(spark, [(lambda c, n=n, p=p: S.rsplit(c, ",", n, p), t, e) for t, n, p, e in RSPLITS])
    run(spark, [(lambda c: S.split(c, r"\d", 2, True), "a1b2c", ["a", r"b\dc"]), (lambda c: S.split(c, "", 0, True), "abc", ["a", "b", "c", ""])])
    with pytest.raises(ValueError, match="required"):
        S.split(T, None)


def model(text, limit, preserve, right):
    if text is None:
        return []
    parts = re.split(",", text)
    if not preserve and limit >= 0 and len(parts) > 1:
        while parts and parts[-1] == "":
            parts.pop()
    if limit > 0 and (preserve or right) and len(parts) > limit:
        cut = len(parts) - limit + 1
        return [",".join(parts[:cut]), *parts[cut:]] if right else [*parts[: limit - 1], ",".join(parts[limit - 1 :])]
    return parts


@pytest.mark.parametrize("right", [False, True])
@pytest.mark.parametrize("preserve", [False, True])
@pytest.mark.parametrize("limit", [-1, 0, 1, 2, 3])
def test_split_against_model(spark, limit, preserve, right):
    rng = random.Random(limit + 10 * preserve)
    texts = ["".join(rng.choice("ab,,") for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None]
    f = S.rsplit if right else S.split
    batch(spark, lambda c: f(c, ",", limit, preserve), [(t, model(t, limit, preserve, right)) for t in texts])


def test_contains_and_case(spark):
    rows = [("Hello World", "Hello", True), ("", "Hello", False), ("   ", "Hello", False), (None, "Hello", False), ("Hello", None, False), ("   ", " ", False), ("abc", "", True)]
    frame = spark.createDataFrame(rows, "t string, u string, e boolean")
    for r in frame.select("*", S.contains(T, F.col("u")).alias("x")).collect():
        assert r.x == r.e, r
    batch(spark, S.to_lower, [("HELLO", "hello"), ("", ""), ("   ", "   "), (None, None)])
    batch(spark, S.to_upper, [("hello", "HELLO"), (None, None), ("straße", "STRASSE")])
    batch(spark, S.capitalize, [("hELLO", "Hello"), ("a", "A"), ("", ""), ("   ", "   "), (None, None), ("ßa", "SSa")])


def test_word_capitalize(spark):
    pairs = [
        ("hello world from here", "Hello World From Here"), ("sPeCiFiCaTiOn", "Specification"), ("Unicode Space", "Unicode Space"), (None, None), ("", ""),
        ("   ", "   "), ("multiple   spaces", "Multiple   Spaces"), ("a\tb", "A\tb"), ("été ﬁn", "Été Fin"),
    ]
    batch(spark, S.word_capitalize, pairs)


def test_strings_on_a_stream(spark, tmp_path):
    from quillspark.streaming.projections import project

    spark.createDataFrame([("hELLO",), (" ",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    query = project(stream, {"x": S.capitalize(T)}, S.is_not_blank(T)).writeStream.format("memory").queryName("capitalized").start()
    query.processAllAvailable()
    query.stop()
    assert [r.x for r in spark.table("capitalized").collect()] == ["Hello"]


def test_nfkc_of_plain_and_null_text(spark):
    from quillspark.functions.nfkc import nfkc

    df = spark.createDataFrame([("plain",), (None,), ("ﬁn\u00a0x",), ("",)], "t string")
    assert [r.t for r in df.select(nfkc(F.col("t")).alias("t")).collect()] == ["plain", None, "fin x", ""]
    assert [r.t for r in df.limit(2).select(nfkc(F.col("t")).alias("t")).collect()] == ["plain", None]


def test_equals_ignore_case_with_columns(spark):
    rows = [("ABC", "abc", True), ("abc", "abcd", False), ("", None, True), ("a.c", "abc", False), ("ÄÖ", "äö", True), ("ß", "SS", False)]
    df = spark.createDataFrame(rows, "a string, b string, e boolean")
    assert df.where(S.equals_ignore_case(F.col("a"), F.col("b")) != F.col("e")).count() == 0
