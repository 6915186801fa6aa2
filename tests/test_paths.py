from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators import paths as P
from quillspark.operators.paths import Index, Property, parse

TEXT = T.StringType()
USER = T.StructType([T.StructField("username", TEXT), T.StructField("address", T.StructType([T.StructField("city", TEXT)]))])
ACCOUNT = T.StructType([T.StructField("id", TEXT), T.StructField("balance", T.IntegerType())])


@pytest.mark.parametrize(
    ("path", "tokens"),
    [
        ("a..b", [Property("a"), Property("b")]), (".", []), ("[ 0 ]", [Index(0)]), ("[-1]", [Property("-1")]), ("[]", [Property("")]),
        ("a?", [Property("a", True)]), ("a??", [Property("a?", True)]), ("[0]?", [Index(0)]), ("x/y", [Property("x/y")]),
        ("a['k.v'].b", [Property("a"), Property("k.v"), Property("b")]), ('["k"]', [Property("k")]), ("[name]", [Property("name")]),
        ("users[0].address.city", [Property("users"), Index(0), Property("address"), Property("city")]),
    ],
)
def test_parse(path, tokens):
    assert list(parse(path)) == tokens


@pytest.mark.parametrize("path", ["  ", None, "users[0", "[']", "[99999999999]"])
def test_bad_paths(path):
    with pytest.raises(ValueError, match="."):
        parse(path)


def value(spark, data, kind, expression):
    frame = spark.createDataFrame([(data,)], T.StructType([T.StructField("x", kind)]))
    return frame.select(expression(F.col("x")).alias("y")).first().y


def test_struct(spark):
    user = ("dev", ("Bangkok",))
    get = lambda p, strict=False: value(spark, user, USER, lambda c: P.path_get(c, USER, p, strict))
    assert get("address.city") == "Bangkok"
    assert get("Username") is None
    assert get("address.nope.x") is None
    assert get("nope?", True) is None
    with pytest.raises(P.PathError):
        get("nope", True)
    new = value(spark, ("ACC-01", 100), ACCOUNT, lambda c: P.path_set(c, ACCOUNT, "balance", F.lit(250), T.IntegerType()))
    assert (new.id, new.balance) == ("ACC-01", 250)
    made = value(spark, ("dev", None), USER, lambda c: P.path_set(c, USER, "address.city", F.lit("X"), T.StringType()))
    assert made.address.city == "X"
    same = value(spark, user, USER, lambda c: P.path_set(c, USER, "username.below", F.lit("X"), T.StringType()))
    assert same.username == "dev"


def test_map_and_array(spark):
    kind = T.MapType(T.StringType(), T.StringType())
    assert value(spark, {}, kind, lambda c: P.path_set(c, kind, "key", F.lit("value"), T.StringType())) == {"key": "value"}
    assert value(spark, {"a": "1"}, kind, lambda c: P.path_set(c, kind, "a", F.lit("2"), T.StringType())) == {"a": "2"}
    assert value(spark, {"k.v": "1"}, kind, lambda c: P.path_get(c, kind, "['k.v']")) == "1"
    assert value(spark, None, kind, lambda c: P.path_get(c, kind, "a")) is None
    words = T.ArrayType(T.StringType())
    put = lambda data, p: value(spark, data, words, lambda c: P.path_set(c, words, p, F.lit("third"), T.StringType()))
    assert put([], "[2]") == [None, None, "third"]
    assert put(None, "[0]") == ["third"]
    assert put(["java", "spring"], "[1]") == ["java", "third"]
    assert value(spark, ["a"], words, lambda c: P.path_get(c, words, "[7]")) is None
    with pytest.raises(P.PathError):
        P.path_get(F.col("x"), words, "name")
    with pytest.raises(P.PathError):
        P.path_get(F.col("x"), kind, "[0]")


@pytest.mark.parametrize(
    ("text", "path", "expected"),
    [
        ("{}", "meta.info.version", {"meta": {"info": {"version": 7}}}), ('{"users": []}', "users[0].address.city", {"users": [{"address": {"city": 7}}]}),
        ('{"a": 5}', "a.b", {"a": 5}), ('{"a": 5}', "a[0]", {"a": [7]}), ('{"a": null}', "a.b", {"a": {"b": 7}}), ('{"a": [1]}', "a[2]", {"a": [1, None, 7]}),
        (None, "x", {"x": 7}),
    ],
)
def test_json_set(spark, text, path, expected):
    frame = spark.createDataFrame([(text,)], "x string")
    got = frame.select(P.json_set(F.col("x"), path, F.lit(7), T.IntegerType()).alias("y")).first().y
    assert json.loads(got) == expected


@pytest.mark.parametrize(("path", "expected"), [("complex['standard.key']", "success"), ("invalid.path?", None), ("users[99].name?", None), ("complex.x.y", None)])
def test_json_get(spark, path, expected):
    frame = spark.createDataFrame([('{"complex": {"standard.key": "success", "x": 1}}',)], "x string")
    assert frame.select(P.json_get(F.col("x"), path).alias("y")).first().y == expected


def reference_get(value, tokens):
    for token in tokens:
        if value is None:
            return None
        if isinstance(token, Index):
            value = value[token.at] if isinstance(value, list) and token.at < len(value) else None
        else:
            value = value.get(token.name) if isinstance(value, dict) else None
    return value


def test_json_get_against_model(spark):
    rng = random.Random(1)

    def tree(depth):
        roll = rng.random()
        if depth == 0 or roll < 0.3:
            return rng.choice([None, 1, "s"])
        if roll < 0.65:
            return {k: tree(depth - 1) for k in rng.sample("abc", 2)}
        return [tree(depth - 1) for _ in range(rng.randint(0, 3))]

    roots = [tree(3) for _ in range(30)]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(roots)], "i int, x string")
    for path in ("a", "a.b", "b[0]", "[1].a", "c[1][0]", "a.b.c"):
        kind = T.VariantType()
        got = frame.select("i", F.to_json(P.path_get(F.parse_json("x"), kind, path)).alias("y")).collect()
        for r in got:
            expected = reference_get(roots[r.i], parse(path))
            assert (None if r.y is None else json.loads(r.y)) == expected, (path, roots[r.i])


def test_builder():
    with pytest.raises(ValueError, match="required"):
        P.AccessorBuilder().register_property(None)
    built = P.AccessorBuilder().register_property(P.StructAdapter(strict=True)).with_parser(lambda p: [Property(p)]).build()
    assert built.parser("a.b") == [Property("a.b")]
    assert isinstance(built.properties[0], P.StructAdapter)


def test_malformed_json_text_stays(spark):
    df = spark.createDataFrame([("{bad json",), (None,), ("[1]",), ('{"a":1}',)], "j string")
    got = [r.j for r in df.select(P.json_set(F.col("j"), "a", F.lit(7), T.IntegerType()).alias("j")).collect()]
    assert got == ["{bad json", '{"a":7}', "[1]", '{"a":7}']


def test_cached_parser():
    parser = P.CachedParser(2)
    assert parser("a.b") == P.parse("a.b")
    for path in ("c", "d", "e"):
        parser(path)
    assert parser.size() == 2
    parser.clear()
    assert parser.size() == 0
    with pytest.raises(ValueError):
        P.CachedParser(-1)
    with pytest.raises(ValueError):
        parser(" ")


WIDE = T.StructType([T.StructField(f"f{i}", TEXT) for i in range(12)])
DEEP = T.StructType([
    T.StructField("name", TEXT), T.StructField("a", WIDE), T.StructField("b", T.StructType([T.StructField("c", WIDE), T.StructField("n", T.IntegerType())])),
    T.StructField("m", T.MapType(TEXT, TEXT)), T.StructField("l", T.ArrayType(TEXT)), T.StructField("v", T.VariantType()),
])


def planned(frame):
    start = time.perf_counter()
    frame._jdf.queryExecution().executedPlan()
    return time.perf_counter() - start


def deep_rows(spark):
    wide = tuple(f"w{i}" for i in range(12))
    rows = [
        ("x", wide, (wide, 1), {"k": "1", "z": "2"}, ["p", "q"], '{"o": {"i": 1}, "arr": [1, 2]}'),
        (None, None, None, None, None, None),
        ("y", wide, (None, 2), {}, [], "[1, {}]"),
        ("z", wide, (wide, None), {"k": None}, [None], "null"),
    ]
    kind = T.StructType([*DEEP.fields[:-1], T.StructField("v", TEXT)])
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("x", kind)]))
    return frame.select("k", F.struct("x.name", "x.a", "x.b", "x.m", "x.l", F.try_parse_json("x.v").alias("v")).alias("x"))


PLACES = [
    *[f"a.f{i}" for i in range(12)], *[f"b.c.f{i}" for i in range(12)], "name", "b.n", "m.k", "m.z", "m.new", "l[0]", "l[3]", "l[1]",
    "v.o.i", "v.o.new", "v.arr[1]", "v.arr[3].deep", "v.p.q.r", "v[2]", "v[0].x", "nope", "a.nope", "name.below", "a['f3']", "b.c.f1?",
]


def as_plain(frame):
    shown = F.struct("x.name", "x.a", "x.b", "x.m", "x.l", F.to_json("x.v").alias("v"))
    return [r.x.asDict(True) for r in frame.select("k", shown.alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_many_writes_equal_single_ones(spark, seed):
    rng = random.Random(seed)
    frame = deep_rows(spark)
    kind = frame.schema["x"].dataType
    writes = [(rng.choice(PLACES), F.lit(f"new{i}"), TEXT) for i in range(50)]
    writes = [(p, F.lit(7), T.IntegerType()) if p == "b.n" else (p, v, t) for p, v, t in writes]
    at_once = frame.select("k", P.path_set_many(F.col("x"), kind, writes).alias("x"))
    assert planned(at_once) < 3
    one_by_one = frame
    for i, (path, value, value_kind) in enumerate(writes):
        one_by_one = one_by_one.select("k", P.path_set(F.col("x"), one_by_one.schema["x"].dataType, path, value, value_kind).alias("x"))
        if i % 4 == 3:  # a plan of a few writes at a time
            one_by_one = one_by_one.checkpoint()
    assert as_plain(at_once) == as_plain(one_by_one)


def test_later_writes_go_over_earlier_ones(spark):
    frame = deep_rows(spark).where("k = 0")
    kind = frame.schema["x"].dataType
    whole = F.struct(*[F.lit("-").alias(f"f{i}") for i in range(12)])
    writes = [("a.f1", F.lit("lost"), TEXT), ("a", whole, WIDE), ("a.f2", F.lit("kept"), TEXT), ("name", F.lit("n1"), TEXT), ("name", F.lit("n2"), TEXT)]
    (row,) = as_plain(frame.select("k", P.path_set_many(F.col("x"), kind, writes).alias("x")))
    assert (row["a"]["f1"], row["a"]["f2"], row["name"]) == ("-", "kept", "n2")


def test_plans_grow_with_the_writes(spark):
    kind = T.StructType([T.StructField("s", WIDE)])
    frame = spark.createDataFrame([((tuple("abcdefghijkl"),),)], T.StructType([T.StructField("x", kind)]))
    writes = [(f"s.f{i % 12}", F.lit(str(i)), TEXT) for i in range(50)]
    planned(frame.select(P.path_set_many(F.col("x"), kind, writes[:2])))  # code is loaded
    assert planned(frame.select(P.path_set_many(F.col("x"), kind, writes))) < 1
    single = F.col("x.s")
    for i in range(12):
        single = P.path_set(single, WIDE, f"f{i}", F.lit(str(i)), TEXT)
    assert planned(frame.select(single.alias("y"))) < 2
    assert list(frame.select(single.alias("y")).first().y) == [str(i) for i in range(12)]


class Failing:
    """An adapter whose steps fail in ways of their own."""

    def supports(self, kind):
        return True

    def get(self, node, name):
        raise {"key": KeyError, "type": TypeError}[name](name)

    def set(self, node, name, change):
        raise NotImplementedError


@pytest.mark.parametrize(("name", "error"), [("key", KeyError), ("type", TypeError)])
def test_a_safe_step_takes_any_error(spark, name, error):
    accessor = P.AccessorBuilder().register_property(Failing()).build()
    assert value(spark, "x", TEXT, lambda c: accessor.get(c, TEXT, name + "?")) is None
    assert value(spark, "x", TEXT, lambda c: accessor.get(c, TEXT, name + "?.below[0]")) is None
    with pytest.raises(error):
        accessor.get(F.col("x"), TEXT, name)


def test_names_that_differ_by_case_only(spark):
    kind = T.StructType([T.StructField("name", TEXT), T.StructField("Name", TEXT), T.StructField("n", T.IntegerType())])
    get = lambda p: value(spark, ("low", "High", 1), kind, lambda c: P.path_get(c, kind, p))
    assert (get("name"), get("Name"), get("n"), get("NAME")) == ("low", "High", 1, None)
    new = value(spark, ("low", "High", 1), kind, lambda c: P.path_set(c, kind, "Name", F.lit("new"), TEXT))
    assert tuple(new) == ("low", "new", 1)
    both = value(spark, None, kind, lambda c: P.path_set_many(c, kind, [("Name", F.lit("B"), TEXT), ("name", F.lit("a"), TEXT)]))
    assert tuple(both) == ("a", "B", None)


def test_strict_and_lenient_nodes_in_one_path(spark):
    record = T.StructType([T.StructField("id", TEXT)])
    bean = T.StructType([P.strict_field(T.StructField("account", record)), T.StructField("city", TEXT)])
    root = T.StructType([P.strict_field(T.StructField("users", T.ArrayType(bean))), P.strict_field(T.StructField("lax", bean), False)])
    data = ([(("A1",), "Bangkok")], (("A2",), "Paris"))
    get = lambda p, strict=False: value(spark, data, root, lambda c: P.path_get(c, root, p, strict))
    assert get("users[0].account.id") == "A1"
    assert get("lax.nope") is None
    assert get("lax.nope", True) is None  # the field says more than the adapter
    assert get("nope") is None
    for path in ("users[0].nope", "lax.account.nope", "users[0].account.nope"):
        with pytest.raises(P.PathError):
            get(path)
    assert get("lax.account.nope?") is None
    assert get("users[9].account.id") is None
    with pytest.raises(P.PathError):
        get("nope", True)
    put = lambda p: value(spark, data, root, lambda c: P.path_set(c, root, p, F.lit("new"), TEXT))
    assert put("lax.nope").lax.city == "Paris"
    assert put("lax.account.id").lax.account.id == "new"
    with pytest.raises(P.PathError):
        put("lax.account.nope")
