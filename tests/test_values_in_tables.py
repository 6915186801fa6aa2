"""Paths from columns, variants of any depth, object graphs, and streams that are stopped."""

from __future__ import annotations

import json
import random
import unicodedata
from collections import defaultdict

import pytest
from pyspark.errors import PySparkException, StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions import strings as S
from quillspark.functions.nfkc import nfkc
from quillspark.operators import graph_clone as G
from quillspark.operators import path_columns as PC
from quillspark.operators import paths as P
from quillspark.operators import variant_clone as V
from quillspark.streaming import runs

GRAMMAR = ["a", ".", "..", "[0]", "[12]", "[ 1 ]", "['k.v']", '["x"]', "[n]", "[]", "?", "a?", "b??", "[-1]", "é", "]", "[00]", " ", "[2147483647]", "[99999999999]", "[']", "[", "['a]", "\t"]


def odd_paths(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices(GRAMMAR, k=rng.randrange(0, 6))) for _ in range(n)] + [None, ".", "a[b[c]d", "[']']", "x y.z"]


def by_parser(path):
    try:
        return [(t.name, None) if isinstance(t, P.Property) else (None, t.at) for t in P.parse(path)]
    except ValueError:
        return None


@pytest.mark.parametrize("seed", range(3))
def test_the_grammar_as_an_expression_equals_the_parser(spark, seed):
    paths = odd_paths(seed)
    frame = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    for r in frame.select("i", PC.tokens(F.col("path")).alias("t")).collect():
        assert (None if r.t is None else [tuple(t) for t in r.t]) == by_parser(paths[r.i]), paths[r.i]


VALUES = ['{"a": {"a": [1, {"k.v": 2, "n": null}], "x": "y"}, "n": [[0]], "é": true}', "[[1, 2], {\"a\": 3}]", "null", '"text"', "7", None]


def test_paths_from_a_column_read_and_write_like_literal_ones(spark):
    paths = sorted({p for p in odd_paths(7, 150) if by_parser(p) is not None and "[12]" not in p and "2147483647" not in p})
    rows = [(i, v, p) for i, (v, p) in enumerate((v, p) for p in paths for v in VALUES)]
    frame = spark.createDataFrame(rows, "i int, v string, path string").withColumn("v", F.try_parse_json("v"))
    new = F.lit("new").cast("variant")
    by_column = frame.select("i", F.to_json(PC.path_get_by(F.col("v"), F.col("path"))).alias("got"), F.to_json(PC.path_set_by(F.col("v"), F.col("path"), new)).alias("put"))
    found = {r.i: (r.got, r.put) for r in by_column.collect()}
    for p in paths:
        mine = frame.where(F.col("path") == p).select(
            "i",
            F.to_json(P.path_get(F.col("v"), T.VariantType(), p)).alias("got"),
            F.to_json(P.path_set(F.col("v"), T.VariantType(), p, new, T.VariantType())).alias("put"),
        )
        for r in mine.collect():
            assert found[r.i] == (r.got, r.put), (p, rows[r.i])


def test_bad_paths_in_a_column(spark):
    frame = spark.createDataFrame([("{}", "a[0"), ("{}", None), ("{}", " ")], "v string, path string").withColumn("v", F.parse_json("v"))
    safe = frame.select(PC.path_get_by(F.col("v"), F.col("path"), True).alias("x"), F.to_json(PC.path_set_by(F.col("v"), F.col("path"), F.col("v"), True)).alias("y"))
    assert [tuple(r) for r in safe.collect()] == [(None, "{}")] * 3
    with pytest.raises(PySparkException, match=r"not a path: a\[0"):
        frame.where("startswith(path, 'a')").select(PC.path_get_by(F.col("v"), F.col("path"))).collect()


# ---- variants ----


def brute_copy(x, names, types):
    kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID"}[type(x)]
    if kind in types:
        return None
    if isinstance(x, dict):
        return {k: brute_copy(v, names, types) for k, v in x.items() if k not in names}
    return [brute_copy(v, names, types) for v in x] if isinstance(x, list) else x


def random_value(rng, depth):
    kind = rng.choice("olsbinn" if depth else "sbin")
    if kind in "ol":
        inner = [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["a", "secret", "b.c", "", 'q"']): v for v in inner} if kind == "o" else inner
    return {"s": rng.choice(["x{", '"[', "\\", ""]), "b": rng.random() < 0.5, "i": rng.randrange(9), "n": None}[kind]


@pytest.mark.parametrize(("names", "types"), [(["secret"], []), ([], ["BOOLEAN"]), (["secret", ""], ["STRING", "ARRAY"]), ([], ["OBJECT"]), ([], [])])
def test_variant_copies_of_any_depth(spark, names, types):
    rng = random.Random(len(names))
    values = [random_value(rng, 6) for _ in range(80)] + [{"secret": {"secret": 1}}, [], {}, None, "secret"]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame([*rows, (len(rows), None)], "i int, j string").select("i", F.try_parse_json("j").alias("v"))
    assert frame.agg(F.max(V.depth(F.col("v")))).first()[0] >= 4
    got = {r.i: r.j for r in V.clone_variants(frame, "v", names, types).select("i", F.to_json("v").alias("j")).collect()}
    assert got.pop(len(rows)) is None
    assert {i: json.loads(j) for i, j in got.items()} == {i: brute_copy(v, names, types) for i, v in enumerate(values)}


def test_deep_variants(spark):
    deep = lambda n: '{"a":[' * (n // 2) + '{"secret":1,"b":2}' + "]}" * (n // 2)
    frame = spark.createDataFrame([(deep(30), 1), ("[]", 2), (deep(6), 3), (None, 4), ("[" * 9 + "]" * 9, 5)], "j string, a int")
    frame = frame.select(F.try_parse_json("j").alias("v"), "a")
    got = {r.a: r.j for r in V.clone_variants(frame, "v", ["secret"]).select(F.to_json("v").alias("j"), "a").collect()}
    assert got == {n: t and t.replace('"secret":1,', "") for n, t in ((1, deep(30)), (2, "[]"), (3, deep(6)), (4, None), (5, "[" * 9 + "]" * 9))}
    with pytest.raises(ValueError, match="levels"):
        V.clone_variant(F.col("v"), 30, ["secret"])
    assert V.clone_variants(frame.limit(0), "v", ["secret"]).count() == 0


def test_deep_variants_of_any_form(spark):
    rng = random.Random(8)
    values = [[{"k": random_value(rng, 9), "l": [random_value(rng, 12) for _ in range(3)]}] for _ in range(40)]
    frame = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string").select("i", F.parse_json("j").alias("v"))
    assert frame.agg(F.max(V.depth(F.col("v")))).first()[0] > V.LEVELS
    for names, types in ((["secret"], ["BOOLEAN"]), (["a"], ["STRING"])):
        got = {r.i: json.loads(r.j) for r in V.clone_variants(frame, "v", names, types).select("i", F.to_json("v").alias("j")).collect()}
        assert got == {i: brute_copy(v, names, types) for i, v in enumerate(values)}


# ---- graphs ----


def brute_graph(references, roots, ignored=(), immutable=()):
    out = defaultdict(list)
    for o, f, t in references:
        if f not in ignored and o not in immutable:
            out[o].append(t)
    seen, left = set(), [r for r in roots if r not in immutable]
    while left:
        o = left.pop()
        if o is not None and o not in seen and o not in immutable:
            seen.add(o)
            left += out[o]
    return seen


def graph(spark, objects, references, roots, ignored=(), immutable=()):
    frames = [
        spark.createDataFrame([(o, f"value of {o}") for o in objects], "id string, value string"),
        spark.createDataFrame(references, "object string, field string, target string"),
        spark.createDataFrame([(r,) for r in roots], "id string"),
    ]
    copies, refs = G.clone_graph(*frames, ignored_fields=ignored, immutable=F.col("id").isin(*immutable) if immutable else None)
    return {(r.id, r.value) for r in copies.collect()}, sorted(tuple(r) for r in refs.collect())


def test_a_cycle_and_a_shared_child_keep_their_form(spark):
    references = [("n1", "next", "n2"), ("n2", "next", "n1"), ("a", "child", "c"), ("b", "child", "c"), ("p", "left", "a"), ("p", "right", "b"), ("x", "y", "c")]
    copies, refs = graph(spark, ["n1", "n2", "a", "b", "c", "p", "x"], references, ["n1", "p"])
    assert copies == {(f"copy of {o}", f"value of {o}") for o in ("n1", "n2", "a", "b", "c", "p")}
    assert refs == sorted((f"copy of {o}", f, f"copy of {t}") for o, f, t in references if o != "x")


def test_random_graphs(spark):
    rng = random.Random(4)
    objects = [f"o{i}" for i in range(60)]
    references = [(rng.choice(objects), rng.choice("fgh"), rng.choice([*objects, None, "nowhere"])) for _ in range(75)]
    references += [("o1", "f", "o1"), ("o2", "f", "o3"), ("o2", "f", "o3")]
    roots, immutable = ["o1", "o2", "o7", "nobody", None], ["o3", "o7", "o20", "o21", "o22"]
    copies, refs = graph(spark, objects, references, roots, ["h"], immutable)
    seen = brute_graph(references, [r for r in roots if r in objects], ["h"], immutable) & set(objects)
    assert copies == {(f"copy of {o}", f"value of {o}") for o in seen}
    want = [(f"copy of {o}", f, f"copy of {t}" if t in seen else t) for o, f, t in references if o in seen and f != "h"]
    assert sorted(map(str, refs)) == sorted(map(str, want))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(300, 0), (400, 0), (400, 500)], "a long, b long")
    rounds = []
    real = G._hops
    monkeypatch.setattr(G, "_hops", lambda *a: rounds.append(1) or real(*a))
    found = G.reachable(edges, spark.createDataFrame([(400,)], "id long"))
    assert {r.id for r in found.collect()} == {*range(301), 400, 500}
    assert len(rounds) < 16


# ---- characters ----


def assigned():
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]


def test_nfkc_of_all_characters(spark):
    rng = random.Random(2)
    marks = [c for c in assigned() if unicodedata.combining(c)]
    texts = [f"x{c}" for c in assigned()] + ["".join(rng.choices("aeEᄀｱ각", k=2)) + "".join(rng.choices(marks, k=3)) for _ in range(3000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", nfkc(F.col("t")).alias("n"))
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
    wrong = [(texts[r.i], r.n) for r in frame.collect() if r.n != unicodedata.normalize("NFKC", texts[r.i])]
    assert not wrong


def test_fold_keys_are_classes_of_the_regex(spark):
    folds = dict(zip(*S.fold_table(), strict=True))
    members = defaultdict(set)
    for c in map(chr, range(0x10000)):
        if not 0xD800 <= ord(c) < 0xE000:
            members[folds.get(c, c)].add(c)
    # Pairs of one class, and pairs of characters that upper or lower case relates though their classes differ.
    pairs = {(a, b, True) for group in members.values() if len(group) > 1 for a in group for b in group}
    for c in [c for group in members.values() if len(group) > 1 for c in group]:
        for other in {*c.upper(), *c.lower(), *c.title(), *c.casefold()}:
            pairs.add((c, other, folds.get(c, c) == folds.get(other, other)))
    frame = spark.createDataFrame(sorted(pairs), "a string, b string, e boolean")
    regex = F.regexp_like("a", F.concat(F.lit(r"(?iu)\A\Q"), "b", F.lit(r"\E\z")))
    known = [r for r in frame.select("*", regex.alias("x"), S.equals_ignore_case(F.col("a"), F.col("b")).alias("y")).collect()]
    assert len(known) > 4000 and all(r.y == r.e for r in known)
    # The JVM's tables are of an older Unicode version than Python's.
    assert all(unicodedata.name(r.a, "") and r.a >= "Ɪ" or {r.a, r.b} & set("ᲐΆᲽᲾᲿ") or 0x1C80 <= ord(max(r.a, r.b)) for r in known if r.x != r.y)


def test_fold_key_joins_by_hash(spark):
    rows = spark.createDataFrame([("ÄÖ",), ("äö",), ("K",), ("k",), (None,), ("",), ("ß",), ("SS",)], "t string")
    left, right = rows.select("t", S.fold_key(F.col("t")).alias("k")), rows.select(F.col("t").alias("u"), S.fold_key(F.col("t")).alias("k"))
    joined = left.join(right, "k")
    assert "regex" not in joined._jdf.queryExecution().executedPlan().toString().lower().replace("rlike", "")
    assert joined.count() == 4 + 4 + 4 + 1 + 1


def test_each_row_splits_by_its_own_pattern(spark):
    rows = [("a1b22c", "[0-9]+", 2), ("a/b//c//", "/", 3), ("abc", "", 2), ("", ",", 2), (None, ",", 2), ("xyz", "q", 2)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, p string, n int")
    t, p = F.col("t"), F.col("p")
    for limit, keep in [(0, False), (-1, False), (0, True), (2, True), (1, True), (3, False)]:
        got = {r.i: (r.a, r.b) for r in frame.select("i", S.split(t, p, limit, keep).alias("a"), S.rsplit(t, p, limit, keep).alias("b")).collect()}
        for i, (_, pattern, _) in enumerate(rows):
            one = frame.where(f"i = {i}").select(S.split(t, pattern, limit, keep).alias("a"), S.rsplit(t, pattern, limit, keep).alias("b")).first()
            assert got[i] == (one.a, one.b), (rows[i], limit, keep)
    S.check_patterns(frame, "p")
    for bad in ("[", None):
        with pytest.raises((PySparkException, ValueError)):
            S.check_patterns(spark.createDataFrame([("x", bad)], "t string, p string"), "p")
    with pytest.raises(PySparkException):
        spark.createDataFrame([("x", None)], "t string, p string").select(S.split(t, p)).collect()


# ---- streams ----


def test_a_stream_that_fails_in_the_middle_goes_on(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).select("id", F.concat(F.lit("nAME "), F.col("id").cast("string")).alias("t")).coalesce(1).write.mode("append").parquet(folder)
    columns = lambda rows: rows.select("id", S.capitalize(F.col("t")).alias("x"))
    fail = F.when(F.col("id") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    with pytest.raises(StreamingQueryException):
        runs.run_available(runs.file_stream(spark, folder, 1), lambda rows: columns(rows).withColumn("id", fail.cast("long")), out)
    early = spark.read.parquet(f"{out}/rows").count()
    assert 0 < early < 40 and early % 10 == 0
    found = runs.run_available(runs.file_stream(spark, folder, 1), columns, out)
    batch = columns(spark.read.parquet(folder))
    assert found.exceptAll(batch).isEmpty() and batch.exceptAll(found).isEmpty()
    assert runs.run_available(runs.file_stream(spark, folder), columns, out).count() == 40
