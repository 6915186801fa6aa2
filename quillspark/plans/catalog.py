"""The registered queries and their DuckDB counterparts, one pair for each operator."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import strings as S
from ..operators import clone as C
from ..operators import graph_clone as G
from ..operators import path_columns as PC
from ..operators import paths as P
from ..operators import variant_clone as V
from ..scratch import fresh_path, settled
from ..sources import file_rows, storage
from ..streaming import runs
from ..workers import make_importable


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    make_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with two columns that hold NULLs."""
    events = _read(spark, sf_dir, "events")
    some = F.nullif(F.col("event_type"), F.lit("click"))
    return events.select("event_id", some.alias("a"), F.nullif(F.col("event_type"), F.lit("view")).alias("b"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "|")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    kind = F.col("event_type")
    return events.where(S.is_not_blank(kind)).select(
        "event_id", P.json_get(F.col("props"), "k", "bigint").alias("k"), S.capitalize(kind).alias("kind")
    )


def str_is_blank(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select("doc_id", "pos", S.is_blank(line).alias("blank"), S.is_not_blank(line).alias("not_blank"))


def str_is_empty(spark, sf_dir):
    a = F.nullif(F.col("a"), F.lit("view"))
    text = F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(a)
    return _kinds(spark, sf_dir).select("event_id", S.is_empty(text).alias("empty"), S.is_not_empty(text).alias("not_empty"))


def str_equals_nullsafe(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _kinds(spark, sf_dir).select("event_id", S.equals(a, b).alias("same"), S.equals(a, None).alias("missing"))


def str_equals_ignore_case(spark, sf_dir):
    segment = F.col("c_mktsegment")
    customers = _read(spark, sf_dir, "customer")
    lowered = F.lower(F.col("c_name"))
    other = F.when(F.col("c_custkey") % 3 == 0, F.reverse(lowered)).when(F.col("c_custkey") % 3 == 1, F.concat(lowered, F.lit("s"))).otherwise(lowered)
    return customers.select(
        "c_custkey", S.equals_ignore_case(segment, "building").alias("same"), S.equals_ignore_case(F.col("c_name"), other).alias("same_name")
    )


def str_fold_join(spark, sf_dir):
    """Names in upper and in lower case meet in an ordinary join."""
    customers = _read(spark, sf_dir, "customer")
    left = customers.select("c_custkey", S.fold_key(F.upper("c_name")).alias("key"))
    right = customers.select(F.col("c_custkey").alias("other"), S.fold_key(F.lower("c_name")).alias("key"), "c_mktsegment")
    return left.join(right, "key").select("c_custkey", "other", "key", S.fold_key(F.col("c_mktsegment")).alias("segment"))


def str_reverse(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.reverse(F.col("line")).alias("reversed"))


def str_strip(spark, sf_dir):
    padded = F.concat(F.lit("\t "), F.col("line"), F.lit(" 　\r"))
    gone = F.when(F.col("pos") % 3 != 0, padded)
    return _lines(spark, sf_dir).select("doc_id", "pos", S.strip(gone).alias("stripped"), S.strip(gone, False).alias("or_null"))


def str_strip_left(spark, sf_dir):
    digits = S.strip_left(F.col("c_name"), "Customer#")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", digits.alias("digits"), S.strip_left(digits, "0").alias("number"), S.strip_left(digits, "0", False).alias("once")
    )


def str_strip_right(spark, sf_dir):
    key = (F.col("c_custkey") * 100).cast("string")
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", S.strip_right(key, "0").alias("bare"), S.strip_right(key, "0", False).alias("once"), S.strip_right(key, None).alias("same")
    )


def _url(spark, sf_dir):
    return _read(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit("//")))


def str_split(spark, sf_dir):
    parts = S.split(F.col("url"), "/")
    return _url(spark, sf_dir).select("page_id", F.size(parts).alias("n"), _joined(parts).alias("parts"))


def str_split_preserve(spark, sf_dir):
    parts = S.split_preserve_empty(F.col("url"), "/")
    return _url(spark, sf_dir).select("page_id", F.size(parts).alias("n"), _joined(parts).alias("parts"))


def str_split_limit(spark, sf_dir):
    name = F.col("p_name")
    return _read(spark, sf_dir, "part").select(
        "p_partkey", _joined(S.split(name, " ", 2, True)).alias("two"), _joined(S.split(name, " ", 2)).alias("no_limit")
    )


def str_split_by(spark, sf_dir):
    """Each row is split by its own pattern, and rejoined with that pattern's text."""
    pages = _read(spark, sf_dir, "pages")
    kind = F.char_length("url") % 3
    pattern = F.when(kind == 0, F.lit("/")).when(kind == 1, F.lit("[aeiou]")).otherwise(F.lit("[.]|:"))
    pages = pages.withColumn("pattern", pattern)
    S.check_patterns(pages, "pattern")
    url, by = F.col("url"), F.col("pattern")
    return pages.select("page_id", _joined(S.split(url, by, 3, True)).alias("left_parts"), _joined(S.rsplit(url, by, 2, True)).alias("right_parts"))


def str_rsplit(spark, sf_dir):
    parts = S.rsplit(F.col("url"), "/", 2)
    return _url(spark, sf_dir).select("page_id", F.size(parts).alias("n"), _joined(parts).alias("parts"))


def str_rsplit_preserve(spark, sf_dir):
    parts = S.rsplit_preserve_empty(F.col("url"), "/", 3)
    return _url(spark, sf_dir).select("page_id", F.size(parts).alias("n"), _joined(parts).alias("parts"))


def str_contains(spark, sf_dir):
    text = F.col("text")
    return _read(spark, sf_dir, "documents").select("doc_id", S.contains(text, "the").alias("has"), S.contains(text, None).alias("never"))


def str_lower(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.to_lower(F.col("line")).alias("lowered"))


def str_upper(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.to_upper(F.col("line")).alias("uppered"))


def str_capitalize(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.capitalize(F.col("line")).alias("capitalized"))


def str_word_capitalize(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", S.word_capitalize(F.col("line")).alias("capitalized"))


def path_get_json(spark, sf_dir):
    props = F.col("props")
    return _read(spark, sf_dir, "events").select(
        "event_id", P.json_get(props, "k", "bigint").alias("k"), P.json_get(props, "['k']", "string").alias("k_text"), P.json_get(props, "k.x?").alias("below")
    )


def _nested(spark, sf_dir):
    """Orders with a nested struct, a map and an array, made within each row."""
    orders = _read(spark, sf_dir, "orders")
    order = F.struct(
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("level")).alias("priority")).alias("info"),
        F.col("o_custkey").alias("customer"),
    ).alias("o")
    tags = F.create_map(F.lit("status"), "o_orderstatus", F.lit("prio.rity"), "o_orderpriority").alias("tags")
    return orders.select("o_orderkey", order, tags, F.split("o_orderpriority", "-", -1).alias("words"))


def _of(frame: DataFrame, name: str, path: str, strict: bool = False) -> Column:
    return P.path_get(F.col(name), frame.schema[name].dataType, path, strict)


def path_get_struct(spark, sf_dir):
    n = _nested(spark, sf_dir)
    return n.select("o_orderkey", _of(n, "o", "info.priority.level").alias("level"), _of(n, "o", "customer").alias("customer"))


def path_get_map(spark, sf_dir):
    n = _nested(spark, sf_dir)
    return n.select("o_orderkey", _of(n, "tags", "status").alias("status"), _of(n, "tags", "['prio.rity']").alias("priority"), _of(n, "tags", "nope").alias("nope"))


def path_get_array(spark, sf_dir):
    n = _nested(spark, sf_dir)
    return n.select("o_orderkey", _of(n, "words", "[0]").alias("first"), _of(n, "words", "[1]").alias("second"), _of(n, "words", "[9]").alias("past"))


def path_get_safe(spark, sf_dir):
    n = _nested(spark, sf_dir)
    miss = _of(n, "o", "info.nope?", strict=True).cast("string")
    return n.select("o_orderkey", miss.alias("miss"), _of(n, "o", "info.status?", strict=True).alias("status"))


def path_get_missing(spark, sf_dir):
    n = _nested(spark, sf_dir)
    return n.select("o_orderkey", _of(n, "o", "Info.status").cast("string").alias("other_case"), _of(n, "o", "info.nope.deep").cast("string").alias("deep"))


def path_set_json(spark, sf_dir):
    new = P.json_set(F.col("props"), "t.v", F.col("event_id"), T.LongType())
    again = P.json_get(new, "t.v", "bigint")
    return _read(spark, sf_dir, "events").select("event_id", again.alias("v"), P.json_get(new, "k", "bigint").alias("k"))


def path_set_struct(spark, sf_dir):
    n = _nested(spark, sf_dir)
    kind = n.schema["o"].dataType
    new = P.path_set(F.col("o"), kind, "info.priority.level", F.lit("none"), T.StringType())
    same = P.path_set(F.col("o"), kind, "info.nope", F.lit("x"), T.StringType())
    get = lambda c, p: P.path_get(c, kind, p)
    return n.select("o_orderkey", get(new, "info.priority.level").alias("level"), get(new, "info.status").alias("status"), get(same, "info.priority.level").alias("same"))


def path_set_many(spark, sf_dir):
    """Thirteen writes into a struct, a map and an array below it, in one rebuild."""
    n = _nested(spark, sf_dir)
    row = F.struct("o", "tags", "words")
    kind = n.select(row.alias("x")).schema["x"].dataType
    text = T.StringType()
    writes = [("o.info.status", F.lit("lost"), text), ("o.info.status", F.lit("done"), text), ("o.info.priority.level", F.col("o_orderkey").cast("string"), text)]
    writes += [(f"tags.t{i}", F.lit(str(i)), text) for i in range(8)] + [("words[0]", F.lit("first"), text), ("words[5]", F.lit("last"), text)]
    x = n.select("o_orderkey", P.path_set_many(row, kind, writes).alias("x"))
    get = lambda p: P.path_get(F.col("x"), kind, p)
    return x.select(
        "o_orderkey", get("o.info.status").alias("status"), get("o.info.priority.level").alias("level"), get("o.customer").alias("customer"),
        F.size(get("tags")).alias("n_tags"), get("tags.t7").alias("t7"), F.array_join(get("words"), "|", "~").alias("words"),
    )


def _mixed_paths(spark, sf_dir):
    """Events as variants, each with a path of its own."""
    events = _read(spark, sf_dir, "events")
    text = F.concat(F.lit('{"p":'), "props", F.lit(',"list":[{"a.b":"x"},'), F.col("event_id").cast("string"), F.lit("]}"))
    paths = ["p.k", "list[0]['a.b']", ".list..[1]", "p['nope'].x?", "list[7].y", "[p][\"k\"]"]
    by_turn = F.element_at(F.array(*map(F.lit, paths)), (F.col("event_id") % len(paths) + 1).cast("int"))
    return events.select("event_id", F.parse_json(text).alias("v"), by_turn.alias("path"))


def path_get_by(spark, sf_dir):
    found = PC.path_get_by(F.col("v"), F.col("path"))
    return _mixed_paths(spark, sf_dir).select("event_id", F.to_json(found).alias("found"))


def path_set_by(spark, sf_dir):
    rows = _mixed_paths(spark, sf_dir)
    new = PC.path_set_by(F.col("v"), F.col("path"), F.col("event_id").cast("variant"))
    return rows.select("event_id", F.to_json(new).alias("changed"))


def path_strict_fields(spark, sf_dir):
    """A field whose structs are strict beside one whose structs are lenient."""
    n = _nested(spark, sf_dir)
    info = n.schema["o"].dataType["info"]
    kind = T.StructType([P.strict_field(info), n.schema["o"].dataType["customer"]])
    get = lambda p: P.path_get(F.col("o"), kind, p).cast("string")
    refused = 0
    for path in ("info.nope", "info.priority.nope"):
        try:
            get(path)
        except P.PathError:
            refused += 1
    return n.select("o_orderkey", get("info.nope?").alias("safe"), get("nope").alias("lenient"), get("info.status").alias("status"), F.lit(refused).alias("refused"))


def path_set_map(spark, sf_dir):
    n = _nested(spark, sf_dir)
    kind = n.schema["tags"].dataType
    new = P.path_set(F.col("tags"), kind, "status", F.lit("?"), T.StringType())
    more = P.path_set(new, kind, "added", F.col("o_orderkey").cast("string"), T.StringType())
    get = lambda p: P.path_get(more, kind, p)
    return n.select("o_orderkey", F.size(more).alias("n"), get("status").alias("status"), get("added").alias("added"))


def path_set_array_pad(spark, sf_dir):
    n = _nested(spark, sf_dir)
    new = P.path_set(F.col("words"), n.schema["words"].dataType, "[4]", F.lit("end"), T.StringType())
    return n.select("o_orderkey", F.size(new).alias("n"), F.array_join(new, "|", "~").alias("words"))


def clone_ignore_field(spark, sf_dir):
    customers = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    fields = [C.marked(f) if f.name == "c_acctbal" else f for f in customers.schema.fields]
    tagged = customers.select(*[F.col(f.name).alias(f.name, metadata=f.metadata) for f in fields])
    return C.deep_clone(tagged)


def clone_nested(spark, sf_dir):
    n = _nested(spark, sf_dir)
    cloner = C.ClonerBuilder().ignore_type(n.schema["o"].dataType["info"].dataType["priority"].dataType).build()
    copy = cloner.clone(n)
    return copy.select(
        "o_orderkey", F.col("o.info.status").alias("status"), F.col("o.info.priority.level").alias("level"), F.size("tags").alias("n_tags"), _joined(F.col("words")).alias("words")
    )


class Masked:
    """Every text is copied as its length."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.StringType)

    def copy(self, column: Column, kind: T.DataType, cloner: C.Cloner) -> Column:
        return F.length(column).cast("string")


def clone_custom(spark, sf_dir):
    n = _nested(spark, sf_dir)
    copy = C.deep_clone(n, strategies=[Masked()])
    return copy.select("o_orderkey", F.col("o.info.priority.level").alias("level"), _joined(F.col("words")).alias("words"), F.try_element_at("tags", F.lit("6")).alias("tag"))


class JsonText:
    """Named steps into JSON text, as a library user may register them."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.StringType)

    def get(self, node, name):
        return P.Node(F.get_json_object(node.column, f"$.{name}"), T.StringType())

    def set(self, node, name, change):
        entries = F.from_json(node.column, "map<string,string>")
        others = F.map_filter(F.coalesce(entries, F.create_map().cast("map<string,string>")), lambda k, _: k != name)
        new = change(self.get(node, name)).column.cast("string")
        return P.Node(F.to_json(F.map_concat(others, F.create_map(F.lit(name), new))), T.StringType())


class FromEnd(P.ArrayAdapter):
    """Indexes that count from the end."""

    def get(self, node, at):
        return super().get(P.Node(F.reverse(node.column), node.kind), at)

    def set(self, node, at, change):
        made = super().set(P.Node(F.reverse(node.column), node.kind), at, change)
        return P.Node(F.reverse(made.column), made.kind)


def path_custom_adapter(spark, sf_dir):
    events = _read(spark, sf_dir, "events")
    accessor = P.AccessorBuilder().register_property(JsonText()).with_parser(P.CachedParser(10)).build()
    text = T.StringType()
    new = accessor.set(F.col("props"), text, "added", F.col("event_id"), T.LongType())
    return events.select("event_id", accessor.get(F.col("props"), text, "k").alias("k"), accessor.get(new, text, "added").alias("added"))


def path_custom_collection(spark, sf_dir):
    n = _nested(spark, sf_dir)
    kind = n.schema["words"].dataType
    accessor = P.AccessorBuilder().register_property(P.MapAdapter()).register_collection(FromEnd()).build()
    new = accessor.set(F.col("words"), kind, "[0]", F.lit("end"), T.StringType())
    return n.select("o_orderkey", accessor.get(F.col("words"), kind, "[0]").alias("last"), _joined(new).alias("words"))


def clone_marks(spark, sf_dir):
    """A transient field is left out, a type or a field that is immutable is shared with the marks in it."""
    inner = F.struct(F.col("c_name").alias("name", metadata={C.IGNORE: True})).alias("inner")
    tagged = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("c_acctbal", metadata={C.TRANSIENT: True}), inner)
    balance, held = tagged.schema["c_acctbal"], tagged.schema["inner"]
    cloner, sharing = C.Cloner(), C.ClonerBuilder().immutable_type(held.dataType).build()
    column = F.col("inner")
    return tagged.select(
        "c_custkey",
        cloner.field(F.col("c_acctbal"), balance).alias("c_acctbal"),
        sharing.field(column, held)["name"].alias("shared"),
        cloner.field(column, held)["name"].alias("copied"),
        cloner.field(column, C.marked(held, C.IMMUTABLE))["name"].alias("shared_field"),
    )


def clone_variant(spark, sf_dir):
    """Members named "secret" are left out at any depth, and booleans emptied, in values of unknown form."""
    events = _read(spark, sf_dir, "events")
    text = F.concat(
        F.lit('{"k":'), "props", F.lit(',"list":[{"secret":{"x":1},"t":"'), "event_type", F.lit('"},[true,[{"secret":'), "props", F.lit(',"z":'),
        F.col("event_id").cast("string"), F.lit('}]]],"secret":"s"}'),
    )
    rows = events.select("event_id", F.parse_json(text).alias("v"))
    return V.clone_variants(rows, "v", ["secret"], ["BOOLEAN"]).select("event_id", F.to_json("v").alias("copy"))


def _object_graph(spark, sf_dir):
    """Customers, nations, regions and suppliers as objects, with a tree, shared objects and cycles of references."""
    customers, nations, suppliers = (_read(spark, sf_dir, t) for t in ("customer", "nation", "supplier"))
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))

    def refs(rows, of, field, to):
        return rows.select(of.alias("object"), F.lit(field).alias("field"), to.alias("target"))

    c, half = name("C", F.col("c_custkey")), (F.col("c_custkey") / 2).cast("long")
    n, r, s = name("N", F.col("n_nationkey")), name("R", F.col("n_regionkey")), name("S", F.col("s_suppkey"))
    capital = nations.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("n_nationkey"))
    parts = [
        refs(customers, c, "nation", name("N", F.col("c_nationkey"))), refs(customers.where("c_custkey > 1"), c, "referrer", name("C", half)),
        refs(customers, c, "agent", name("S", F.col("c_custkey") % 7 + 1)), refs(nations, n, "region", r), refs(capital, r, "capital", n),
        refs(suppliers, s, "nation", name("N", F.col("s_nationkey"))),
    ]
    references = parts[0]
    for part in parts[1:]:
        references = references.union(part)
    ids = [customers.select(c.alias("id")), nations.select(n.alias("id")), nations.select(r.alias("id")).distinct(), suppliers.select(s.alias("id"))]
    return ids[0].union(ids[1]).union(ids[2]).union(ids[3]), references, customers.where("c_custkey % 9 = 0").select(c.alias("id"))


def clone_graph(spark, sf_dir):
    """A third of a third of the customers are copied with all they lead to, but for their agents."""
    objects, references, roots = _object_graph(spark, sf_dir)
    return G.clone_graph(objects, references, roots, ignored_fields=["agent"])[1]


def clone_graph_objects(spark, sf_dir):
    """The same copy's objects; nations are immutable, so that they are shared and lead no further."""
    objects, references, roots = _object_graph(spark, sf_dir)
    return G.clone_graph(objects, references, roots, immutable=F.col("id").startswith("N"))[0]


def stream_projection(spark, sf_dir):
    """The flagship's columns made by a stream, in available-now micro-batches with a checkpoint."""
    stream = runs.file_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.col("event_type")

    def columns(events):
        kept = events.where(S.is_not_blank(kind))
        return kept.select("event_id", P.json_get(F.col("props"), "k", "bigint").alias("k"), S.capitalize(kind).alias("kind"))

    return runs.run_available(stream, columns, fresh_path(spark, "stream"))


def storage_metadata(spark, sf_dir):
    """The tables' files: names, types and etags, and whether their sizes and times are there."""
    files = storage.metadata_table(spark, sf_dir)
    name = F.regexp_extract("path", r"([^/]+)\.parquet", 1)
    return files.select(
        name.alias("name"), "contentType", "etag", (F.col("size") > 0).alias("sized"), F.col("lastModified").isNotNull().alias("dated")
    ).distinct()


def storage_round_trip(spark, sf_dir):
    """Each supplier's name becomes a file of a new folder, is read again, looked up and deleted, by the executors."""
    store = storage.FileStorage(spark, "http://files.test/")
    folder = fresh_path(spark, "store")
    key = F.col("s_suppkey").cast("string")
    suppliers = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s/"), key, F.lit(".txt")).alias("path"), F.col("s_name").cast("binary").alias("content"))
    began = F.lit(datetime.now(UTC) - timedelta(seconds=5))
    before = settled(file_rows.read_files(spark, folder).select("path"))
    file_rows.write_files(suppliers, folder)
    found = settled(file_rows.read_files(spark, folder).select("path", "size", "lastModified", F.col("contentType").alias("type"), F.col("content").cast("string").alias("content")))
    about = storage.metadata_table(spark, folder)
    about = settled(about.select(F.regexp_extract("path", r"(s/[^/]+)$", 1).alias("path"), F.col("size").alias("size_there"), F.col("lastModified").alias("time_there"), "etag"))
    gone = settled(file_rows.delete_files(suppliers, folder))
    after = settled(file_rows.read_files(spark, folder).select("path"))

    def among(paths: DataFrame, name: str) -> DataFrame:
        return paths.withColumn(name, F.lit(True)).withColumnRenamed("path", f"{name}_path")

    rows = suppliers.select("s_suppkey", "path").join(found, "path").join(about, "path").join(gone, "path")
    for paths, name in ((before, "before"), (after, "after")):
        rows = rows.join(among(paths, name), rows["path"] == F.col(f"{name}_path"), "left")
    same_time = F.abs(F.unix_micros("lastModified") - F.unix_micros("time_there")) < 1_000_000
    url = store.signed_url("", storage.SignedUrlOptions.default_read(timedelta(minutes=5)))
    return rows.select(
        "s_suppkey", "path", "content", "size", (F.col("size") == F.col("size_there")).alias("same_size"), "type", "etag", same_time.alias("same_time"),
        (F.col("lastModified") >= began).alias("dated"), F.coalesce("before", F.lit(False)).alias("before"), "there",
        F.coalesce("after", F.lit(False)).alias("after"), F.concat(F.lit(url), "path").alias("url"),
    )


def storage_url(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages")
    return pages.select("page_id", storage.url_column("http://files.test/x// ", F.concat(F.lit("p/"), "page_id")).alias("url"))


QUERIES = {
    "flagship": flagship,
    **{
        f.__name__: f
        for f in (
            str_is_blank, str_is_empty, str_equals_nullsafe, str_equals_ignore_case, str_reverse, str_strip, str_strip_left,
            str_strip_right, str_split, str_split_preserve, str_split_limit, str_rsplit, str_rsplit_preserve, str_contains,
            str_lower, str_upper, str_capitalize, str_word_capitalize, path_get_json, path_get_struct, path_get_map,
            path_get_array, path_get_safe, path_get_missing, path_set_json, path_set_struct, path_set_map, path_set_array_pad,
            clone_ignore_field, clone_nested, clone_custom, storage_metadata, storage_url, path_custom_adapter,
            path_custom_collection, clone_marks, storage_round_trip, str_fold_join, str_split_by, path_set_many, path_get_by,
            path_set_by, path_strict_fields, clone_variant, clone_graph, clone_graph_objects, stream_projection,
        )
    },
}

_LINES = (
    "(SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS pos, unnest(l) AS line "
    "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
)
_WS = r"[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
_KINDS = "(SELECT event_id, nullif(event_type, 'click') AS a, nullif(event_type, 'view') AS b FROM events)"
_URLS = "(SELECT page_id, string_split(url || '//', '/') AS p FROM pages)"
_TRIMMED = "CASE WHEN len(p) = 1 THEN p ELSE p[1:coalesce(list_max(list_transform(p, lambda x, i: CASE WHEN x <> '' THEN i END)), 0)] END"
_NESTED = "(SELECT o_orderkey, o_custkey, o_orderstatus AS s, o_orderpriority AS r, string_split(o_orderpriority, '-') AS w FROM orders)"


def _cap(text: str) -> str:
    return f"upper(replace(left({text}, 1), 'ß', 'SS')) || lower(substr({text}, 2))"


_REFS = """refs AS (
      SELECT 'C' || c_custkey AS object, 'nation' AS field, 'N' || c_nationkey AS target FROM customer
      UNION ALL SELECT 'C' || c_custkey, 'referrer', 'C' || (c_custkey // 2) FROM customer WHERE c_custkey > 1
      UNION ALL SELECT 'C' || c_custkey, 'agent', 'S' || (c_custkey % 7 + 1) FROM customer
      UNION ALL SELECT 'N' || n_nationkey, 'region', 'R' || n_regionkey FROM nation
      UNION ALL SELECT 'R' || n_regionkey, 'capital', 'N' || min(n_nationkey) FROM nation GROUP BY n_regionkey
      UNION ALL SELECT 'S' || s_suppkey, 'nation', 'N' || s_nationkey FROM supplier)"""


def _walk(follow: str) -> str:
    """Recursive SQL that walks the references for which ``follow`` holds."""
    return f"""WITH RECURSIVE {_REFS},
      walk AS (SELECT 'C' || c_custkey AS id FROM customer WHERE c_custkey % 9 = 0
        UNION SELECT target FROM walk JOIN refs ON object = id AND {follow})"""


_GRAPH, _GRAPH_SHARED = _walk("field <> 'agent'"), _walk("id[1] <> 'N'")

ORACLES = {
    "flagship": f"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {_cap('event_type')} AS kind
        FROM events WHERE regexp_matches(event_type, '[^ ]')""",
    "str_is_blank": f"""SELECT doc_id, pos, regexp_full_match(line, '{_WS}*') AS blank,
        NOT regexp_full_match(line, '{_WS}*') AS not_blank FROM {_LINES}""",
    "str_is_empty": f"""SELECT event_id, coalesce(t = '', false) AS empty, NOT coalesce(t = '', false) AS not_empty
        FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE nullif(a, 'view') END AS t FROM {_KINDS})""",
    "str_equals_nullsafe": f"SELECT event_id, a IS NOT DISTINCT FROM b AS same, a IS NULL AS missing FROM {_KINDS}",
    "str_equals_ignore_case": "SELECT c_custkey, lower(c_mktsegment) = 'building' AS same, c_custkey % 3 = 2 AS same_name FROM customer",
    "str_reverse": f"SELECT doc_id, pos, array_to_string(list_reverse(regexp_extract_all(line, '(?s).')), '') AS reversed FROM {_LINES}",
    "str_strip": f"""SELECT doc_id, pos, coalesce(t, '') AS stripped, t AS or_null FROM (SELECT doc_id, pos, CASE WHEN pos % 3 <> 0
        THEN regexp_replace(line, '\\A{_WS}+|{_WS}+\\z', '', 'g') END AS t FROM {_LINES})""",
    "str_strip_left": """SELECT c_custkey, d AS digits, ltrim(d, '0') AS number,
        CASE WHEN starts_with(d, '0') THEN substr(d, 2) ELSE d END AS once FROM (SELECT c_custkey, replace(c_name, 'Customer#', '') AS d FROM customer)""",
    "str_strip_right": """SELECT c_custkey, rtrim(k, '0') AS bare, left(k, length(k) - 1) AS once, k AS same
        FROM (SELECT c_custkey, CAST(c_custkey * 100 AS VARCHAR) AS k FROM customer)""",
    "str_split": f"SELECT page_id, CAST(len(q) AS INTEGER) AS n, array_to_string(q, '|') AS parts FROM (SELECT page_id, {_TRIMMED} AS q FROM {_URLS})",
    "str_split_preserve": f"SELECT page_id, CAST(len(p) AS INTEGER) AS n, array_to_string(p, '|') AS parts FROM {_URLS}",
    "str_split_limit": """SELECT p_partkey, CASE WHEN len(w) <= 2 THEN array_to_string(w, '|')
        ELSE w[1] || '|' || array_to_string(w[2:], ' ') END AS two, array_to_string(w, '|') AS no_limit
        FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
    "str_rsplit": f"""SELECT page_id, CAST(least(len(q), 2) AS INTEGER) AS n, CASE WHEN len(q) <= 2 THEN array_to_string(q, '|')
        ELSE array_to_string(q[:-2], '/') || '|' || q[-1] END AS parts FROM (SELECT page_id, {_TRIMMED} AS q FROM {_URLS})""",
    "str_rsplit_preserve": f"""SELECT page_id, CAST(least(len(p), 3) AS INTEGER) AS n, CASE WHEN len(p) <= 3 THEN array_to_string(p, '|')
        ELSE array_to_string(p[:-3], '/') || '|' || p[-2] || '|' || p[-1] END AS parts FROM {_URLS}""",
    "str_contains": f"""SELECT doc_id, contains(text, 'the') AND NOT regexp_full_match(text, '{_WS}*') AS has, false AS never FROM documents""",
    "str_lower": f"SELECT doc_id, pos, lower(line) AS lowered FROM {_LINES}",
    "str_upper": f"SELECT doc_id, pos, upper(replace(line, 'ß', 'SS')) AS uppered FROM {_LINES}",
    "str_capitalize": f"SELECT doc_id, pos, {_cap('line')} AS capitalized FROM {_LINES}",
    "str_word_capitalize": f"""SELECT doc_id, pos, array_to_string(list_transform(string_split(line, ' '), lambda x: {_cap('x')}), ' ')
        AS capitalized FROM {_LINES}""",
    "path_get_json": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS k_text,
        CAST(NULL AS VARCHAR) AS below FROM events""",
    "path_get_struct": f"SELECT o_orderkey, r AS level, o_custkey AS customer FROM {_NESTED}",
    "path_get_map": f"SELECT o_orderkey, s AS status, r AS priority, CAST(NULL AS VARCHAR) AS nope FROM {_NESTED}",
    "path_get_array": f"SELECT o_orderkey, w[1] AS first, w[2] AS second, w[10] AS past FROM {_NESTED}",
    "path_get_safe": f"SELECT o_orderkey, CAST(NULL AS VARCHAR) AS miss, s AS status FROM {_NESTED}",
    "path_get_missing": f"SELECT o_orderkey, CAST(NULL AS VARCHAR) AS other_case, CAST(NULL AS VARCHAR) AS deep FROM {_NESTED}",
    "path_set_json": "SELECT event_id, event_id AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "path_set_struct": f"SELECT o_orderkey, 'none' AS level, s AS status, r AS same FROM {_NESTED}",
    "path_set_map": f"SELECT o_orderkey, CAST(3 AS INTEGER) AS n, '?' AS status, CAST(o_orderkey AS VARCHAR) AS added FROM {_NESTED}",
    "path_set_array_pad": f"""SELECT o_orderkey, CAST(5 AS INTEGER) AS n, array_to_string(list_concat(
        w, list_transform(range(4 - len(w)), lambda x: '~'), ['end']), '|') AS words FROM {_NESTED}""",
    "clone_ignore_field": "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer",
    "clone_nested": f"""SELECT o_orderkey, s AS status, CAST(NULL AS VARCHAR) AS level, CAST(2 AS INTEGER) AS n_tags,
        array_to_string(w, '|') AS words FROM {_NESTED}""",
    "clone_custom": f"""SELECT o_orderkey, CAST(length(r) AS VARCHAR) AS level,
        array_to_string(list_transform(w, lambda x: CAST(length(x) AS VARCHAR)), '|') AS words, CAST(length(s) AS VARCHAR) AS tag FROM {_NESTED}""",
    "path_custom_adapter": """SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(event_id AS VARCHAR) AS added FROM events""",
    "path_custom_collection": f"""SELECT o_orderkey, w[-1] AS last, array_to_string(list_concat(w[:-2], ['end']), '|') AS words FROM {_NESTED}""",
    "clone_marks": "SELECT c_custkey, CAST(NULL AS DOUBLE) AS c_acctbal, c_name AS shared, CAST(NULL AS VARCHAR) AS copied, c_name AS shared_field FROM customer",
    "str_fold_join": """SELECT a.c_custkey, b.c_custkey AS other, lower(a.c_name) AS key, lower(b.c_mktsegment) AS segment
        FROM customer a JOIN customer b ON lower(a.c_name) = lower(b.c_name)""",
    "str_split_by": """SELECT page_id, CASE WHEN len(p) <= 3 THEN array_to_string(p, '|') ELSE p[1] || '|' || p[2] || '|' || list_reduce(p[3:], lambda x, y: x || r || y) END AS left_parts,
        CASE WHEN len(p) <= 2 THEN array_to_string(p, '|') ELSE list_reduce(p[:-2], lambda x, y: x || r || y) || '|' || p[-1] END AS right_parts
        FROM (SELECT page_id, r, string_split_regex(url, r) AS p FROM (
          SELECT page_id, url, CASE length(url) % 3 WHEN 0 THEN '/' WHEN 1 THEN '[aeiou]' ELSE '[.]|:' END AS r FROM pages))""",
    "path_set_many": f"""SELECT o_orderkey, 'done' AS status, CAST(o_orderkey AS VARCHAR) AS level, o_custkey AS customer, CAST(10 AS INTEGER) AS n_tags,
        '7' AS t7, array_to_string(list_concat(['first'], w[2:], list_transform(range(5 - len(w)), lambda x: '~'), ['last']), '|') AS words FROM {_NESTED}""",
    "path_get_by": """SELECT event_id, CASE event_id % 6 WHEN 1 THEN '"x"' WHEN 2 THEN CAST(event_id AS VARCHAR)
        WHEN 0 THEN json_extract_string(props, '$.k') WHEN 5 THEN json_extract_string(props, '$.k') END AS found FROM events""",
    "path_set_by": """SELECT event_id, '{"list":[' || CASE event_id % 6
          WHEN 1 THEN '{"a.b":' || event_id || '},' || event_id WHEN 4 THEN '{"a.b":"x"},' || event_id || ',null,null,null,null,null,{"y":' || event_id || '}'
          ELSE '{"a.b":"x"},' || event_id END || '],"p":{"k":' || CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 5 THEN CAST(event_id AS VARCHAR)
          ELSE json_extract_string(props, '$.k') END || CASE event_id % 6 WHEN 3 THEN ',"nope":{"x":' || event_id || '}' ELSE '' END || '}}' AS changed FROM events""",
    "path_strict_fields": f"""SELECT o_orderkey, CAST(NULL AS VARCHAR) AS safe, CAST(NULL AS VARCHAR) AS lenient, s AS status, CAST(2 AS INTEGER) AS refused FROM {_NESTED}""",
    "clone_variant": """SELECT event_id, '{"k":{"k":' || json_extract_string(props, '$.k') || '},"list":[{"t":"' || event_type || '"},[null,[{"z":' || event_id || '}]]]}'
        AS copy FROM events""",
    "clone_graph": f"""{_GRAPH}
        SELECT 'copy of ' || object AS object, field, 'copy of ' || target AS target FROM refs JOIN walk ON object = id WHERE field <> 'agent'""",
    "clone_graph_objects": f"""{_GRAPH_SHARED} SELECT 'copy of ' || id AS id FROM walk WHERE id[1] <> 'N'""",
    "stream_projection": f"""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {_cap('event_type')} AS kind
        FROM events WHERE regexp_matches(event_type, '[^ ]')""",
    "storage_metadata": """SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
        'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name, 'application/vnd.apache.parquet' AS contentType, '' AS etag,
        true AS sized, true AS dated""",
    "storage_round_trip": """SELECT s_suppkey, 's/' || s_suppkey || '.txt' AS path, s_name AS content, length(s_name) AS size, true AS same_size,
        'text/plain' AS type, '' AS etag, true AS same_time, true AS dated, false AS before, true AS there, false AS after,
        'http://files.test/s/' || s_suppkey || '.txt' AS url FROM supplier""",
    "storage_url": "SELECT page_id, 'http://files.test/x///p/' || page_id AS url FROM pages",
}
