"""Operator 11: how filters interact, counted by a stream that takes back what later files change.

Every document has a mask of the filters that it fails. Four filters look at its text alone;
the fifth fails if a smaller id has the same text, which only all files together can tell. The
stream takes the files in ``BATCHES`` available-now micro-batches. Its keyed state is a table:
for each text the rows of the least id so far. When a smaller id arrives, the rows of the
earlier one are retracted from the counters of their old mask and added to that with the fifth
filter. The sum over all batches is the audit's only table: rows for each part, mask and pair of
labels. All orders of filters are read off it.

Texts are keyed by their sha-256. A row counts as failing the fifth filter when it comes, which
needs no key; only the rows of a text's least id in the batch, found by partial aggregation in
each task, meet the state and are put right. So a text that fills a third of the corpus is one
row for each task in the shuffle by key.

State and counters of a micro-batch are written under its number, and a batch only reads the
state of those before it. One that is run again after a failure so replaces itself; both lie in
the shared folder, as the stream's progress does.

Defined results: null texts are empty; null sources and empty ones are one part; a row with a
null id neither fails the fifth filter nor makes others fail; rows with equal least id and text
all pass it; labels of an id that has several rows count if any has the value 1; other columns,
of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpoint, scratch_path

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BATCHES = 4

_COUNTERS = "part string, mask int, flags int, n long"
_COUNTER = ["part", "mask", "flags"]
_HOLDERS = "array<struct<part:string,flags:int,n:long>>"
_STATE = f"key binary, doc_id long, mask int, holders {_HOLDERS}, retracted {_HOLDERS}"


def text_mask(text: Column, words: Column) -> Column:
    """The bits of the four filters that look at one text, and its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }
    return sum((F.when(v, BIT[k]).otherwise(0) for k, v in fails.items()), F.lit(0)).cast("int")


def flagged(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``flags`` (1: good, 2: toxic) of the ids that have any."""
    good, toxic = (F.max((F.col(c).cast("int") == 1).cast("int")) for c in ("quality", "toxic"))
    flags = F.coalesce(good, F.lit(0)) + 2 * F.coalesce(toxic, F.lit(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(flags.cast("int").alias("flags"))
    return checkpoint(known.where("flags > 0"))


def first_holders(rows: DataFrame, state: DataFrame | None) -> DataFrame:
    """What a batch changes in the state: the texts whose least id it lowers or meets again.

    ``holders`` are the batch's rows of the least id, ``retracted`` those that held the text
    before and do no longer. The state may have several entries of a text, of which the least counts.
    """
    # One exchange for both steps: rows of an id, then of an id and text, meet in it.
    known = rows.where("has_id").repartition("key", "doc_id").groupBy("key", "mask", "doc_id", "part", "flags").agg(F.count(F.lit(1)).alias("n"))
    known = known.groupBy("key", "mask", "doc_id").agg(F.collect_list(F.struct("part", "flags", "n")).alias("holders"))
    new = F.struct("doc_id", "mask", "holders").alias("new")
    none = F.lit(None).cast(f"struct<doc_id:bigint,holders:{_HOLDERS}>").alias("old")
    entries = known.select("key", new, none)
    if state is not None:
        held = F.lit(None).cast(f"struct<doc_id:bigint,mask:int,holders:{_HOLDERS}>").alias("new")
        entries = entries.union(state.select("key", held, F.struct("doc_id", "holders").alias("old")))
    # At most an entry for each earlier batch is listed for a text.
    texts = entries.groupBy("key").agg(F.min_by("new", F.col("new.doc_id")).alias("new"), F.collect_list("old").alias("olds"))
    before = F.array_min("olds.doc_id")
    texts = texts.where(F.col("new").isNotNull()).withColumn("before", before).where("before IS NULL OR new.doc_id <= before")
    lost = F.flatten(F.transform(F.filter("olds", lambda o: (o["doc_id"] == F.col("before")) & (o["doc_id"] > F.col("new.doc_id"))), lambda o: o["holders"]))
    return texts.select("key", "new.*", lost.alias("retracted"))


def _moved(entered: DataFrame, holders: str, passes: bool) -> DataFrame:
    """Counters of rows that now pass the fifth filter, or no longer do: taken from one mask, added to the other."""
    with_e = F.col("mask").bitwiseOR(F.lit(BIT["E"]))
    away, to = (with_e, F.col("mask")) if passes else (F.col("mask"), with_e)
    both = F.array(F.struct(away.alias("mask"), F.lit(-1).alias("sign")), F.struct(to.alias("mask"), F.lit(1).alias("sign")))
    rows = entered.select(both.alias("both"), F.explode(holders).alias("h")).select("h.*", F.explode("both").alias("m"))
    return rows.select("part", "m.mask", "flags", (F.col("n") * F.col("m.sign")).alias("n"))


def changes(rows: DataFrame, entered: DataFrame) -> DataFrame:
    """What a batch changes in the counters; rows with an id come as failing the fifth filter."""
    mask = F.when(F.col("has_id"), F.col("mask").bitwiseOR(F.lit(BIT["E"]))).otherwise(F.col("mask"))
    came = rows.select("part", mask.alias("mask"), "flags", F.lit(1).cast("long").alias("n"))
    every = came.union(_moved(entered, "holders", True)).union(_moved(entered, "retracted", False))
    return every.groupBy(*_COUNTER).agg(F.sum("n").alias("n"))


def _source(path: str, files: list[str]) -> str:
    """A stream reads a folder or a pattern; a table that is one file is named by a pattern for it."""
    whole = path.rstrip("/")
    alone = len(files) == 1 and files[0].rpartition("/")[2] == whole.rpartition("/")[2]
    return f"{whole[:-1]}[{whole[-1]}]" if alone else path


def counters(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES, progress: str | None = None) -> DataFrame:
    """``part``, ``mask``, ``flags`` and ``n`` of the Parquet table at ``path``.

    ``progress`` names the folder of the stream's progress, state and counters; a call with the
    folder of one that was stopped goes on after its last whole micro-batch, and takes files that
    have come since.
    """
    table = spark.read.parquet(path)
    files = table.inputFiles()
    folder = progress or scratch_path(spark, "filter-audit")
    if table.isEmpty():
        return spark.createDataFrame([], _COUNTERS)
    good = flagged(labels)
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    docs = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(_source(path, files))
    docs = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # A projection of its own, so that the words of a text are made once.
    docs = docs.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).select(
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("doc_id").isNotNull().alias("has_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text_mask(F.col("text"), F.col("words")).alias("mask"),
    )
    docs = docs.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("__id"), "left")
    docs = docs.select("key", "doc_id", "has_id", "part", "mask", F.coalesce("flags", F.lit(0)).alias("flags"))

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = checkpoint(batch)
        earlier = [f"{folder}/state/batch={k}" for k in range(number)]
        state = session.read.schema(_STATE).parquet(*earlier) if earlier else None
        first_holders(rows, state).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")
        entered = session.read.schema(_STATE).parquet(f"{folder}/state/batch={number}")
        changes(rows, entered).write.mode("overwrite").parquet(f"{folder}/counters/batch={number}")

    query = docs.writeStream.option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True)
    query.foreachBatch(take).start().awaitTermination()
    found = spark.read.schema(_COUNTERS).option("recursiveFileLookup", "true").parquet(f"{folder}/counters")
    return checkpoint(found.groupBy(*_COUNTER).agg(F.sum("n").alias("n")).where("n > 0"))


def orders(counted: DataFrame) -> DataFrame:
    """Every order and step of every part, from its counters (at most 128 a part, times 600 steps)."""
    every = ",".join("".join(o) for o in permutations(FILTERS))
    rows = counted.withColumn("filter_order", F.explode(F.split(F.lit(every), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    here, earlier = F.substr("filter_order", F.col("step"), F.lit(1)), F.substr("filter_order", F.lit(1), F.col("step") - 1)
    bits = [(F.lit(f), b) for f, b in BIT.items()]
    rows = rows.select(
        *counted.columns, "filter_order", "step",
        sum((F.when(here == f, b).otherwise(0) for f, b in bits), F.lit(0)).alias("bit"),
        sum((F.when(F.contains(earlier, f), b).otherwise(0) for f, b in bits), F.lit(0)).alias("before"),
    )
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~gone

    def total(when: Column, amount: Column | None = None) -> Column:
        return F.sum(F.when(when, F.col("n") if amount is None else amount).otherwise(0)).cast("long")

    # Of the 120 orders a filter comes first among the k of a mask in 120 / k.
    turns = F.col("n") * F.lit(120) / F.bit_count("mask")
    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & (F.col("flags").bitwiseAND(F.lit(1)) != 0)).alias("good_lost"),
        total(removed & (F.col("flags").bitwiseAND(F.lit(2)) != 0)).alias("toxic_lost"),
        total(fails, turns.cast("long")).alias("shapley"),
    )


def audit(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The whole audit of the documents at ``path``."""
    return orders(counters(spark, path, labels))
