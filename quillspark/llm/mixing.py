"""Operator 13: mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order (by the md5 of id and text), once for each
round of the source. A copy's virtual finish time is what its source has put out by its end,
divided by the source's target. All copies are range-sorted by finish time, which interleaves
the sources in proportion to their targets, and the mix is cut at the budget, the words of all
documents. A copy that the cut finds in service is cut too, so that each source's words meet
its target but for rounding; all others are taken whole.

A target is the source's part of the budget by weight, at most ``MAX_ROUNDS`` times the
source's size; what is above is shared again by weight.

Defined results: null texts and texts without words have size 0 and are never taken; a null
source is a source of its own and last in order; null ids and repeated rows are documents of
their own; equal finish times go by source, then by place in the queue; a document is taken at
most three times whole; an empty table gives no rows; other columns, of whatever name, are
ignored. Reruns agree, on any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .running import running

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_ROUNDS = 3
#: Sources up to which their table is broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size`` and the keys of the shuffle, a row for each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            F.md5(F.concat(name, F.lit(" "), text).cast("binary")).alias("shuffled"),
            # Only tells equal rows apart, so that they need not share a partition.
            F.monotonically_increasing_id().alias("row"),
        )
    )


def targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source``, its number, ``source_size`` and ``target``.

    Sources in ascending order of the level at which they are full: the first that is not full
    at the level of all that remain sets it. One task sorts one row for each source.
    """
    numbered = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = numbered.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    full = MAX_ROUNDS * F.col("source_size")
    by_level = Window.orderBy("level", "number")
    everything = Window.partitionBy()
    here = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(here), F.lit(0))
    share = left / F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    found = numbered.withColumn("weight", weight).withColumn("level", full / F.col("weight")).withColumn("share", share)
    first = F.min(F.when(F.col("share") <= F.col("level"), F.struct("level", "number", "share"))).over(everything)
    return found.select(
        "source",
        "number",
        "source_size",
        F.coalesce(F.least(full.cast("double"), first["share"] * F.col("weight")), F.lit(0.0)).alias("target"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """A row for each copy that queues before the cut, and one without ``finish`` for every other document.

    ``finish`` orders the mix, ``position`` is the number of words before the copy in it, and
    ``taken`` the number of its words; (``number``, ``place``) is the document's place in its source.
    """
    rows = sized(docs)
    shares = checkpoint(targets(rows, weights))
    few = shares.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = shares.withColumnRenamed("source", "__source")
    known = rows.join(F.broadcast(named) if few else named, rows["source"].eqNullSafe(named["__source"])).drop("__source")
    queued = running(known, ["number"], ["shuffled", "row"], "size").drop("shuffled", "row")
    quota = F.ceil("target")
    start = F.col("round") * F.col("source_size") + F.col("before")
    rounds = F.filter(
        F.sequence(F.lit(0), F.lit(MAX_ROUNDS - 1)),
        lambda r: (F.col("size") > 0) & (r * F.col("source_size") + F.col("before") < quota),
    )
    copies = queued.select("*", F.explode_outer(rounds).alias("round")).withColumn("start", start)
    finish = (F.col("start") + F.col("size")) / F.col("target")
    copies = copies.select(
        "doc_id", "source", "size", "source_size", "target", "number", "place", "round",
        finish.alias("finish"), F.least("size", quota - F.col("start")).alias("served"),
    )
    # Documents that are never taken end the queue; their places tell them apart.
    copies = copies.withColumn("at", F.coalesce("finish", F.lit(float("inf"))))
    sorted_ = running(copies.withColumnRenamed("place", "queue_place"), [], ["at", "number", "queue_place"], "served").drop("place", "at")
    budget = F.coalesce(F.lit(rows.agg(F.sum("size")).first()[0]), F.lit(0)).cast("long")
    taken = F.greatest(F.lit(0), F.least(F.coalesce("served", F.lit(0)), budget - F.col("before")))
    return sorted_.select(
        "doc_id", "source", "size", "source_size", "target", "number", F.col("queue_place").alias("place"), "round", "finish",
        F.col("before").alias("position"), taken.cast("long").alias("taken"),
    )


def taken(mixed: DataFrame) -> DataFrame:
    """A row for each document: the words that the mix takes of it, copies added up."""
    keys = ["number", "place", "doc_id", "size", "source_size", "target"]
    return mixed.groupBy(*keys).agg(F.sum("taken").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")
