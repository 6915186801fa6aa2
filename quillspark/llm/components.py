"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled


def _both(a: str, b: str, c: str, d: str) -> Column:
    """Two rows, (a, b) and (c, d), of one; unlike a union this keeps a small table in its one partition."""
    return F.inline(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(c).alias("a"), F.col(d).alias("b"))))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links the larger (or the smaller and own) neighbours of each node to the least of them."""
    near = edges.select(_both("a", "b", "b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    if large:
        linked = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = near.join(least, "a").select(_both("b", "m", "a", "m"))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges(a, b)``; ``comp`` is the least node of its component.

    Self-loops and repeated edges are harmless; an empty table gives no rows.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = settled(_star(_star(now, large=True), large=False))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return settled(now.select(_both("a", "b", "b", "b")).distinct().withColumnsRenamed({"a": "node", "b": "comp"}))
