"""Deep copy of object graphs that stand in tables, with shared objects and cycles.

``objects(id, ...)`` has a row for each object, ``references(object, field, target)`` one for
each reference. A copy takes the objects that can be reached from the roots, each once, so that
an object that two others share is shared by their copies too, and a cycle is a cycle again.

Reaching goes in rounds over the frontier, in joins whose results hold an object once. Chains
of objects with one reference each are followed by pointer doubling, so that a list of a
million objects takes some twenty joins; what is left are as many rounds as there are branching
objects on a way from a root.

Defined results: references of ignored fields are left out of the copy and not followed; an
object of an immutable kind is shared, its references are neither followed nor copied; a
reference to something that is no object stays as it is; references without a target (NULL)
are copied so; roots that are no objects give nothing; repeated references stay repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settled

#: Rounds after which the reached objects are written as one table, so that plans stay small.
MERGE_AFTER = 8


def _hops(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Targets of the edges that begin at ``starts(id)``."""
    return edges.join(starts, edges["a"] == starts["id"], "left_semi").select(F.col("b").alias("id"))


class _Chains:
    """Jumps of 1, 2, 4, ... steps along objects that have one target only."""

    def __init__(self, edges: DataFrame) -> None:
        alone = edges.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("other")).where("b = other")
        self.jumps = [settled(alone.select("a", "b"))]

    def jump(self, power: int) -> DataFrame:
        while len(self.jumps) <= power:
            half = self.jumps[-1]
            further = half.select(F.col("a").alias("b"), F.col("b").alias("c"))
            self.jumps.append(settled(half.join(further, "b").select("a", F.col("c").alias("b"))))
        return self.jumps[power]

    def close(self, starts: DataFrame, known: DataFrame) -> DataFrame:
        """``starts`` and what their chains lead to beyond ``known`` (itself closed): after each step twice as far."""
        seen, power = starts, 0
        while True:
            new = settled(_hops(self.jump(power), seen).distinct().join(seen.union(known), "id", "left_anti"))
            if new.isEmpty():
                return seen
            seen, power = settled(seen.union(new)), power + 1


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``id`` of the roots and of all that edges ``(a, b)`` lead to from there, each once."""
    edges = settled(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    chains = _Chains(edges)
    frontier = settled(roots.select("id").where("id IS NOT NULL").distinct())
    seen, rounds = frontier.limit(0), 0
    while not frontier.isEmpty():
        frontier = chains.close(frontier, seen)
        seen, rounds = seen.union(frontier), rounds + 1
        seen = settled(seen) if rounds % MERGE_AFTER == 0 else seen
        frontier = settled(_hops(edges, frontier).distinct().join(seen, "id", "left_anti"))
    return seen


def _copy_name(old: Column) -> Column:
    return F.concat(F.lit("copy of "), old.cast("string"))


def clone_graph(
    objects: DataFrame,
    references: DataFrame,
    roots: DataFrame,
    ignored_fields: Collection[str] = (),
    immutable: Column | None = None,
    new_id: Callable[[Column], Column] = _copy_name,
) -> tuple[DataFrame, DataFrame]:
    """The copies' ``objects`` and ``references``; ``immutable`` is a condition on rows of ``objects``.

    ``new_id`` makes a copy's id from that of its original, and must give each its own.
    """
    followed = references.where(~F.coalesce(F.col("field").isin(*ignored_fields), F.lit(False))) if ignored_fields else references
    shared = F.lit(False) if immutable is None else F.coalesce(immutable, F.lit(False))
    own = objects.where(~shared).select("id").distinct()
    inner = followed.join(own, followed["object"] == own["id"], "left_semi")
    starts = roots.join(own, "id", "left_semi")
    reached = reachable(inner.select(F.col("object").alias("a"), F.col("target").alias("b")), starts)
    copied = settled(reached.join(own, "id", "left_semi"))
    copies = objects.join(copied, "id", "left_semi").withColumn("id", new_id(F.col("id")))
    kept = inner.join(copied, inner["object"] == copied["id"], "left_semi")
    named = copied.select(F.col("id").alias("__id"))
    kept = kept.join(named, kept["target"] == named["__id"], "left")
    target = F.when(F.col("__id").isNotNull(), new_id(F.col("target"))).otherwise(F.col("target"))
    return copies, kept.select(new_id(F.col("object")).alias("object"), "field", target.alias("target"))
