"""Deep copy and pruning of variants, whose depth and names only the data know.

A copy is one expression for each row, with no shuffle: a value's members (of an object or an
array) are copied by the expression of the next level, down to the depth of the deepest value
of the table, which is counted first. Each level stands once in the plan, since members of
both kinds go through one array.

Rows deeper than ``LEVELS`` are cut there: what lies below becomes a table of paths and values,
which is copied in the same way, and is put back by path. So any depth is copied, with a shuffle
of the deep rows for every ``LEVELS`` levels.

Defined results: members with an ignored name are left out, at any depth; values of an ignored
type become the JSON null, and stay in their place in arrays; a NULL variant stays NULL; scalars
are shared as they are.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settled
from .paths import let

#: Levels of one expression; more would take the analyzer too many rounds.
LEVELS = 8
_MEMBERS = "array<struct<key:string,value:variant>>"


def shape(value: Column) -> Column:
    """The leading word of the type: OBJECT, ARRAY, VOID, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, DATE, ..."""
    return F.regexp_extract(F.schema_of_variant(value), r"\A[A-Z]+", 0)


def depth(value: Column) -> Column:
    """How many objects and arrays lie around the innermost value; 0 for scalars and NULL."""
    no_strings = F.regexp_replace(F.to_json(value), r'"(?:[^"\\]|\\.)*+"', "")
    marks = F.split(F.regexp_replace(no_strings, r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("here"), F.lit(0).alias("most"))

    def count(state: Column, mark: Column) -> Column:
        here = state["here"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(here.alias("here"), F.greatest(state["most"], here).alias("most"))

    return F.coalesce(F.aggregate(marks, start, count, lambda s: s["most"]), F.lit(0))


class _Copy:
    """The expressions of a copy without members of ``names`` and values of ``types``."""

    def __init__(self, names: Collection[str], types: Collection[str]) -> None:
        self.names, self.types = tuple(names), tuple(types)

    def members(self, x: Column, kind: Column) -> Column:
        entries = F.try_variant_get(x, "$", "map<string,variant>")
        kept = F.map_filter(entries, lambda k, _: ~k.isin(*self.names)) if self.names else entries
        nameless = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value")))
        return F.when(kind == "OBJECT", F.map_entries(kept).cast(_MEMBERS)).when(kind == "ARRAY", nameless.cast(_MEMBERS))

    def copy(self, x: Column, left: int, path: Column | None = None, below: Column | None = None) -> Column:
        """A copy of ``left`` levels; ``below`` has what is to stand under them, by path, if there is more."""
        kind = shape(x)
        if left:
            inner = lambda m, i: F.struct(
                m["key"].alias("key"), self.copy(m["value"], left - 1, None if path is None else _further(path, m, i), below).alias("value")
            )
            rebuilt = let(
                F.transform(self.members(x, kind), inner),
                lambda c: F.when(kind == "OBJECT", F.to_variant_object(F.map_from_entries(c))).otherwise(
                    F.to_variant_object(F.transform(c, lambda m: m["value"]))
                ),
            )
            done = F.when(kind.isin("OBJECT", "ARRAY"), rebuilt).otherwise(x)
        else:
            done = x if below is None else F.coalesce(F.try_element_at(below, path), x)
        return F.when(kind.isin(*self.types), F.parse_json(F.lit("null"))).otherwise(done) if self.types else done

    def cut(self, x: Column, left: int, path: Column) -> Column:
        """(path, value) of the objects and arrays ``left`` levels down."""
        kind = shape(x)
        wanted = kind.isin("OBJECT", "ARRAY") & ~kind.isin(*self.types) if self.types else kind.isin("OBJECT", "ARRAY")
        if not left:
            return F.when(wanted, F.array(F.struct(path.alias("path"), x.alias("value"))))
        found = F.transform(self.members(x, kind), lambda m, i: self.cut(m["value"], left - 1, _further(path, m, i)))
        return F.when(wanted, F.flatten(F.filter(found, lambda f: f.isNotNull())))


def _further(path: Column, member: Column, at: Column) -> Column:
    return F.concat(path, F.array(F.coalesce(member["key"], at.cast("string"))))


def _root() -> Column:
    return F.array().cast("array<string>")


def clone_variant(value: Column, levels: int, names: Collection[str] = (), types: Collection[str] = ()) -> Column:
    """A copy of a variant that is at most ``levels`` deep, without members of ``names`` and values of ``types``."""
    if levels > LEVELS:
        raise ValueError(f"one expression copies {LEVELS} levels at most; see clone_variants")
    return let(value, lambda x: _Copy(names, types).copy(x, levels))


def clone_variants(df: DataFrame, column: str, names: Collection[str] = (), types: Collection[str] = ()) -> DataFrame:
    """``df`` with the variant ``column`` copied; one pass over it finds how deep it is."""
    if not names and not types:
        return df
    found = F.col(f"`{column.replace('`', '``')}`")
    levels = df.select(F.max(depth(found))).first()[0] or 0
    flat = clone_variant(found, min(levels, LEVELS), names, types)
    if levels <= LEVELS:
        return df.withColumn(column, flat)
    how = _Copy(names, types)
    deep = settled(df.where(depth(found) > LEVELS).withColumn("__row", F.monotonically_increasing_id()))
    parts = deep.select("__row", F.explode(how.cut(found, LEVELS, _root())).alias("__part")).select("__row", "__part.*")
    parts = clone_variants(parts, "value", names, types)
    # As many parts as one value has.
    below = parts.groupBy(F.col("__row").alias("__of")).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("__below"))
    joined = deep.join(below, deep["__row"] == below["__of"], "left")
    whole = joined.withColumn(column, let(found, lambda x: how.copy(x, LEVELS, _root(), F.col("__below"))))
    return df.where(depth(found) <= LEVELS).withColumn(column, flat).unionByName(whole.select(*df.columns))
