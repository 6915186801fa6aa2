"""``get`` and ``set`` on variants by paths that stand in a column.

The grammar is that of ``paths.parse``, as one SQL expression: a path becomes an array of
tokens, and the steps are a fold over it, row by row and without Python. A table may so hold
paths of any mix.

Defined results: a NULL value reads as NULL, and a write makes what is missing, as with literal
paths; a path that is NULL, blank or malformed is an error of the query, or NULL (value as it
is, for a write) with ``safe=True``; a path without tokens, like ``.``, means the value itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.strings import is_blank
from .paths import TRIMMED

_TOKEN = "struct<name:string,at:int>"
_PIECE = r"(\[[^\]]*\]|[^.\[]+)"
_OBJECT, _ARRAY = "map<string,variant>", "array<variant>"


def _bracketed(inside: Column) -> Column:
    """The token of what stands between brackets; NULL where that is malformed."""
    quoted = inside.rlike(r"""(?s)\A(?:'.*'|".*")\z""") & (F.char_length(inside) > 1)
    number = inside.try_cast("int")
    name = F.when(quoted, F.substr(inside, F.lit(2), F.char_length(inside) - 2)).otherwise(inside)
    named = F.struct(name.alias("name"), F.lit(None).cast("int").alias("at"))
    indexed = F.struct(F.lit(None).cast("string").alias("name"), number.alias("at"))
    numeric = inside.rlike(r"\A[0-9]+\z")
    wrong = inside.isin("'", '"') | (numeric & number.isNull())
    return F.when(wrong, F.lit(None).cast(_TOKEN)).when(numeric, indexed).otherwise(named)


def _plain(name: Column) -> Column:
    """The token of a name outside brackets; one "?" at its end only says that the step is safe."""
    bare = F.regexp_replace(name, r"\?\z", "")
    return F.struct(bare.alias("name"), F.lit(None).cast("int").alias("at"))


def tokens(path: Column) -> Column:
    """The path as an array of (name, at), of which one is NULL; NULL for a path that is none."""
    pieces = F.regexp_extract_all(path, F.lit(_PIECE), F.lit(1))

    def token(piece: Column) -> Column:
        inside = F.btrim(F.substr(piece, F.lit(2), F.char_length(piece) - 2), F.lit(TRIMMED))
        return F.when(F.startswith(piece, F.lit("[")), _bracketed(inside)).otherwise(_plain(piece))

    # A lone "?" is a name of no letters, which is no step.
    found = F.transform(F.filter(pieces, lambda p: p != "?"), token)
    open_bracket = F.contains(F.regexp_replace(path, _PIECE, ""), F.lit("["))
    wrong = is_blank(path) | open_bracket | F.exists(found, lambda t: t.isNull())
    return F.when(~wrong, found)


def _known(path: Column) -> Column:
    message = F.concat(F.lit("not a path: "), F.coalesce(path, F.lit("NULL")))
    return F.coalesce(tokens(path), F.raise_error(message).cast(f"array<{_TOKEN}>"))


def _step(value: Column, token: Column) -> Column:
    by_index = F.get(F.try_variant_get(value, "$", _ARRAY), token["at"])
    by_name = F.try_element_at(F.try_variant_get(value, "$", _OBJECT), token["name"])
    return F.when(token["at"].isNotNull(), by_index).otherwise(by_name)


def path_get_by(value: Column, path: Column, safe: bool = False) -> Column:
    """The part of a variant that each row's own path names."""
    return F.aggregate(tokens(path) if safe else _known(path), value, _step)


def _put(held: Column, token: Column, new: Column) -> Column:
    """``held`` with ``new`` at one step; what does not fit a named step stays, an indexed one replaces it."""
    entries = F.coalesce(F.try_variant_get(held, "$", _OBJECT), F.create_map().cast(_OBJECT))
    others = F.map_filter(entries, lambda k, _: k != token["name"])
    named = F.to_variant_object(F.map_concat(others, F.map_from_arrays(F.array(token["name"]), F.array(new))))
    shape = F.schema_of_variant(held)
    fits = held.isNull() | (shape == "VOID") | F.startswith(shape, F.lit("OBJECT"))
    elements = F.coalesce(F.try_variant_get(held, "$", _ARRAY), F.array().cast(_ARRAY))
    places = F.sequence(F.lit(0), F.greatest(F.size(elements) - 1, token["at"]))
    indexed = F.to_variant_object(F.transform(places, lambda j: F.when(j == token["at"], new).otherwise(F.get(elements, j))))
    return F.when(token["at"].isNotNull(), indexed).when(fits, named).otherwise(held)


def path_set_by(value: Column, path: Column, new: Column, safe: bool = False) -> Column:
    """The variant with ``new`` (a variant) at each row's own path.

    One fold goes down the path and keeps what it passes, another comes back and rebuilds it.
    """
    steps = tokens(path) if safe else _known(path)
    passed = F.lit(None).cast(f"array<struct<held:variant,token:{_TOKEN}>>")
    start = F.struct(value.alias("held"), F.coalesce(passed, F.array().cast(f"array<struct<held:variant,token:{_TOKEN}>>")).alias("passed"))

    def down(state: Column, token: Column) -> Column:
        here = F.struct(state["held"].alias("held"), token.alias("token"))
        return F.struct(_step(state["held"], token).alias("held"), F.concat(state["passed"], F.array(here)).alias("passed"))

    way = F.aggregate(steps, start, down, lambda s: F.reverse(s["passed"]))
    changed = F.aggregate(way, new, lambda below, here: _put(here["held"], here["token"], below))
    return F.when(tokens(path).isNull(), value).otherwise(changed) if safe else changed
