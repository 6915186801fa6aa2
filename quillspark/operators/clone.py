"""Deep copy and pruning of nested columns, directed by the schema.

Values in Spark are trees, so a copy equals its source; what a copy can do is leave out
marked fields and types, and pass chosen types through custom strategies. Marks stand in
``StructField.metadata``: ``{"ignore_clone": true}`` on a field makes it NULL in the copy;
``{"transient": true}`` does the same (a field that is no part of the value);
``{"immutable": true}`` on a field whose type is a struct, array or map shares it as it is.
The schema of the copy is that of the source. Cycles and shared identity do not exist here.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IGNORE = "ignore_clone"
TRANSIENT = "transient"
IMMUTABLE = "immutable"


class Strategy(Protocol):
    """How values of some types are copied."""

    def supports(self, kind: T.DataType) -> bool: ...

    def copy(self, column: Column, kind: T.DataType, cloner: Cloner) -> Column: ...


class Scalars:
    """Everything without parts is shared as it is."""

    def supports(self, kind: T.DataType) -> bool:
        return not isinstance(kind, T.StructType | T.MapType | T.ArrayType)

    def copy(self, column: Column, kind: T.DataType, cloner: Cloner) -> Column:
        return column


class Maps:
    """Keys and values are copied; a key type that is to be left out is an error, since no key may be NULL."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.MapType)

    def copy(self, column: Column, kind: T.MapType, cloner: Cloner) -> Column:
        if cloner.is_ignored(kind.keyType):
            raise ValueError(f"keys of a map cannot be left out: {kind.keyType.simpleString()}")
        if cloner.is_identity(kind.keyType):
            return F.transform_values(column, lambda _, v: cloner.proceed(v, kind.valueType))
        entries = F.transform(
            F.map_entries(column),
            lambda e: F.struct(
                cloner.proceed(e["key"], kind.keyType).alias("key"), cloner.proceed(e["value"], kind.valueType).alias("value")
            ),
        )
        return F.map_from_entries(entries)


class Arrays:
    """Elements are copied; an ignored element stays in its place as NULL."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.ArrayType)

    def copy(self, column: Column, kind: T.ArrayType, cloner: Cloner) -> Column:
        return F.transform(column, lambda x: cloner.proceed(x, kind.elementType))


class Structs:
    """Fields are copied one by one; marked ones become NULL. A NULL struct stays NULL."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.StructType)

    def copy(self, column: Column, kind: T.StructType, cloner: Cloner) -> Column:
        fields = [cloner.field(column.getField(f.name), f).alias(f.name, metadata=f.metadata) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields))


def _left_out(field: T.StructField) -> bool:
    return bool(field.metadata.get(IGNORE) or field.metadata.get(TRANSIENT))


class Cloner:
    """Strategies in order (the first that supports a type copies it), types to leave out and types to share.

    Types are compared by names and kinds of their parts; nullability and metadata don't count.
    """

    def __init__(self, strategies: Sequence[Strategy] = (), ignored: Sequence[T.DataType] = (), immutable: Sequence[T.DataType] = ()) -> None:
        # The last one registered is asked first, and all before the built-in ones.
        self.strategies: list[Strategy] = [*reversed(strategies), Scalars(), Maps(), Arrays(), Structs()]
        self.ignored = {k.simpleString() for k in ignored}
        self.immutable = {k.simpleString() for k in immutable}
        self.custom = len(strategies)

    def strategy(self, kind: T.DataType) -> Strategy:
        return next(s for s in self.strategies if s.supports(kind))

    def is_ignored(self, kind: T.DataType) -> bool:
        return kind.simpleString() in self.ignored

    def is_identity(self, kind: T.DataType) -> bool:
        """Whether a copy of this type is the value itself, so that no expression is needed."""
        if self.is_ignored(kind) or any(s.supports(kind) for s in self.strategies[: self.custom]):
            return False
        if kind.simpleString() in self.immutable:
            return True
        if isinstance(kind, T.StructType):
            return all(not _left_out(f) and (bool(f.metadata.get(IMMUTABLE)) or self.is_identity(f.dataType)) for f in kind.fields)
        if isinstance(kind, T.MapType):
            return self.is_identity(kind.keyType) and self.is_identity(kind.valueType)
        if isinstance(kind, T.ArrayType):
            return self.is_identity(kind.elementType)
        return True

    def proceed(self, column: Column, kind: T.DataType) -> Column:
        """A copy of a value: NULL stays NULL, ignored types become NULL."""
        if self.is_ignored(kind):
            return F.lit(None).cast(kind)
        if self.is_identity(kind):
            return column
        return self.strategy(kind).copy(column, kind, self)

    def field(self, column: Column, field: T.StructField) -> Column:
        """A copy of a struct's (or a row's) field, which its marks may rule."""
        if _left_out(field):
            return F.lit(None).cast(field.dataType)
        if field.metadata.get(IMMUTABLE) and not self.is_ignored(field.dataType):
            return column
        return self.proceed(column, field.dataType)

    def clone(self, df: DataFrame) -> DataFrame:
        """Every column of ``df`` copied; names, order and types stay."""
        columns = [self.field(F.col(f"`{f.name.replace('`', '``')}`"), f).alias(f.name, metadata=f.metadata) for f in df.schema.fields]
        return df.select(*columns)


class ClonerBuilder:
    """Collects strategies and types for a ``Cloner``."""

    def __init__(self) -> None:
        self._strategies: list[Strategy] = []
        self._ignored: list[T.DataType] = []
        self._immutable: list[T.DataType] = []

    def register_strategy(self, strategy: Strategy) -> ClonerBuilder:
        if strategy is None:
            raise ValueError("a strategy is required")
        self._strategies.append(strategy)
        return self

    def ignore_type(self, kind: T.DataType) -> ClonerBuilder:
        self._ignored.append(kind)
        return self

    def immutable_type(self, kind: T.DataType) -> ClonerBuilder:
        """Values of this type are shared as they are, marks within it included, unless a strategy takes them."""
        self._immutable.append(kind)
        return self

    def build(self) -> Cloner:
        return Cloner(self._strategies, self._ignored, self._immutable)


def deep_clone(value: DataFrame | Column, kind: T.DataType | None = None, strategies: Sequence[Strategy] = ()) -> DataFrame | Column:
    """Copies a DataFrame, or a column of the given type, with the built-in strategies and any others."""
    cloner = Cloner(strategies)
    if isinstance(value, DataFrame):
        return cloner.clone(value)
    if kind is None:
        raise ValueError("the type of the column is required")
    return cloner.proceed(value, kind)


def marked(field: T.StructField, mark: str = IGNORE) -> T.StructField:
    """The field with a mark in its metadata."""
    return T.StructField(field.name, field.dataType, field.nullable, {**(field.metadata or {}), mark: True})
