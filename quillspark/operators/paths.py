"""``get`` and ``set`` by string paths over structs, maps, arrays, variants and JSON text.

A path is parsed once on the driver; the result is an ordinary ``Column`` expression, so
nested column pruning and code generation apply. Columns are immutable: ``set`` returns the
changed value.

Path: names parted by dots (repeated, leading and trailing dots are nothing), ``[0]`` for an
index, ``['k']``, ``["k"]`` or ``[k]`` for a name; a name may end in ``?`` to be safe.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import groupby
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import WHITESPACE

CACHE_SIZE = 250
#: What may stand around a name in brackets: everything up to the blank.
TRIMMED = "".join(map(chr, range(0x21)))


@dataclass(frozen=True)
class Property:
    name: str
    safe: bool = False


@dataclass(frozen=True)
class Index:
    at: int


Token = Property | Index


def parse(path: str | None) -> tuple[Token, ...]:
    """Tokens of a path; raises ValueError for a blank path or a bracket without an end."""
    if path is None or not path.strip(WHITESPACE):
        raise ValueError("a path must not be blank")
    return _parse(path)


@lru_cache(maxsize=CACHE_SIZE)
def _parse(path: str) -> tuple[Token, ...]:
    out: list[Token] = []
    rest = path
    while rest:
        if rest[0] == ".":
            rest = rest[1:]
        elif rest[0] == "[":
            inside, end, after = rest[1:].partition("]")
            if not end:
                raise ValueError(f"no closing bracket in path {path!r}")
            out.append(_bracketed(inside.strip(TRIMMED)))
            rest = after
        else:
            size = min((k for k in (rest.find("."), rest.find("[")) if k >= 0), default=len(rest))
            name, rest = rest[:size], rest[size:]
            safe = name.endswith("?")
            name = name[:-1] if safe else name
            if name:
                out.append(Property(name, safe))
    return tuple(out)


def _bracketed(inside: str) -> Token:
    if inside[:1] in ("'", '"') and inside[-1:] == inside[:1]:
        if len(inside) < 2:
            raise ValueError("a lone quote in brackets")
        return Property(inside[1:-1])
    if inside.isascii() and inside.isdigit():
        at = int(inside)
        if at > 2**31 - 1:
            raise ValueError(f"index {inside} is too large")
        return Index(at)
    return Property(inside)


class CachedParser:
    """``parse`` with a cache of its own; beyond ``capacity`` the least recently used paths go, 0 keeps none."""

    def __init__(self, capacity: int = CACHE_SIZE) -> None:
        if capacity < 0:
            raise ValueError("a capacity must not be negative")
        self._tokens = lru_cache(maxsize=capacity)(parse)

    def __call__(self, path: str | None) -> tuple[Token, ...]:
        return self._tokens(path)

    def size(self) -> int:
        return self._tokens.cache_info().currsize

    def clear(self) -> None:
        self._tokens.cache_clear()


class PathError(ValueError):
    """A path does not fit the schema it is used on."""


#: Mark in ``StructField.metadata``: whether unknown fields of the structs in this field are errors.
STRICT = "strict"


@dataclass(frozen=True)
class Node:
    """A value and what is known of its type while a path is followed.

    ``strict`` is what the nearest field on the way says of its structs; None if none does.
    """

    column: Column
    kind: T.DataType
    strict: bool | None = None


class PropertyAdapter(Protocol):
    """How named steps work on one family of types."""

    def supports(self, kind: T.DataType) -> bool: ...

    def get(self, node: Node, name: str) -> Node: ...

    def set(self, node: Node, name: str, change: Callable[[Node], Node]) -> Node: ...


class CollectionAdapter(Protocol):
    """How indexed steps work."""

    def get(self, node: Node, at: int) -> Node: ...

    def set(self, node: Node, at: int, change: Callable[[Node], Node]) -> Node: ...


def _null(kind: T.DataType) -> Node:
    return Node(F.lit(None).cast(kind), kind)


VOID = T.NullType()


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


class StructAdapter:
    """Fields by exact name. Lenient: an unknown field reads as NULL and ignores writes; strict: an error.

    A field's metadata may say for its own structs (also those in its arrays and maps) which of
    the two they are, ``{"strict": true}`` or ``{"strict": false}``; others follow the adapter.
    """

    def __init__(self, strict: bool = False) -> None:
        self.strict = strict

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.StructType)

    def _field(self, node: Node, name: str) -> T.StructField | None:
        found = next((f for f in node.kind.fields if f.name == name), None)
        if found is None and (self.strict if node.strict is None else node.strict):
            raise PathError(f"no field {name!r}")
        return found

    @staticmethod
    def _child(node: Node, wanted: T.StructField) -> Node:
        """Spark finds fields whatever their case, so that names which differ in nothing else are told apart by place."""
        strict = wanted.metadata.get(STRICT, node.strict) if wanted.metadata else node.strict
        if not _clashes(node.kind):
            return Node(node.column.getField(wanted.name), wanted.dataType, strict)
        at = next(i for i, f in enumerate(node.kind.fields) if f.name == wanted.name)
        by_place = T.StructType([T.StructField(f"f{i}", f.dataType, f.nullable) for i, f in enumerate(node.kind.fields)])
        return Node(node.column.cast(by_place).getField(f"f{at}"), wanted.dataType, strict)

    def get(self, node: Node, name: str) -> Node:
        found = self._field(node, name)
        return _null(VOID) if found is None else self._child(node, found)

    def set(self, node: Node, name: str, change: Callable[[Node], Node]) -> Node:
        found = self._field(node, name)
        if found is None:
            return node
        if _clashes(node.kind):
            return self.set_many(node, {name: change})
        new = change(self._child(node, found))
        # A NULL struct comes into being with NULL fields; the value itself stands here only once.
        held = F.coalesce(node.column, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in node.kind.fields]))
        fields = [T.StructField(f.name, new.kind if f.name == name else f.dataType, True, f.metadata) for f in node.kind.fields]
        return Node(held.withField(_quoted(name), new.column), T.StructType(fields), node.strict)

    def set_many(self, node: Node, changes: Mapping[str, Callable[[Node], Node]]) -> Node:
        """All changes in one rebuild."""
        known = {name for name in changes if self._field(node, name) is not None}
        if not known:
            return node
        columns, fields = [], []
        for f in node.kind.fields:
            part = self._child(node, f)
            part = changes[f.name](part) if f.name in known else part
            columns.append(part.column.alias(f.name))
            fields.append(T.StructField(f.name, part.kind, True, f.metadata))
        return Node(F.struct(*columns), T.StructType(fields), node.strict)


def _clashes(kind: T.StructType) -> bool:
    return len({f.name.lower() for f in kind.fields}) < len(kind.fields)


class MapAdapter:
    """Entries by key; a missing key reads as NULL, a write adds or replaces."""

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType)

    def get(self, node: Node, name: str) -> Node:
        return Node(F.try_element_at(node.column, F.lit(name)), node.kind.valueType, node.strict)

    def set(self, node: Node, name: str, change: Callable[[Node], Node]) -> Node:
        return self.set_many(node, {name: change})

    def set_many(self, node: Node, changes: Mapping[str, Callable[[Node], Node]]) -> Node:
        kind = node.kind.valueType
        made = {name: change(self.get(node, name)) for name, change in changes.items()}
        values = [x for name, new in made.items() for x in (F.lit(name), new.column if new.kind == kind else new.column.cast(kind))]
        base = F.coalesce(node.column, F.create_map().cast(node.kind))
        others = F.map_filter(base, lambda k, _: ~k.isin(*made))
        return Node(F.map_concat(others, F.create_map(*values)), node.kind, node.strict)


def as_variant(node: Node) -> Column:
    """The value as a variant; parts of structs, maps and arrays keep their form."""
    if isinstance(node.kind, T.VariantType):
        return node.column
    nested = isinstance(node.kind, T.StructType | T.MapType | T.ArrayType)
    return F.to_variant_object(node.column) if nested else node.column.cast("variant")


class VariantAdapter:
    """Keys of a variant object; a scalar or an array in the way reads as NULL and ignores writes."""

    ENTRIES = T.MapType(T.StringType(), T.VariantType())

    def supports(self, kind: T.DataType) -> bool:
        return isinstance(kind, T.VariantType)

    def get(self, node: Node, name: str) -> Node:
        if "'" not in name and '"' not in name and "\\" not in name:
            return Node(F.try_variant_get(node.column, f'$["{name}"]', "variant"), T.VariantType())
        entries = F.try_variant_get(node.column, "$", "map<string,variant>")
        return Node(F.try_element_at(entries, F.lit(name)), T.VariantType())

    def set(self, node: Node, name: str, change: Callable[[Node], Node]) -> Node:
        return self.set_many(node, {name: change})

    def set_many(self, node: Node, changes: Mapping[str, Callable[[Node], Node]]) -> Node:
        made = {name: change(self.get(node, name)) for name, change in changes.items()}
        values = [x for name, new in made.items() for x in (F.lit(name), as_variant(new))]
        entries = F.coalesce(F.try_variant_get(node.column, "$", "map<string,variant>"), F.create_map().cast(self.ENTRIES))
        others = F.map_filter(entries, lambda k, _: ~k.isin(*made))
        built = F.to_variant_object(F.map_concat(others, F.create_map(*values)))
        shape = F.schema_of_variant(node.column)
        # A JSON null is no value, so it gives way like a missing one.
        fits = node.column.isNull() | (shape == "VOID") | shape.startswith("OBJECT")
        return Node(F.when(fits, built).otherwise(node.column), T.VariantType())


class ArrayAdapter:
    """Elements from 0; past the end reads as NULL, and a write pads with NULLs.

    On a variant a value that is no array is replaced by a new one.
    """

    def get(self, node: Node, at: int) -> Node:
        if isinstance(node.kind, T.ArrayType):
            return Node(F.get(node.column, F.lit(at)), node.kind.elementType, node.strict)
        if isinstance(node.kind, T.VariantType):
            return Node(F.try_variant_get(node.column, f"$[{at}]", "variant"), T.VariantType())
        if isinstance(node.kind, T.NullType):
            return node
        raise PathError(f"no index into {node.kind.simpleString()}")

    def set(self, node: Node, at: int, change: Callable[[Node], Node]) -> Node:
        return self.set_many(node, {at: change})

    def set_many(self, node: Node, changes: Mapping[int, Callable[[Node], Node]]) -> Node:
        if isinstance(node.kind, T.VariantType):
            held = F.try_variant_get(node.column, "$", "array<variant>")
            made = self.set_many(Node(held, T.ArrayType(T.VariantType())), changes)
            return Node(F.to_variant_object(made.column), T.VariantType())
        if not isinstance(node.kind, T.ArrayType):
            (at, change), *others = changes.items()
            new = change(_null(VOID))
            empty = [F.lit(None).cast(new.kind)] * at
            made = Node(F.array(*empty, new.column), T.ArrayType(new.kind))
            return self.set_many(made, dict(others)) if others else made
        kind = node.kind.elementType
        values = {}
        for at, change in changes.items():
            new = change(ArrayAdapter.get(self, node, at))
            values[at] = new.column if new.kind == kind else as_variant(new) if isinstance(kind, T.VariantType) else new.column.cast(kind)
        held = F.coalesce(node.column, F.array().cast(node.kind))
        places = F.sequence(F.lit(0), F.greatest(F.size(held) - 1, F.lit(max(values))))

        def element(j: Column) -> Column:
            found = F.get(held, j)
            for at, value in values.items():
                found = F.when(j == at, value).otherwise(found)
            return found

        return Node(F.transform(places, element), T.ArrayType(kind), node.strict)


@dataclass
class Writes:
    """A trie of writes: the value that replaces what is here, if any, and what is then written below."""

    value: Node | None = None
    below: dict[Token, Writes] = field(default_factory=dict)

    def add(self, tokens: Sequence[Token], value: Node) -> None:
        if not tokens:
            self.value, self.below = value, {}
            return
        head = Property(tokens[0].name) if isinstance(tokens[0], Property) else tokens[0]
        # The latest write stands last, as it does after single writes.
        branch = self.below.pop(head, None) or Writes()
        self.below[head] = branch
        branch.add(tokens[1:], value)


class Accessor:
    """Follows paths with a list of property adapters (the first that supports a type wins)."""

    def __init__(self, properties: Sequence[PropertyAdapter], collection: CollectionAdapter, parser: Callable[[str], Sequence[Token]]) -> None:
        self.properties, self.collection, self.parser = tuple(properties), collection, parser

    def _adapter(self, kind: T.DataType) -> PropertyAdapter | None:
        return next((a for a in self.properties if a.supports(kind)), None)

    def get(self, column: Column, kind: T.DataType, path: str) -> Column:
        """The value at ``path``; NULL on the way is NULL."""
        node = Node(column, kind)
        for token in self.parser(path):
            node = self._step(node, token)
        return node.column

    def _step(self, node: Node, token: Token) -> Node:
        if isinstance(node.kind, T.NullType):
            return node
        if isinstance(token, Index):
            return self.collection.get(node, token.at)
        adapter = self._adapter(node.kind)
        try:
            if adapter is not None:
                return adapter.get(node, token.name)
            if isinstance(node.kind, T.ArrayType):
                raise PathError(f"no property {token.name!r} in an array")
        except Exception:  # a safe step gives NULL whatever an adapter raises
            if not token.safe:
                raise
        return _null(VOID)

    def set(self, column: Column, kind: T.DataType, path: str, value: Column, value_kind: T.DataType) -> Column:
        """The root with ``value`` at ``path``; intermediate values that are NULL are made."""
        return self.set_many(column, kind, [(path, value, value_kind)])

    def set_many(self, column: Column, kind: T.DataType, writes: Sequence[tuple[str, Column, T.DataType]]) -> Column:
        """The root after all writes (path, value, type of the value), as if they were made one after the other.

        Each value on the way is rebuilt once, so that the plan grows with the writes, not with
        their number as a power. Adapters without ``set_many`` are given one change at a time.
        """
        trie = Writes()
        for path, value, value_kind in writes:
            trie.add(tuple(self.parser(path)), Node(value, value_kind))
        return self._write(Node(column, kind), trie).column

    def _write(self, node: Node, writes: Writes) -> Node:
        node = node if writes.value is None else writes.value
        for indexed, group in groupby(writes.below.items(), key=lambda x: isinstance(x[0], Index)):
            changes = {
                token.at if indexed else token.name: lambda child, branch=branch: self._write(child, branch) for token, branch in group
            }
            if isinstance(node.kind, T.NullType):
                node = _null(VOID) if indexed else _null(T.VariantType())
            adapter = self.collection if indexed else self._adapter(node.kind)
            if adapter is None:
                if isinstance(node.kind, T.ArrayType):
                    raise PathError(f"no property {next(iter(changes))!r} in an array")
                continue  # below a scalar nothing can be set
            if len(changes) > 1 and _takes_many(adapter):
                node = adapter.set_many(node, changes)
            else:
                for key, change in changes.items():
                    node = adapter.set(node, key, change)
        return node


def _takes_many(adapter: object) -> bool:
    """Whether ``set_many`` goes with the adapter's ``set``, and is not that of a class whose ``set`` it replaces."""
    owner = next((c for c in type(adapter).__mro__ if "set" in vars(c) or "set_many" in vars(c)), None)
    return owner is not None and "set_many" in vars(owner)


class AccessorBuilder:
    """Custom adapters come after those registered before; without any, the defaults are used."""

    def __init__(self) -> None:
        self._properties: list[PropertyAdapter] = []
        self._collection: CollectionAdapter = ArrayAdapter()
        self._parser: Callable[[str], Sequence[Token]] = parse

    def register_property(self, adapter: PropertyAdapter) -> AccessorBuilder:
        if adapter is None:
            raise ValueError("an adapter is required")
        self._properties.append(adapter)
        return self

    def register_collection(self, adapter: CollectionAdapter) -> AccessorBuilder:
        if adapter is None:
            raise ValueError("an adapter is required")
        self._collection = adapter
        return self

    def with_parser(self, parser: Callable[[str], Sequence[Token]]) -> AccessorBuilder:
        if parser is None:
            raise ValueError("a parser is required")
        self._parser = parser
        return self

    def build(self) -> Accessor:
        return Accessor(self._properties or default_adapters(), self._collection, self._parser)


def default_adapters(strict: bool = False) -> list[PropertyAdapter]:
    return [MapAdapter(), StructAdapter(strict), VariantAdapter()]


def accessor(strict: bool = False) -> Accessor:
    return Accessor(default_adapters(strict), ArrayAdapter(), parse)


def path_get(column: Column, kind: T.DataType, path: str, strict: bool = False) -> Column:
    """The value at ``path`` of a column of type ``kind`` (``df.schema[name].dataType``)."""
    return accessor(strict).get(column, kind, path)


def path_set(column: Column, kind: T.DataType, path: str, value: Column, value_kind: T.DataType, strict: bool = False) -> Column:
    """The column with ``value`` at ``path``."""
    return accessor(strict).set(column, kind, path, value, value_kind)


def path_set_many(column: Column, kind: T.DataType, writes: Sequence[tuple[str, Column, T.DataType]], strict: bool = False) -> Column:
    """The column after several writes, each (path, value, type of the value), in one rebuild."""
    return accessor(strict).set_many(column, kind, writes)


def strict_field(found: T.StructField, strict: bool = True) -> T.StructField:
    """The field with a mark that its structs are strict (records) or lenient (beans)."""
    return T.StructField(found.name, found.dataType, found.nullable, {**(found.metadata or {}), STRICT: strict})


def json_get(column: Column, path: str, as_type: str = "string") -> Column:
    """The value at ``path`` of JSON text; NULL for malformed text."""
    found = path_get(F.try_parse_json(column), T.VariantType(), path)
    return F.try_variant_get(found, "$", as_type)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_set(column: Column, path: str, value: Column, value_kind: T.DataType) -> Column:
    """JSON text with ``value`` at ``path``; NULL text counts as an empty object, malformed text stays as it is."""

    def changed(parsed: Column) -> Column:
        root = F.coalesce(parsed, F.parse_json(F.lit("{}")))
        new = F.to_json(path_set(root, T.VariantType(), path, value, value_kind))
        return F.when(column.isNotNull() & parsed.isNull(), column).otherwise(new)

    return let(F.try_parse_json(column), changed)
