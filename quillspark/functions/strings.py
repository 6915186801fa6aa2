"""Null-safe string expressions: ``Column`` in, ``Column`` out, planned by Catalyst.

White space means the characters of Java's ``Character.isWhitespace``; NBSP (U+00A0), U+2007
and U+202F are not white space. Case mapping follows Spark's locale-free ``lower`` and
``upper``; reversing and capitalising work on code points.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nfkc import nfkc

ColumnOrText = Column | str | None

#: The white-space characters, for ``btrim``.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000],
    )
)


def _text(value: ColumnOrText) -> Column:
    """A literal for a Python string or None; columns pass through."""
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def _quoted(text: Column) -> Column:
    """The text as a literal piece of a Java regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def is_blank(c: Column) -> Column:
    """True for NULL, empty and all-white-space text."""
    return F.coalesce(~c.rlike(r"\P{javaWhitespace}"), F.lit(True))


def is_not_blank(c: Column) -> Column:
    return ~is_blank(c)


def is_empty(c: Column) -> Column:
    """True for the empty text only; NULL is not empty."""
    return F.coalesce(c == "", F.lit(False))


def is_not_empty(c: Column) -> Column:
    return ~is_empty(c)


def equals(a: Column, b: ColumnOrText) -> Column:
    """Null-safe equality: two NULLs are equal."""
    return a.eqNullSafe(_text(b))


def _simple_fold(c: str) -> str:
    """One character in upper, then in lower case, where these are one character."""
    upper = next((u for u in (c.upper(), c.title()) if len(u) == 1), c)
    return upper.lower()[0]  # "İ", whose lower case has a dot of its own, goes with "i"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """The characters that fold to another, and those others, in order."""
    folds = [(c, _simple_fold(c)) for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    changed = [(c, f) for c, f in folds if c != f]
    return "".join(c for c, _ in changed), "".join(f for _, f in changed)


def fold_key(c: Column) -> Column:
    """A key that texts share if they are equal under simple case folding; NULL has that of the empty text.

    It makes case-blind equality a hash join, a group or a sort. ASCII text only needs ``lower``.
    """
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *fold_table())).otherwise(F.lower(text))


def equals_ignore_case(a: Column, b: ColumnOrText) -> Column:
    """Equality under simple case folding, character by character; NULL counts as empty text."""
    return fold_key(a) == fold_key(_text(b))


def reverse(c: Column) -> Column:
    """Code points backwards; NULL gives the empty text."""
    return F.reverse(F.coalesce(c, F.lit("")))


def strip(c: Column, empty_if_null: bool = True) -> Column:
    """Without white space at either end; NULL gives the empty text unless told otherwise."""
    out = F.btrim(c, F.lit(WHITESPACE))
    return F.coalesce(out, F.lit("")) if empty_if_null else out


def strip_left(c: Column, prefix: ColumnOrText, repeat: bool = True) -> Column:
    """Without a literal prefix, once or as often as it stands there; NULL or empty prefix: unchanged."""
    return _strip(c, prefix, r"\A(?:{})" + ("++" if repeat else ""))


def strip_right(c: Column, suffix: ColumnOrText, repeat: bool = True) -> Column:
    """Without a literal suffix, once or as often as it stands there; NULL or empty suffix: unchanged."""
    return _strip(c, suffix, r"(?:{})" + ("++" if repeat else "") + r"\z")


def _strip(c: Column, piece: ColumnOrText, shape: str) -> Column:
    if piece is None or (isinstance(piece, str) and not piece):
        return c
    before, after = shape.split("{}")
    if isinstance(piece, str):
        quoted = r"\Q" + piece.replace(r"\E", r"\E\\E\Q") + r"\E"
        return F.regexp_replace(c, before + quoted + after, "")
    pattern = F.concat(F.lit(before), _quoted(piece), F.lit(after))
    return F.when(F.coalesce(piece, F.lit("")) == "", c).otherwise(F.regexp_replace(c, pattern, F.lit("")))


Pattern = Column | str


def _pieces(c: Column, pattern: Pattern) -> Column:
    """All pieces between matches. An empty pattern parts all characters, with an empty piece at the end."""
    letters = F.when(c == "", F.array(F.lit(""))).otherwise(F.concat(F.split(c, "", -1), F.array(F.lit(""))))
    if pattern is None:
        raise ValueError("a split pattern is required")
    if isinstance(pattern, str):
        return letters if pattern == "" else F.split(c, pattern, -1)
    missing = F.raise_error(F.lit("a split pattern is required")).cast("array<string>")
    return F.when(pattern.isNull(), missing).when(pattern == "", letters).otherwise(F.split(c, pattern, -1))


def _parts(c: Column, pattern: Pattern, keep_trailing: bool) -> Column:
    """All pieces between matches; trailing empty ones only if asked for."""
    parts = _pieces(c, pattern)
    if keep_trailing:
        return parts
    last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1)))
    # One piece means that nothing matched; then even an empty text stays.
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), F.coalesce(last, F.lit(0))))


def _rejoined(parts: Column, pattern: Pattern) -> Column:
    """The pieces with the pattern's own text between them."""
    return F.call_function("array_join", parts, pattern if isinstance(pattern, Column) else F.lit(pattern))


def _none_to_empty(c: Column, parts: Column) -> Column:
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(parts)


def split(c: Column, pattern: Pattern, limit: int = 0, preserve_empty: bool = False) -> Column:
    """Pieces of the text between matches of a Java regular expression; NULL gives no pieces.

    Without ``preserve_empty`` trailing empty pieces go (unless ``limit`` is negative) and a
    positive limit has no effect. With it all stay, and a positive limit keeps the first
    ``limit - 1`` pieces and joins the rest with the pattern's text. The pattern may be a column,
    of which each row's own pattern is used; a NULL pattern is an error.
    """
    parts = _parts(c, pattern, preserve_empty or limit < 0)
    if preserve_empty and limit > 0:
        tail = _rejoined(F.slice(parts, F.lit(limit), F.greatest(F.size(parts), F.lit(1))), pattern)
        merged = F.concat(F.slice(parts, 1, limit - 1), F.array(tail))
        parts = F.when(F.size(parts) <= limit, parts).otherwise(merged)
    return _none_to_empty(c, parts)


def split_preserve_empty(c: Column, pattern: Pattern) -> Column:
    return split(c, pattern, 0, True)


def rsplit(c: Column, pattern: Pattern, limit: int = 0, preserve_empty: bool = False) -> Column:
    """Like ``split``, but a positive limit keeps the last ``limit - 1`` pieces and joins those before."""
    parts = _parts(c, pattern, preserve_empty or limit < 0)
    if limit > 0:
        over = F.greatest(F.size(parts) - (limit - 1), F.lit(0))
        head = _rejoined(F.slice(parts, F.lit(1), over), pattern)
        merged = F.concat(F.array(head), F.slice(parts, over + 1, F.lit(limit - 1)))
        parts = F.when(F.size(parts) <= limit, parts).otherwise(merged)
    return _none_to_empty(c, parts)


def check_patterns(df: DataFrame, column: str) -> None:
    """Raises ValueError if a pattern in the column is NULL or malformed; each is compiled once."""
    patterns = df.select(F.col(column).alias("p")).distinct()
    if not patterns.where("p IS NULL").isEmpty():
        raise ValueError("a split pattern is required")
    try:
        patterns.where(F.regexp_like(F.lit(""), F.col("p"))).count()
    except Exception as error:
        raise ValueError(f"a malformed pattern in {column!r}: {error}") from error


def rsplit_preserve_empty(c: Column, pattern: Pattern, limit: int = 0) -> Column:
    return rsplit(c, pattern, limit, True)


def contains(c: Column, content: ColumnOrText) -> Column:
    """False for NULL or blank text and for NULL content; otherwise plain containment."""
    return F.coalesce(~is_blank(c) & F.contains(c, _text(content)), F.lit(False))


def to_lower(c: Column) -> Column:
    return F.lower(c)


def to_upper(c: Column) -> Column:
    return F.upper(c)


def capitalize(c: Column) -> Column:
    """First code point in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def word_capitalize(c: Column) -> Column:
    """NFKC, then ``capitalize`` for every piece between single blanks; blank and NULL text as is."""
    words = F.split(nfkc(c), " ", -1)
    return F.when(is_blank(c), c).otherwise(F.array_join(F.transform(words, capitalize), " "))


