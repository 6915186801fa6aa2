"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpoint, id_and_text, remainder

#: Documents of either label that a fit uses at most, and characters of such a document; together
#: they bound what reaches the driver. Of a longer document evenly spaced pieces are taken.
MAX_PER_LABEL, MAX_CHARS, PIECE = 1200, 50_000, 1000


def pieces(text: Column, max_chars: int = MAX_CHARS, piece: int = PIECE) -> Column:
    """The text, or pieces from its whole length, of at most ``max_chars`` characters; words cut at their ends go."""
    n = max(1, max_chars // (piece + 1))
    step = (F.char_length(text) - piece).cast("double") / max(1, n - 1)
    cut = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substr(text, F.floor(i * step).cast("int") + 1, F.lit(piece)))
    whole_words = F.transform(cut, lambda c: F.regexp_replace(c, r"\A\S+\s+|\s+\S+\z", ""))
    return F.when(F.char_length(text) <= max_chars, text).otherwise(F.array_join(whole_words, "\n"))


def sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    divisor: int,
    held_out: int,
    train_if_equal: bool,
    max_per_label: int = MAX_PER_LABEL,
    max_chars: int = MAX_CHARS,
) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of a fixed pseudo-random sample, and how many usable labels there are.

    A row is usable if its document is in ``docs``, its label is 0 or 1 and crc32(doc_id) mod
    ``divisor`` differs from ``held_out`` (or equals it, with ``train_if_equal``). Ids with two
    different labels are not used; of documents with one id the least text is.
    """
    rest = remainder(F.col("doc_id"), divisor)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    usable = usable.where(rest == held_out if train_if_equal else rest != held_out)
    usable = checkpoint(usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z"))
    few = usable.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    # Only the documents' ids are read for this.
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(usable) if few else usable, "doc_id")
    there = checkpoint(there.groupBy("doc_id").agg(F.first("y").alias("y")))
    counts = {r.y: r.n for r in there.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    parts = [there.where(F.col("y") == y).orderBy(*order).limit(max_per_label) for y in (0, 1)]
    # At most 2 * max_per_label rows of two numbers.
    chosen = F.broadcast(parts[0].union(parts[1]))
    found = id_and_text(docs).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    rows = found.select(pieces(F.col("text"), max_chars).alias("text"), "y", "doc_id").orderBy("doc_id").collect()
    return [r.text for r in rows], [r.y for r in rows], counts
