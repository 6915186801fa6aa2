"""Operator 12: how sources diverge from their language and from each other, by sorted word pointers.

Terms are runs of letters (ASCII letters in lower case, and all characters beyond ASCII). Each
task takes slices of the texts as Arrow buffers, and makes a pointer to every word's start. The
pointers of a slice are sorted by the words they stand at: a multikey quicksort whose symbols
are several bytes wide, so that a pass parts all runs of words that are still equal, and words
that have ended or stand alone drop out. Equal runs are the terms of the slice; the documents
and sources of a run's pointers give its document frequency and its counts. Spark adds up the
slices' counts.

Counts are smoothed to parts per billion (exact, in decimals wide enough for any corpus), and
compared between the sources of a language, and between a source and its language.

Defined results: null text, language and source are empty text; every row is a document of its
own, repeated ids and texts too; a group without terms has all counts 0; a language without a
kept term gives no rows of part ``term``, and 0 for each pair; ties go by item; texts and words
of any length are taken whole; an empty table gives no rows; other columns, of whatever name,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, row_slices

MIN_DOCS = 30
TOP_TERMS = 50
SMOOTHING = 5
SCALE = 1_000_000_000
#: Languages and groups up to which their table is broadcast.
BROADCAST_GROUPS = 100_000

_COUNTS = "lang string, source string, term string, docs long, n long"
_SYMBOL = 8


def _letters() -> np.ndarray:
    """What each byte becomes: 0 where it ends a word, else itself with ASCII letters in lower case."""
    table = np.arange(256, dtype=np.uint8)
    table[:0x41] = table[0x5B:0x61] = table[0x7B:0x80] = 0
    table[0x41:0x5B] += 32
    return table


LETTERS = _letters()


def word_pointers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each word in ``data``, texts one after the other that end at ``ends``; no word crosses an end."""
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) - start + 1


def _symbols(data: np.ndarray, start: np.ndarray, size: np.ndarray, skip: int, width: int) -> np.ndarray:
    """The ``width`` bytes of each word from its byte ``skip`` on, as numbers that sort like them; past its end zeros."""
    places = np.lib.stride_tricks.sliding_window_view(data, width)[start + skip]
    if width == _SYMBOL:
        key = places.view(">u8").ravel().astype(np.uint64)
        spare = (8 * (width - np.minimum(size - skip, width))).astype(np.uint64)
        return key >> spare << spare
    kept = np.where(np.arange(width) < (size - skip)[:, None], places, 0).astype(np.uint8)
    return np.unique(kept.view(f"S{width}").ravel(), return_inverse=True)[1].astype(np.uint64)


def sort_pointers(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the words at the pointers, and a mark at the first pointer of each run of equal words.

    Equal words keep the order of their pointers. ``data`` must go on for as many bytes behind
    the last word as the longest word has, and ``_SYMBOL`` at least.
    """
    key = _symbols(data, start, size, 0, _SYMBOL)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    done = width = _SYMBOL
    # Places (in the order so far) whose words go on and whose run has others. A word that has ended sorts first.
    while True:
        run = np.cumsum(new) - 1
        crowd = np.bincount(run, minlength=run[-1] + 1 if len(run) else 0)
        longer = np.zeros(len(crowd), bool)
        longer[run[size[order] > done]] = True
        at = np.flatnonzero((longer & (crowd > 1))[run])
        if not len(at):
            return order, new
        mine = order[at]
        goes_on = size[mine] > done
        symbol = np.zeros(len(at), np.uint64)
        symbol[goes_on] = _symbols(data, start[mine[goes_on]], size[mine[goes_on]], done, width) + np.uint64(width != _SYMBOL)
        by = np.lexsort((symbol, goes_on, run[at]))
        order[at] = mine[by]
        symbol, goes_on, runs = symbol[by], goes_on[by], run[at]
        new[at[1:]] = (runs[1:] != runs[:-1]) | (symbol[1:] != symbol[:-1]) | (goes_on[1:] != goes_on[:-1])
        done += width
        width = done  # so a word of any length takes few passes


def count_slice(texts: pa.Array, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, documents, occurrences) of a slice of texts, of which each has a group's number."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
    ends = bounds[1:] - bounds[0]
    data = LETTERS[raw]
    start, size = word_pointers(data, ends)
    if not len(start):
        none = np.zeros(0, np.int64)
        return [], none, none, none
    doc = np.searchsorted(ends, start, side="right")
    data = np.concatenate([data, np.zeros(max(2 * int(size.max()), _SYMBOL), np.uint8)])
    order, new = sort_pointers(data, start, size)
    run, doc = np.cumsum(new) - 1, doc[order]
    # Pointers of a run stand in the order of their documents.
    fresh = new.copy()
    fresh[1:] |= doc[1:] != doc[:-1]
    groups = int(group.max()) + 1
    cell = run * groups + group[doc]
    cells, inverse = np.unique(cell, return_inverse=True)
    n = np.bincount(inverse, minlength=len(cells))
    docs = np.bincount(inverse[fresh], minlength=len(cells))
    heads = order[np.flatnonzero(new)]
    held = data.tobytes()
    terms = [held[a:b] for a, b in zip(start[heads].tolist(), (start + size)[heads].tolist(), strict=True)]
    return [terms[i] for i in (cells // groups).tolist()], cells % groups, docs, n


def count_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts for each language, source and term of each slice of rows (``lang``, ``source``, ``text``)."""
    for part in row_slices(batches):
        names = pc.binary_join_element_wise(part["lang"], part["source"], "\x00").dictionary_encode()
        group = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, first = np.unique(group, return_index=True)
        terms, of, docs, n = count_slice(part["text"], group)
        row = pa.array(first[of] if len(of) else np.zeros(0, np.int64))
        columns = [part["lang"].take(row), part["source"].take(row), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs), pa.array(n)]
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


_NAMES = ["lang", "source", "term", "docs", "n"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has been counted and is small."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exact."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    below = (total.cast("decimal(20,0)") + terms.cast("decimal(15,0)") * F.lit(SMOOTHING).cast("decimal(2,0)")).cast("decimal(22,0)")
    return (F.call_function("div", above, below) + 1).cast("long")


def term_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts(lang, source, term, docs, n)`` and ``groups(lang, source)``, groups without terms among them."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = plain.mapInArrow(count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    return checkpoint(counts), checkpoint(plain.select("lang", "source").distinct())


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: the distance of a source from each other of its language, over all kept terms.
    Part ``term``: the terms that set a source apart most, up to rank ``top``. The result has a
    row for each pair of sources, so a language's sources have to be few enough for that; their
    counts of one term stand in one row.
    """
    counts, groups = term_counts(docs)
    of_term = counts.groupBy("lang", "term").agg(
        F.sum("docs").alias("df"), F.sum("n").alias("in_lang"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("by_source")
    )
    kept = checkpoint(of_term.where(F.col("df") >= min_docs).drop("df"))
    sizes = checkpoint(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("in_lang").alias("lang_total")))
    in_vocabulary = kept.select("lang", F.explode("by_source").alias("source", "n"))
    totals = in_vocabulary.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"))
    sources = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"))
    sources = checkpoint(sources.join(sizes, "lang", "left").select("lang", "sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")))
    wide = kept.join(_small(sources), "lang")
    own = F.transform("sources", lambda g: F.coalesce(F.try_element_at("by_source", g["source"]), F.lit(0)))
    wide = wide.withColumn("count", own).withColumn("p", F.transform("sources", lambda g, i: share(F.get("count", i), g["total"], F.col("v"))))
    wide = wide.withColumn("q", share(F.col("in_lang"), F.col("lang_total"), F.col("v")))

    # A row for each term and source, which sums the distances to all sources in one array.
    left = wide.select("lang", "p", F.posexplode("sources").alias("i", "g"))
    gaps = left.select("lang", F.col("g.source").alias("source"), F.posexplode(F.transform("p", lambda x: F.abs(x - F.get("p", F.col("i"))))).alias("j", "f"))
    far = gaps.groupBy("lang", "source", "j").agg(F.sum("f").alias("value"))
    others = sources.select("lang", "sources", F.explode("sources.source").alias("source")).select("lang", "source", F.posexplode("sources.source").alias("j", "item"))
    pairs = others.join(far, ["lang", "source", "j"], "left").where(F.col("source") != F.col("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    above = wide.select("lang", F.col("term").alias("item"), "q", F.explode(F.arrays_zip("sources.source", "count", "p")).alias("g"))
    above = above.where((F.col("g.count") > 0) & (F.col("g.p") > F.col("q")))
    above = above.select("lang", F.col("g.source").alias("source"), F.lit("term").alias("part"), "item", (F.col("g.p") - F.col("q")).alias("value"))

    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
