"""Operator 1: near-duplicate classes by BagMinHash, banding and exact multiset overlap.

Two documents are linked if the weighted Jaccard similarity of their multisets of five-word
shingles is at least ``threshold``; classes are the connected components of the links.

1. One pass makes a signature, its bands and a 128-bit key of the multiset. Rows with equal
   keys (copies) are one node from the start, whatever their ids, and only nodes go on.
2. Members of a band bucket are verified against the bucket's most central member: n
   comparisons. Central is who shares bands with most nodes, that is the text that the
   others vary; it leads most buckets of its group, so few of these comparisons differ.
3. A bucket whose members are still in several components is finished exactly: small ones
   by all pairs across components, large ones by what two members can share. Elements that at
   most ``RARE`` members of large buckets have name their pairs themselves. Two members that
   share none of these overlap in common elements only, so those with too few of them leave,
   and a pair is looked at only if the fewer common elements of the two could reach the
   threshold. The rest goes in rounds: some members, the leaders, meet everything outside
   their component; the bucket is done once every member outside its largest component has
   been a leader. So no link that a bucket can show is lost.

Defined results: rows with a null id are left out of ``near_duplicates`` and take part in
``keep_one``; a document without words is a class of its own; repeated rows get the same
class; of an id that stands for several texts each text has its class, and none is lost;
texts of any length are taken whole; an empty table gives no rows; other columns, of whatever
name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import bands, signatures
from .common import BROADCAST_IDS, checkpoint, id_and_text, release, settled, text_slices, without_ids
from .components import components
from .shingles import WIDTH, mix, multiset, occurrences

THRESHOLD = 0.8
#: At similarity 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^24 = 0.99993.
BANDS, ROWS = 24, 5
#: Buckets up to this many members are finished by pairs, larger ones by rounds of leaders.
SMALL_BUCKET = 32
#: Leaders of a bucket's first round; each later round has eight times as many.
FIRST_LEADERS = 64
#: Pairs of one leader that go to one part of a join.
PAIRS_PER_PART = 2000
#: Cells of a fingerprint: how many elements of a set fall into each.
CELLS = 256
#: Pairs, and sets, that share a partition.
PAIRS_PER_TASK, SETS_PER_TASK = 25_000, 2000
#: Members of large buckets up to which an element that they share makes pairs of them.
RARE = 8
#: Bytes of text that are sketched at once; the points of their processes take some fifty times as much.
SLICE = 1_000_000
#: Buckets with several members, and texts with copies or links, up to which their tables are broadcast (about 40 MB).
BROADCAST_BUCKETS, BROADCAST_TEXTS = 500_000, 1_000_000
#: Elements of sets that are counted at once.
COUNTED = 1_000_000
#: Sets over this size skip the fingerprint test, whose cells hold small numbers.
MAX_CELLED = 1_000_000


def _key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a multiset."""
    return int(elements.sum(dtype=np.uint64)), int(mix(elements ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _keys(sets: list[np.ndarray]) -> list[pa.Array]:
    pairs = np.array([_key(e) for e in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
    return [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)]


def sketch(docs: DataFrame, width: int = WIDTH, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, k1, k2 (key of the multiset), n (its size) and bands (null without words)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SLICE):
            bags = [multiset(t, width) for t in texts]
            n = np.array([c.sum() for _, c in bags], np.int64)
            key = _keys([occurrences(*bag) for bag in bags])
            keys = bands(signatures(bags, n_bands * rows), n_bands).view(np.int64)
            flat = pa.array(keys.reshape(-1))
            offsets = pa.array(np.arange(len(bags) + 1, dtype=np.int32) * n_bands)
            listed = pa.ListArray.from_arrays(offsets, flat)
            listed = pa.compute.if_else(pa.array(n > 0), listed, pa.scalar(None, listed.type))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *key, pa.array(n), listed],
                names=["doc_id", "k1", "k2", "n", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n long, bands array<long>")


def elements(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """k1, k2, the multiset as a set of numbered occurrences, and the set's fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SLICE):
            sets = [occurrences(*multiset(t, width)) for t in texts]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
            listed = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
            cells = [np.bincount((e >> np.uint64(56)).astype(np.int64), minlength=CELLS) for e in sets]
            flat = pa.array(np.minimum(np.concatenate(cells), 32767).astype(np.int16))
            prints = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * CELLS), flat)
            yield pa.RecordBatch.from_arrays([*_keys(sets), listed, prints], names=["k1", "k2", "e", "cells"])

    return docs.mapInArrow(run, "k1 long, k2 long, e array<long>, cells array<short>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, na, b, nb)`` whose multisets overlap enough.

    Sizes prune first, then fingerprints: two sets share at most the smaller count of each
    cell, so a pair that this bound rejects cannot reach the threshold. Only then sets move.
    """
    fits = settled(pairs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")).distinct(), PAIRS_PER_TASK)
    used = _only(sets, fits)
    prints = used.select(F.col("doc").alias("a"), F.col("cells").alias("ca"))
    other = used.select(F.col("doc").alias("b"), F.col("cells").alias("cb"))
    most = F.aggregate(F.zip_with("ca", "cb", lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
    reach = (F.col("na") > MAX_CELLED) | (most >= threshold * (F.col("na") + F.col("nb") - most))
    fits = settled(fits.join(prints, "a").join(other, "b").where(reach).select("a", "b"), PAIRS_PER_TASK)
    used = _only(sets, fits)
    parts = fits.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_PART).alias("parts"))
    dealt = fits.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    spread = (
        used.join(parts, used["doc"] == parts["a"])
        .select("a", F.col("e").alias("ea"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        .withColumn("part", F.col("part").cast("long"))
    )
    right = used.select(F.col("doc").alias("b"), F.col("e").alias("eb"))
    both = dealt.join(spread, ["a", "part"]).join(right, "b")
    shared = F.size(F.array_intersect("ea", "eb"))
    alike = shared >= threshold * (F.size("ea") + F.size("eb") - shared)
    return settled(both.where(alike).select("a", "b"))


def _only(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of documents that are in ``pairs``; the others never move."""
    ids = settled(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct())
    few = ids.count() <= BROADCAST_IDS
    return sets.join(F.broadcast(ids) if few else ids, "doc", "left_semi")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their components."""
    named = labels.select(F.col("node").alias("doc"), "comp")
    known = members.join(named, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    split = known.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    return known.join(split.select("bucket"), "bucket", "left_semi")


def _crossing(open_: DataFrame) -> DataFrame:
    """All pairs across components in small buckets; the bucket's leader has had its turn."""
    rest = open_.where("doc <> leader")
    left = rest.select("bucket", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = rest.select("bucket", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return left.join(right, "bucket").where("a < b and ca <> cb").select("a", "na", "b", "nb")


def _counted(held: DataFrame) -> DataFrame:
    """x, held, one and docs for each element of the sets ``held(doc, e)`` that a slice of a task has.

    The rows are partial counts: an element has as many as slices that hold it, however many
    members of a group do. ``one`` is the least member; ``docs`` are all members of the slice,
    or null where these are more than ``RARE`` already.
    """
    most = RARE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column(1)
            ends = np.asarray(sets.offsets)
            start = 0
            while start < batch.num_rows:
                # Whole sets, up to COUNTED elements together.
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + COUNTED, "right")) - 1)
                part = sets.slice(start, end - start)
                size = np.diff(ends[start : end + 1])
                doc = np.repeat(batch.column(0).slice(start, end - start).to_numpy(), size)
                x = part.flatten().to_numpy()
                order = np.lexsort((doc, x))
                x, doc = x[order], doc[order]
                first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
                n = np.diff(np.append(first, len(x)))
                few = n <= most
                kept = doc[np.repeat(few, n)]
                offsets = np.append(0, np.cumsum(n * few)).astype(np.int32)
                docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))
                docs = pa.compute.if_else(pa.array(few), docs, pa.scalar(None, docs.type))
                yield pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(n), pa.array(doc[first]), docs], names=["x", "held", "one", "docs"])
                start = end
        release()

    return held.mapInArrow(run, "x long, held long, one long, docs array<long>")


def _shared(large: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs across components that share a rare element, and the members that may link without one, with r.

    r counts a member's elements that more than ``RARE`` members of large buckets have; two
    members without a rare element in common share no more than the lesser r. Partners have
    at least the bucket's least size, which bounds the similarity from above.
    """
    named = settled(large.select("doc", "n", "comp").distinct())
    known = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    # A group's sets may lie in few parts; its elements are counted in many.
    held = sets.join(known.select("doc"), "doc", "left_semi").select("doc", "e").repartition("doc")
    counted = checkpoint(_counted(held))
    seen = counted.groupBy("x").agg(F.sum("held").alias("held"), F.min("one").alias("one"))
    seen = settled(seen.where(F.col("held") <= RARE), 500_000)
    rare = seen.where("held > 1").select("x")
    few = rare.count() <= BROADCAST_IDS
    own = counted.where("docs is not null").join(F.broadcast(rare) if few else rare, "x", "left_semi")
    own = settled(own.select("x", F.explode("docs").alias("doc")).join(known, "doc"), 100_000)
    left = own.select("x", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    right = own.select("x", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    pairs = left.join(right, "x").where("a < b and ca <> cb").select("a", "na", "b", "nb").distinct()
    apart = own.select("doc").union(seen.where("held = 1").select("one")).groupBy("doc").agg(F.count(F.lit(1)).alias("apart"))
    least = large.groupBy("bucket").agg(F.min("n").alias("least"))
    bounded = large.join(apart, "doc", "left").join(least, "bucket")
    r = F.col("n") - F.coalesce("apart", F.lit(0))
    reach = F.col("r") >= threshold * (F.col("n") + F.greatest("least", "r") - F.col("r"))
    return pairs, bounded.withColumn("r", r).where(reach).drop("least", "apart")


def _lead(open_: DataFrame, done: DataFrame, leaders: int) -> DataFrame:
    """The next leaders of each large bucket: members outside its largest component."""
    held = open_.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("held"))
    largest = held.groupBy("bucket").agg(F.max_by("comp", F.struct("held", "comp")).alias("largest"))
    fresh = open_.join(done, ["bucket", "doc"], "left_anti").join(largest, "bucket").where("comp <> largest")
    slot = F.pmod(F.xxhash64("doc", F.lit(leaders)), F.lit(leaders)).alias("slot")
    chosen = fresh.groupBy("bucket", slot).agg(F.min(F.struct("doc", "n", "r", "comp", "all")).alias("x"))
    x = F.col("x")
    return chosen.select("bucket", *[x[c].alias(d) for c, d in (("doc", "a"), ("n", "na"), ("r", "ra"), ("comp", "ca"), ("all", "alla"))])


def _linked(nodes: DataFrame, texts: DataFrame, threshold: float, width: int) -> DataFrame:
    """(node, comp) of the nodes that have a link; ``comp`` is the least node of the component."""
    banded = nodes.select(F.col("node").alias("doc"), "n", F.explode("bands").alias("bucket"))
    full = settled(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    few = full.count() <= BROADCAST_BUCKETS
    members = settled(banded.join(F.broadcast(full) if few else full, "bucket"))
    score = members.groupBy("doc").agg(F.sum("size").alias("score"))
    central = members.join(score, "doc").groupBy("bucket").agg(F.max(F.struct("score", (-F.col("doc")).alias("doc"))).alias("x"))
    central = central.select("bucket", (-F.col("x.doc")).alias("leader"))
    members = settled(members.join(F.broadcast(central) if few else central, "bucket"))
    sets = _sets(nodes.join(members.select(F.col("doc").alias("node")).distinct(), "node", "left_semi"), texts, width)
    sets = sets.coalesce(max(1, -(-sets.count() // SETS_PER_TASK)))

    sized = members.select(F.col("doc").alias("leader"), F.col("n").alias("na")).distinct()
    star = members.where("doc <> leader").select("leader", F.col("doc").alias("b"), F.col("n").alias("nb")).distinct()
    star = star.join(sized, "leader").select(F.col("leader").alias("a"), "na", "b", "nb")
    edges = verified(star, sets, threshold)
    labels = components(edges)

    open_ = settled(_labelled(members, labels))
    pairs = _crossing(open_.where(F.col("size") <= SMALL_BUCKET))
    large = settled(open_.where(F.col("size") > SMALL_BUCKET))
    if not large.isEmpty():
        rare, large = _shared(large, sets, threshold)
        pairs = pairs.union(rare)
        large = settled(_labelled(large.drop("comp"), labels))
        # A pair meets in the least bucket that both are in, and in no other.
        all_ = large.groupBy("doc").agg(F.collect_set("bucket").alias("all"))
        large = settled(large.join(all_, "doc"))
    done = large.select("bucket", F.col("leader").alias("doc")).distinct()
    leaders = FIRST_LEADERS
    while True:
        chosen = None if large.isEmpty() else settled(_lead(large, done, leaders))
        finished = chosen is None or chosen.isEmpty()
        if not finished:
            others = large.select("bucket", *[F.col(c).alias(d) for c, d in (("doc", "b"), ("n", "nb"), ("r", "rb"), ("comp", "cb"), ("all", "allb"))])
            both = F.least("ra", "rb")
            near = (F.col("ca") != F.col("cb")) & (both >= threshold * (F.col("na") + F.col("nb") - both))
            first = F.array_min(F.array_intersect("alla", "allb")) == F.col("bucket")
            led = others.join(chosen, "bucket").where(near & first)
            first = F.col("a") < F.col("b")  # a pair is one pair, whichever leads
            led = led.select(
                F.least("a", "b").alias("a"),
                F.when(first, F.col("na")).otherwise(F.col("nb")).alias("na"),
                F.greatest("a", "b").alias("b"),
                F.when(first, F.col("nb")).otherwise(F.col("na")).alias("nb"),
            )
            pairs = led if pairs is None else pairs.union(led)
        if pairs is not None:
            new = verified(pairs, sets, threshold)
            if not new.isEmpty():
                edges = settled(edges.union(new))
                labels = components(edges)
        if finished:
            return labels
        pairs = None
        done = settled(done.union(chosen.select("bucket", F.col("a").alias("doc"))))
        large = settled(_labelled(large.drop("comp"), labels))
        leaders *= 8


def _sets(wanted: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """doc (a node), e and cells of the wanted nodes, each made from one of its rows."""
    wanted = settled(wanted.select("node", "k1", "k2", "rep"))
    few = wanted.count() <= BROADCAST_IDS
    ids = wanted.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct()
    rows = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    if not wanted.where("rep is null").isEmpty():
        rows = rows.union(texts.where("doc_id is null"))
    found = elements(rows.select("doc_id", "text"), width)
    named = wanted.select("k1", "k2", F.col("node").alias("doc"))
    found = checkpoint(found.join(F.broadcast(named) if few else named, ["k1", "k2"]).select("doc", "e", "cells"))
    # Rows that repeat an id, or have none, may bring a node several times.
    return found if found.count() == wanted.count() else checkpoint(found.dropDuplicates(["doc"]))


def classified(texts: DataFrame, threshold: float, width: int, n_bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """A sketch of each row; and k1, k2, class_id, rep and leads of the multisets with copies or links.

    ``rep`` is the least id of a multiset's rows, ``class_id`` that of its class, and one
    multiset of each class leads it.
    """
    sketches = checkpoint(sketch(texts, width, n_bands, rows))
    nodes = sketches.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = checkpoint(nodes.withColumn("node", F.monotonically_increasing_id()))
    labels = _linked(nodes, texts, threshold, width)
    kept = nodes.select("node", "k1", "k2", "rep", "copies")
    few = labels.count() <= BROADCAST_TEXTS
    named = kept.join(F.broadcast(labels) if few else labels, "node", "left")
    linked = settled(named.where("comp is not null"))
    order = F.struct(F.col("rep").isNull().alias("none"), "rep", "node")
    heads = linked.groupBy("comp").agg(F.min("rep").alias("class_id"), F.min(order).alias("head"))
    linked = linked.join(heads, "comp").select("k1", "k2", "class_id", "rep", (F.col("node") == F.col("head.node")).alias("leads"))
    copied = named.where("comp is null and copies > 1").select("k1", "k2", F.col("rep").alias("class_id"), "rep", F.lit(True).alias("leads"))
    return sketches, settled(linked.union(copied))


def _with_class(sketches: DataFrame, classes: DataFrame, how: str) -> DataFrame:
    """Rows with words beside what is known of their text.

    A text may have any number of copies: its rows stay where they are if ``classes`` is small,
    and else it is their side of the join that Spark splits.
    """
    few = classes.count() <= BROADCAST_TEXTS
    return sketches.where("n > 0").select("doc_id", "k1", "k2").join(F.broadcast(classes) if few else classes, ["k1", "k2"], how)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, n_bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id and class_id (the least id of its class), one row for each row with an id."""
    sketches, classes = classified(id_and_text(docs).where("doc_id is not null"), threshold, width, n_bands, rows)
    found = _with_class(sketches, classes, "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return found.union(sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, all its columns as they are.

    The least id stays (of rows without one any, if no other has the text); of rows that also
    share id and text, one. Documents without words all stay.
    """
    texts = id_and_text(docs)
    sketches, classes = classified(texts, threshold, WIDTH, BANDS, ROWS)
    stays = F.col("leads") & F.col("doc_id").eqNullSafe(F.col("rep"))
    rest = without_ids(docs, _with_class(sketches, classes, "inner").where(~stays & F.col("doc_id").isNotNull()))
    repeated = checkpoint(sketches.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id")))
    if repeated.isEmpty() and sketches.where("doc_id is null").isEmpty():
        return rest
    # Ids don't tell the other rows apart, so that these are judged by their texts once more.
    few = repeated.count() <= BROADCAST_IDS
    ids = F.broadcast(repeated) if few else repeated
    same = F.col("doc_id").cast("long") == F.col("__id")
    plain = rest.where("doc_id is not null").join(ids, same, "left_anti")
    odd = docs.join(ids, same, "left_semi").unionByName(docs.where("doc_id is null"))

    @F.pandas_udf("k1 long, k2 long, n long")
    def key(text: pd.Series) -> pd.DataFrame:
        bags = [multiset(t or "") for t in text]
        pairs = np.array([_key(occurrences(*b)) for b in bags], np.uint64).reshape(len(bags), 2).view(np.int64)
        return pd.DataFrame({"k1": pairs[:, 0], "k2": pairs[:, 1], "n": [int(b[1].sum()) for b in bags]})

    text = F.col("text").cast("string")
    odd = odd.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key(text).alias("key"))
    odd = odd.select("row", "doc_id", "text", "key.*")
    few = classes.count() <= BROADCAST_TEXTS
    worded = odd.where("n > 0").join(F.broadcast(classes) if few else classes, ["k1", "k2"], "left").where(F.col("leads").isNull() | stays)
    one = worded.groupBy("k1", "k2").agg(F.min_by("row", "text").alias("row"))
    return plain.unionByName(one.union(odd.where("n = 0").select("k1", "k2", "row")).select("row.*"))
