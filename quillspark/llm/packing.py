"""Operator 7: best-fit packing by bin-completion branch and bound.

Documents become token ids in Spark tasks. Sequences are planned over the histogram of piece
lengths, which has at most ``capacity`` entries at any corpus size; a pattern found once is
used as often as the histogram allows. Pieces then look up their place by their rank among
pieces of the same length, so no task and no driver ever holds the pieces. Ranks are counted
in parts, so a length that many pieces share is no burden.

Defined results: null text counts as empty (one end id); a text of any length is encoded
whole and cut into pieces of ``capacity``; null ids, repeated rows and ties are packed like
any other row; an empty table gives no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, id_and_text, row_slices
from .tokens import SLICE, encoder, tokenizer_path

CAPACITY = 2048
#: Fillings looked at for one largest document, and branch steps beyond the first dive.
FILLING_NODES = 4000
BRANCH_STEPS = 2000
#: Pieces of one length that are ranked together at least, and parts into which all are dealt at most
#: (besides one for each length); this bounds the table of parts, which is broadcast.
ROWS_PER_RANK, RANK_PARTS = 1000, 200_000

PIECE_SCHEMA = "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents; only documents over ``capacity`` are cut, first piece short."""
    path = tokenizer or tokenizer_path()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for part in row_slices(batches, SLICE):
            ids, at = encode(part.column(2))
            size = np.diff(at)
            many = np.where(size > capacity, -(-size // capacity), 1)
            # Only the first piece of a cut document may be shorter.
            first = np.where(many > 1, size - capacity * (many - 1), size)
            row = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + capacity * (piece - 1))
            low = at[:-1][row] + start
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            crc = [zlib.crc32(raw[a:b]) for a, b in zip((4 * low).tolist(), (4 * (low + length)).tolist(), strict=True)]
            index = pa.array(row)
            arrays = [part.column(0).take(index), part.column(1).take(index), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "row_key", "piece", "start", "length", "ids_crc32"]
            if keep_ids:  # pieces follow one another without gaps
                ends = pa.py_buffer(np.append(4 * low, len(raw)).astype(np.int64))
                arrays.append(pa.Array.from_buffers(pa.large_binary(), len(row), [None, ends, pa.py_buffer(raw)]).cast(pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = id_and_text(docs).select("doc_id", F.monotonically_increasing_id().alias("row_key"), "text")
    return rows.mapInArrow(cut, PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def dominated(filling: tuple[int, ...], other: tuple[int, ...]) -> bool:
    """Whether the documents of ``filling`` fit, first fit, into the places of those of ``other``.

    Then whatever can be packed after ``filling`` can be packed after ``other`` as well.
    """
    room = list(other)
    for n in filling:
        k = next((k for k, r in enumerate(room) if r >= n), None)
        if k is None:
            return False
        room[k] -= n
    return True


def fillings(
    room: int, sizes: list[int], counts: dict[int, int], keep: int = 4, nodes: int = FILLING_NODES, every: bool = False
) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first, fewer and larger documents before more.

    ``sizes`` ascend and have a positive count. Depth first, larger sizes first; a branch
    ends when all that it could still hold cannot beat the least waste found so far. The first
    leaf of the search is the best-fit filling. With ``every``, those that waste more than
    the best are listed too, if nothing that is left over fits in as well.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    reach = [0, *itertools.accumulate(n * counts[n] for n in sizes)]
    best = room
    left = nodes
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(sizes), ())]
    while stack and left:
        left -= 1
        free, top, taken = stack.pop()
        high = bisect.bisect_right(sizes, free, 0, top)
        if high == 0:
            if free <= best:
                best = best if every else free
                found.append((free, taken))
                if free == 0 and len(found) >= keep:
                    break
            continue
        if free - reach[high] > best:
            continue
        top_size = sizes[high - 1]
        if high == 1 and free - top_size * min(counts[top_size], free // top_size) > best:
            continue
        if high > 1:
            stack.append((free, high - 1, taken))
        else:
            found.append((free, taken)) if free <= best else None
            best = best if every else min(best, free)
        if taken.count(top_size) < counts[top_size]:
            stack.append((free - top_size, high, (*taken, top_size)))
    found.sort(key=lambda x: (x[0], len(x[1]), [-v for v in x[1]]))
    out: dict[tuple[int, ...], None] = {}
    for free, filling in found:
        if every and any(filling.count(n) < counts[n] for n in itertools.takewhile(lambda n: n <= free, sizes)):
            continue
        if not any(dominated(filling, x) for x in out):
            out[filling] = None
        if len(out) == keep:
            break
    return list(out) or [()]


def bound(counts: dict[int, int], capacity: int) -> int:
    """Lower bound on sequences: by total length, and by documents over half a sequence."""
    total = sum(n * c for n, c in counts.items())
    return max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity))


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over the histogram; equal sequences are handled as one."""
    rooms: list[int] = []  # ascending
    held: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, pattern: tuple[int, ...], times: int) -> None:
        if room not in held:
            bisect.insort(rooms, room)
            held[room] = []
        held[room].append((pattern, times))

    for n in sorted(histogram, reverse=True):
        left = histogram[n]
        while left:
            k = bisect.bisect_left(rooms, n)
            room = rooms[k] if k < len(rooms) else capacity
            if k < len(rooms):
                pattern, times = held[room].pop()
                if not held[room]:
                    rooms.pop(k)
                    del held[room]
            else:
                pattern, times = (), left
            each = min(room // n, left)
            use = min(times, left // each)
            put(room - each * n, pattern + (n,) * each, use)
            if use < times and pattern:
                put(room, pattern, times - use)
            left -= each * use
    return [x for group in held.values() for x in group]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = BRANCH_STEPS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; together they use the histogram up.

    Bin completion: fill the sequence of the largest remaining length first, branch over its
    fillings, drop a branch whose sequences plus the bound of what remains are no fewer than
    the incumbent's. Best-fit decreasing is the first incumbent, so the result is never worse.
    The first dive takes the best filling of each frame, as often as it can; a frame lists its
    further fillings when the search comes back to it. ``steps`` bounds the search after the
    first dive, not the pieces that are packed.
    """
    goal = bound(histogram, capacity)
    start = {n: c for n, c in histogram.items() if c}
    best = best_fit(start, capacity)
    best_used = sum(times for _, times in best)
    trail: list[tuple[tuple[int, ...], int]] = []
    # What remains, sequences so far, choices (pattern, times), the next choice, whether all choices are listed.
    frames: list[tuple[dict[int, int], int, list[tuple[tuple[int, ...], int]], int, bool]] = []

    def options(counts: dict[int, int], every: bool) -> list[tuple[tuple[int, ...], int]]:
        largest = max(counts)
        rest = dict(counts)
        rest[largest] -= 1
        sizes = sorted(n for n, c in rest.items() if c)
        out = []
        for f in fillings(capacity - largest, sizes, rest, FILLING_NODES if every else 1, every=every):
            pattern = (largest, *f)
            out.append((pattern, min(counts[n] // pattern.count(n) for n in set(pattern))))
        return out

    def further(counts: dict[int, int], tried: list[tuple[tuple[int, ...], int]]) -> list[tuple[tuple[int, ...], int]]:
        """The choices beyond those of the first dive: other fillings, and each filling used once only."""
        every = options(counts, True)
        return [*tried, *(x for x in [*every, *((p, 1) for p, times in every if times > 1)] if x not in tried)]

    counts, used = start, 0
    spent = 0
    dived = False
    while True:
        if not counts and used < best_used:
            best, best_used = list(trail), used
        dead = not counts or used + bound(counts, capacity) >= best_used
        dived |= dead
        if best_used <= goal or (dead and spent >= steps):
            return best
        if not dead:
            frames.append((counts, used, options(counts, False), 0, False))
        while frames:
            counts, used, choices, k, listed = frames[-1]
            # A frame lists its further choices when the search comes back to it, unless the incumbent rules it out.
            if k == len(choices) and not listed and used + bound(counts, capacity) < best_used:
                choices = further(counts, choices)
                frames[-1] = (counts, used, choices, k, True)
            if k < len(choices):
                break
            frames.pop()
        if not frames:
            return best
        counts, used, choices, k, listed = frames[-1]
        frames[-1] = (counts, used, choices, k + 1, listed)
        trail = trail[: len(frames) - 1]
        pattern, times = choices[k]
        need = {n: pattern.count(n) for n in set(pattern)}
        counts = {n: c for n, c in ((n, c - need.get(n, 0) * times) for n, c in counts.items()) if c}
        trail.append((pattern, times))
        used += times
        spent += dived


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset) for each place of each pattern."""
    taken: dict[int, int] = {}
    out = []
    first = 0
    for pattern, times in patterns:
        at = 0
        for n in pattern:
            rank = taken.get(n, 0)
            out.append((n, rank, rank + times, first, at))
            taken[n] = rank + times
            at += n
        first += times
    return out


def assign(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``; collects only the histogram (``capacity`` rows at most)."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = spark.createDataFrame(slots(plan(histogram, capacity)) or [], "length long, lo long, hi long, first long, offset long")
    places = places.groupBy("length").agg(F.collect_list(F.struct("lo", "hi", "first", "offset")).alias("places"))
    rows = max(ROWS_PER_RANK, sum(histogram.values()) // RANK_PARTS)
    parts = {n: -(-c // rows) for n, c in histogram.items()}
    dealt = spark.createDataFrame(sorted(parts.items()), "length long, parts long").join(places, "length")
    dealt = cut.join(F.broadcast(dealt), "length")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("row_key", "piece"), F.col("parts")))
    by_part = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "part").orderBy("row_key", "piece")
    ranked = dealt.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(base), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base"))
    place = F.filter("places", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    ranked = ranked.withColumn("place", place)
    sequence = F.col("place.first") + F.col("rank") - F.col("place.lo")
    return ranked.select(
        *[c for c in cut.columns if c != "row_key"],
        sequence.alias("sequence_id"),
        F.col("place.offset").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and offset (and its ids, if asked for)."""
    cut = checkpoint(pieces(docs, tokenizer, capacity, keep_ids))
    return assign(docs.sparkSession, cut, capacity)
