"""Operator 3: benchmark decontamination over canonical templates.

Texts become templates: names (capitalised words, at the start of a sentence too), numbers and
units give way to typed placeholders, neighbouring placeholders of one type to one, so that a
name may have become two; case and punctuation go. Windows of template words are hashed and
joined with those of the benchmark; matches along one diagonal are one alignment of a document
with an item. Each value of an item must stand for one value of the document throughout (an
item's "12" may have become "15", but then everywhere), and short alignments also the other
way round. This catches re-parameterised questions and leaves chance template matches alone.

Documents are searched twice. Seeds are short windows: every one of an item, but only each
fourth of a document, so that any full window that they share has a seed within it. Only
documents with a seed are then cut into all their windows.

Names are seen by their capitals, so a copy in capitals, in title case or in lower case has
other templates. Beside the templates, windows of exact words in lower case are joined as well,
with seeds of their own; each alignment of ``MIN_WINDOWS`` of them is a verbatim copy.

Items with fewer windows of either kind than make an alignment (short ones, and those dense
with placeholders) are also searched whole: by their exact words or, if enough words are no
placeholders, by their template. For that a document is cut only where an item's longest word
stands, at the item's own distance from it.

Only DataFrame functions run here. The benchmark side is broadcast only if its windows have
been counted and are few; otherwise the join shuffles.

Defined results: null texts and those without words match nothing, on either side; texts of any
length are searched whole; rows with a null id are left out of ``contaminated`` and judged like
any other by ``keep_clean``; repeated rows and benchmark items with equal text give the same
matches; empty tables give no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, checkpoint, id_and_text, settled

WINDOW = 8
#: Words of a window that must not be placeholders.
MIN_LITERAL = 5
#: Words of a seed and distance of a document's seeds; together one less than a window at most.
SEED, SEED_STEP = 5, 4
#: Matched windows along one diagonal that make an alignment (an item's all, if it has fewer).
MIN_WINDOWS = 3
#: Windows from which two values of an item may have become one value of the document.
LONG = 6
#: Windows of the benchmark up to which it is broadcast (about 20 MB).
BROADCAST_WINDOWS = 200_000

#: Unit words after a number.
UNITS = (
    "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|miles?|feet|foot|ft|inch(?:es)?|l|ml|lit(?:er|re)s?|"
    "s|sec(?:ond)?s?|min(?:ute)?s?|h|hours?|days?|weeks?|months?|years?|dollars?|euros?|cents?|percent|degrees?"
)
NAME, NUMBER, UNIT = "§a", "§0", "§u"


#: White space besides the blank.
RARE_BLANKS = "\t\x0b\x0c\r"


def spaced(text: Column) -> Column:
    """The text with a blank for each character of white space, so that places stay."""
    out = text
    for c in RARE_BLANKS:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.replace(F.when(text.rlike(f"[{RARE_BLANKS}]"), out).otherwise(text), F.lit("\n"), F.lit(" "))


def template(text: Column) -> Column:
    """The (spaced) text with typed placeholders, lower case, one canonical word for each of its words.

    Blanks stay as they are; a word of punctuation only becomes an empty one.
    """
    out = F.replace(text, F.lit("§"), F.lit(""))
    # The capital comes first, so that the look behind it is rare.
    out = F.regexp_replace(out, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})[\p{L}\p{M}'’-]*", NAME)
    number = r"(?<![\p{L}\p{N}§])[$€£+-]?\p{Nd}+(?:[.,:/]\p{Nd}+)*"
    numbers = F.regexp_replace(out, number + rf"(?:%|{UNITS})?(?![\p{{L}}\p{{N}}])", NUMBER)
    units = F.regexp_replace(numbers, rf"(?<={NUMBER} )(?i:{UNITS})(?![\p{{L}}\p{{N}}])", UNIT)
    out = F.when(text.rlike(r"\p{Nd}"), units).otherwise(out)
    return F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}§ ]+", "")


def exact(text: Column) -> Column:
    """The (spaced) text in lower case without punctuation."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} ]+", "")


def _window(words: str, i: Column, size: int | Column) -> Column:
    return F.array_join(F.slice(words, i + 1, size if isinstance(size, Column) else F.lit(size)), " ")


def _held(joined: Column) -> Column:
    """Placeholders of a window."""
    return F.length(joined) - F.length(F.replace(joined, F.lit("§"), F.lit("")))


def _goes_on(canon: str, i: Column) -> Column:
    """Whether a word is a placeholder of the same type as the one before it."""
    here = F.get(canon, i)
    return here.isin(NAME, NUMBER, UNIT) & F.coalesce(here == F.get(canon, i - 1), F.lit(False))


def plain_words(text: Column) -> Column:
    """Lower-case words of letters and digits; an empty one may stand at either end."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)


def plain_windows(docs: DataFrame, key: str, size: int, step: int = 1) -> DataFrame:
    """key, pos and h of windows of exact words, from each ``step``-th word."""
    words = docs.select(key, plain_words(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(step))
    listed = F.when(F.size("words") >= size, F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice("words", i + 1, F.lit(size))).alias("h"))))
    return words.select(key, F.explode(listed).alias("w")).select(key, "w.*")


def verbatim(texts: DataFrame, items: DataFrame, size: int, min_windows: int) -> DataFrame:
    """doc_id, item_id, n_windows and item_windows of copies in exact words, whatever their case and punctuation.

    The shortest copy has ``size + min_windows - 1`` words, of which each seed of a document that
    stands at a multiple of what this exceeds a seed by lies within.
    """
    run = size + min_windows - 1
    items = items.where(F.size(F.array_remove(plain_words(F.col("text")), "")) >= run)
    # The empty words at the ends of an item are none of a document's.
    bare = items.withColumn("text", F.regexp_replace("text", r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", ""))
    sought = checkpoint(plain_windows(bare, "item_id", size).withColumnRenamed("pos", "item_pos"))
    few = sought.count() <= BROADCAST_WINDOWS
    total = sought.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"))
    short = plain_windows(bare, "item_id", SEED).select("h").distinct()
    seeded = plain_windows(texts, "doc_id", SEED, run - SEED + 1).join(F.broadcast(short) if few else short, "h", "left_semi")
    seeded = settled(seeded.select("doc_id").distinct())
    listed = seeded.count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(seeded) if listed else seeded, "doc_id", "left_semi")
    hit = plain_windows(held, "doc_id", size).join(F.broadcast(sought) if few else sought, "h")
    found = hit.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.count_distinct("item_pos").alias("n_windows"))
    found = found.where(F.col("n_windows") >= min_windows).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"))
    return found.join(F.broadcast(total) if few else total, "item_id").select("doc_id", "item_id", "n_windows", "item_windows")


def seeds(docs: DataFrame, key: str, size: int, seed: int, step: int, max_held: int | None = None) -> DataFrame:
    """key and h of short windows, from each ``step``-th word, of texts of at least ``size`` words.

    With ``max_held`` only those with no more placeholders; one side of a join is enough.
    """
    canon = docs.select(key, template(spaced(F.col("text"))).alias("text"))
    canon = canon.select(key, F.col("text").rlike("(§[a0u]) +\\1").alias("runs"), F.array_remove(F.split("text", " ", -1), "").alias("canon"))
    one = F.filter("canon", lambda _, i: ~_goes_on("canon", i))
    words = canon.select(key, F.when(F.col("runs"), one).otherwise(F.col("canon")).alias("canon"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("canon") - seed, F.lit(0)), F.lit(step))

    def hashed(i: Column) -> Column:
        joined = _window("canon", i, seed)
        return F.xxhash64(joined) if max_held is None else F.when(_held(joined) <= max_held, F.xxhash64(joined))

    # No filter on the words: it would be pushed below, where they are made again for it.
    listed = F.when(F.size("canon") >= size, F.transform(starts, hashed))
    found = words.select(key, F.explode(listed).alias("h"))
    return found if max_held is None else found.where("h is not null")


def _paired(docs: DataFrame, key: str, form: Callable[[Column], Column]) -> DataFrame:
    """key, canon and raw: the words of a canonical form and of the text, without those that it empties."""
    step = docs.select(key, spaced(F.col("text")).alias("text"))
    pairs = step.select(key, F.split(form(F.col("text")), " ", -1).alias("each"), F.split("text", " ", -1).alias("other"))
    # Arrays of their own: a field of an array of structs would be taken out again for each word.
    full = F.filter("other", lambda _, i: F.get("each", i) != "")
    return pairs.select(key, F.array_remove("each", "").alias("canon"), full.alias("raw"))


def templated(docs: DataFrame, key: str) -> DataFrame:
    """key, canon and raw: template words and what stands for them in the text."""
    # Other names than those of the result, which a lambda would read instead.
    words = _paired(docs, key, template).withColumnsRenamed({"canon": "each", "raw": "text"})
    words = words.withColumn("first", F.filter(F.transform("each", lambda _, i: i), lambda i: ~_goes_on("each", i)))
    until = lambda k: F.coalesce(F.get("first", k + 1), F.size("each"))
    return words.select(
        key,
        F.transform("first", lambda i: F.get("each", i)).alias("canon"),
        F.transform("first", lambda i, k: F.array_join(F.slice("text", i + 1, until(k) - i), " ")).alias("raw"),
    )


def spans(words: DataFrame, key: str, sizes: Column) -> DataFrame:
    """key, size, pos, h, held (number of placeholders) and slots (the values behind them), for each window of each size."""
    words = words.select(key, "canon", "raw", F.explode(F.filter(sizes, lambda n: n <= F.size("canon"))).alias("size"))

    def window(i: Column) -> Column:
        joined = _window("canon", i, F.col("size"))
        held = _held(joined)
        slots = F.when(
            held > 0,
            F.filter(
                F.zip_with(
                    F.slice("canon", i + 1, F.col("size")),
                    F.slice("raw", i + 1, F.col("size")),
                    lambda c, r: F.when(c.startswith("§"), F.regexp_replace(F.lower(r), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")),
                ),
                lambda v: v.isNotNull(),
            ),
        )
        return F.struct(i.alias("pos"), F.xxhash64(joined).alias("h"), held.alias("held"), slots.alias("slots"))

    starts = F.sequence(F.lit(0), F.greatest(F.size("canon") - F.col("size"), F.lit(0)))
    listed = F.when(F.size("canon") >= F.col("size"), F.transform(starts, window))
    return words.select(key, "size", F.explode(listed).alias("w")).select(key, "size", "w.*")


def windows(docs: DataFrame, key: str, size: int = WINDOW) -> DataFrame:
    """The template windows of one size."""
    return spans(templated(docs, key), key, F.array(F.lit(size))).drop("size")


def _forms(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, exact, canon and raw: a row for the exact words of a text, and one for its template."""
    packed = docs.select(F.struct(*keys).alias("keys"), "text")
    both = _paired(packed, "keys", exact).withColumn("exact", F.lit(True)).unionByName(templated(packed, "keys").withColumn("exact", F.lit(False)))
    return both.select("keys.*", "exact", "canon", "raw")


def _slots(start: Column, size: Column) -> Column:
    """The values behind the placeholders of a window."""
    values = F.zip_with(
        F.slice("canon", start + 1, size),
        F.slice("raw", start + 1, size),
        lambda c, r: F.when(c.startswith("§"), F.regexp_replace(F.lower(r), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")),
    )
    return F.filter(values, lambda v: v.isNotNull())


def whole(texts: DataFrame, thin: DataFrame, longest_exact: int) -> DataFrame:
    """doc_id, item_id and pairs, for each place where a document holds all of a thin item.

    Items of more than ``longest_exact`` words are not sought by their exact words, which
    ``verbatim`` does.
    """
    literal = F.size(F.filter("canon", lambda c: ~c.startswith("§")))
    parts = _forms(thin, ["item_id"]).where(F.when(F.col("exact"), F.size("canon") <= longest_exact).otherwise(literal >= MIN_LITERAL))
    numbered = F.transform("canon", lambda c, i: F.struct((~c.startswith("§")).alias("kept"), F.length(c).alias("n"), c.alias("word"), (-i).alias("back")))
    parts = parts.withColumn("anchor", F.array_max(numbered)).withColumn("size", F.size("canon"))
    sought = checkpoint(
        parts.select(
            "exact", "item_id", F.col("anchor.word").alias("word"), (-F.col("anchor.back")).alias("offset"), "size",
            F.xxhash64(F.array_join("canon", " ")).alias("h"), _slots(F.lit(0), F.col("size")).alias("item_slots"),
        ).distinct()
    )
    few = sought.count() <= BROADCAST_WINDOWS
    if sought.isEmpty():
        return texts.sparkSession.createDataFrame([], f"doc_id long, item_id long, pairs {PAIRED_TYPE}")
    # A template's anchor is one of the text's exact words too, since it is no placeholder.
    anchors = sought.select("word").distinct()
    own = texts.select("doc_id", F.explode(F.array_distinct(F.split(exact(spaced(F.col("text"))), " ", -1))).alias("word"))
    ids = settled(own.join(F.broadcast(anchors) if few else anchors, "word", "left_semi").select("doc_id").distinct())
    listed = ids.count() <= BROADCAST_IDS
    held = texts.join(F.broadcast(ids) if listed else ids, "doc_id", "left_semi")
    forms = checkpoint(_forms(held.withColumn("text_hash", F.xxhash64("text")).distinct(), ["doc_id", "text_hash"]))
    places = forms.select("doc_id", "text_hash", "exact", F.posexplode("canon").alias("pos", "word"))
    places = places.join(F.broadcast(sought) if few else sought, ["exact", "word"]).withColumn("start", F.col("pos") - F.col("offset"))
    listed = F.collect_list(F.struct("start", "size", "h", "item_id", "item_slots")).alias("places")
    near = places.where("start >= 0").groupBy("doc_id", "text_hash", "exact").agg(listed)
    near = forms.join(near, ["doc_id", "text_hash", "exact"])
    equal = F.filter("places", lambda p: F.xxhash64(F.array_join(F.slice("canon", p["start"] + 1, p["size"]), " ")) == p["h"])
    hit = near.select("doc_id", "canon", "raw", F.explode(equal).alias("p"))
    hit = hit.select("doc_id", F.col("p.item_id").alias("item_id"), F.col("p.item_slots").alias("item_slots"), _slots(F.col("p.start"), F.col("p.size")).alias("slots"))
    return hit.select("doc_id", "item_id", _pairs().alias("pairs"))


#: Values of an item and a document in the same places.
PAIRED_TYPE = "array<struct<i:string,d:string>>"


def _pairs() -> Column:
    zipped = F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("i"), b.alias("d")))
    return F.array_distinct(F.coalesce(zipped, F.array().cast(PAIRED_TYPE)))


def _function() -> Column:
    """Whether each value of the item stands for one value of the document."""
    return F.size("pairs") == F.size(F.array_distinct("pairs.i"))


def _one_to_one() -> Column:
    return _function() & (F.size("pairs") == F.size(F.array_distinct("pairs.d")))


def _n_changed() -> Column:
    return F.size(F.filter("pairs", lambda p: p["i"] != p["d"])).cast("long")


def alignments(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, item_id, diagonal, n_windows, item_windows, n_slots, n_changed, consistent."""
    texts = id_and_text(docs).where("doc_id is not null")
    items = id_and_text(benchmark, "item_id").where("doc_id is not null").withColumnRenamed("doc_id", "item_id").distinct()
    every = windows(items, "item_id", size)
    sought = every.where(F.col("held") <= size - MIN_LITERAL).drop("held")
    sought = checkpoint(sought.withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}))
    total = sought.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_windows"))
    few = sought.count() <= BROADCAST_WINDOWS
    short = seeds(items, "item_id", size, SEED, 1, size - MIN_LITERAL).select("h").distinct()
    seeded = seeds(texts, "doc_id", size, SEED, SEED_STEP).join(F.broadcast(short) if few else short, "h", "left_semi")
    seeded = settled(seeded.select("doc_id").distinct())
    listed = seeded.count() <= BROADCAST_IDS
    hashed = windows(texts.join(F.broadcast(seeded) if listed else seeded, "doc_id", "left_semi"), "doc_id", size).drop("held")
    hit = hashed.join(F.broadcast(sought) if few else sought, "h")
    found = (
        hit.withColumn("diagonal", F.col("pos") - F.col("item_pos"))
        .groupBy("doc_id", "item_id", "diagonal")
        .agg(F.count_distinct("item_pos").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set(_pairs()))).alias("pairs"))
        .join(F.broadcast(total) if few else total, "item_id")
    )
    return found.select(
        "doc_id",
        "item_id",
        "diagonal",
        "n_windows",
        "item_windows",
        F.size("pairs").cast("long").alias("n_slots"),
        _n_changed().alias("n_changed"),
        (_one_to_one() | (_function() & (F.col("n_windows") >= LONG))).alias("consistent"),
    )


def thin_items(benchmark: DataFrame, size: int, min_windows: int) -> DataFrame:
    """item_id and text of the items that have fewer sought windows of either kind than make an alignment."""
    items = id_and_text(benchmark, "item_id").where("doc_id is not null").withColumnRenamed("doc_id", "item_id").distinct()
    every = windows(items, "item_id", size).where(F.col("held") <= size - MIN_LITERAL)
    enough = every.groupBy("item_id").count().where(F.col("count") >= min_windows)
    short = F.size(F.array_remove(F.split(exact(spaced(F.col("text"))), " ", -1), "")) < size + min_windows
    few = items.join(enough, "item_id", "left_anti").union(items.where(short)).distinct()
    return checkpoint(few.where(exact(F.col("text")).rlike(r"[\p{L}\p{N}]")))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, n_windows, item_windows, n_changed.

    ``n_changed`` counts the placeholders whose value differs; 0 is a verbatim copy.
    """
    aligned = alignments(docs, benchmark, size)
    taken = aligned.where(F.col("consistent") & (F.col("n_windows") >= F.least(F.lit(min_windows), F.col("item_windows"))))
    taken = taken.select("doc_id", "item_id", "n_windows", "item_windows", "n_changed")
    texts = id_and_text(docs).where("doc_id is not null")
    items = id_and_text(benchmark, "item_id").where("doc_id is not null").withColumnRenamed("doc_id", "item_id").distinct()
    none = F.lit(0).cast("long")
    taken = taken.unionByName(verbatim(texts, items, size, min_windows).withColumn("n_changed", none))
    thin = thin_items(benchmark, size, min_windows)
    if not thin.isEmpty():
        one = F.lit(1).cast("long")
        entire = whole(texts, thin, size + min_windows).where(_one_to_one())
        taken = taken.unionByName(
            entire.select("doc_id", "item_id", one.alias("n_windows"), one.alias("item_windows"), _n_changed().alias("n_changed"))
        )
    return taken.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.min_by("n_changed", F.struct(-F.col("n_windows"), F.col("n_changed"))).alias("n_changed"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all their columns as they are.

    Rows are told apart by a hash of id and text, so that rows without an id are judged too,
    and of an id that stands for several texts only those with an item go.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark)
    gone = checkpoint(found.select(F.col("doc_id").alias("__gone")).distinct())
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col("__gone"), "left_anti")
