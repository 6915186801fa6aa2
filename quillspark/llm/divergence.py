"""Operator 2: quality rules by distribution divergence.

Each document's character-class histogram and common-word histogram are compared with those
of its language by Jensen-Shannon distance. A reference is the sum over all other documents of
that language, so that none is held against itself; it counts from ``MIN_REFERENCE_WORDS``
words on. A document without such a reference is held against the character classes of the
whole corpus, and skips the words, which differ between languages. Too short documents skip a
test (the minimum-length guards). Base rules on length and repeated words come first.

Only DataFrame functions run here; the one shuffle sums a few counters per language. The
counts of each document go to a table in the shared folder, from which the references and
then the distances are made.

Defined results: null text counts as empty, which fails the base rules; texts of any length
are measured whole; a null language has no reference of its own, and a corpus of too few words
none at all, where only the base rules decide; rows, ties and repeated ids pass through one to one; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, scratch_path

#: Symbol characters, and the character classes.
SYMBOLS = r"[#*$%&|<>]"
CLASSES = ["lower", "upper", "digit", "symbol", "punct", "other"]
#: Common short words of English, German, French and Spanish.
COMMON_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with",
    "der", "die", "und", "das", "den", "von", "mit", "nicht", "ein", "zu",
    "le", "la", "de", "les", "et", "des", "que", "un", "qui", "dans",
    "el", "los", "del", "se", "las", "por", "con", "una", "para", "al",
]

#: Words of all others that a document's reference needs.
MIN_REFERENCE_WORDS = 1000
#: Languages up to which the references are broadcast (a thousand bytes each).
BROADCAST_LANGS = 10_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Guards: characters without white space, and words, that a test needs.
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
#: Jensen-Shannon distances (base 2, 0 to 1) up to which a document counts as like its language.
MAX_CLASS_DISTANCE = 0.31
MAX_WORD_DISTANCE = 0.29


#: Characters of the base rules' white space besides blank and newline.
RARE_BLANKS = "\t\x0b\x0c\r"
#: A letter for each common word, in the same order.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[: len(COMMON_WORDS)]
#: A window's place takes the low bits of its packed hash; longer texts compare all their windows.
PLACE_BITS = 24


def _without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def spaced(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text (null: empty), even and n_words: the words with one blank between them, and their number."""
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    even = F.col("text")
    for c in RARE_BLANKS:
        even = F.replace(even, F.lit(c), F.lit(" "))
    even = F.replace(F.when(F.col("text").rlike(f"[{RARE_BLANKS}]"), even).otherwise(F.col("text")), F.lit("\n"), F.lit(" "))
    step = base.withColumn("even", F.trim(F.regexp_replace(even, "  +", " ")))
    step = step.withColumn("solid", F.replace("even", F.lit(" "), F.lit("")))
    n = F.when(F.col("even") == "", 0).otherwise(F.length("even") - F.length("solid") + 1)
    return step.withColumn("n_words", n.cast("long"))


def histograms(base: DataFrame) -> DataFrame:
    """Adds word_chars, n_symbols, classes (that histogram, as counts) and frequent (a letter for each common word)."""
    step = base
    # Each class is what its removal takes away from what the classes before it left.
    for name, pattern in zip(CLASSES[:-1], [r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", SYMBOLS + "+", r"\p{P}+"], strict=True):
        before = "solid" if name == "lower" else "left"
        step = step.withColumn("next", _without(F.col(before), pattern))
        step = step.withColumn(f"n_{name}", F.length(before) - F.length("next"))
        step = step.drop("left").withColumnRenamed("next", "left")
    # Words for the histogram: lower case, without the stops that end them; each common one as a letter of its own.
    plain = F.split(F.regexp_replace(F.lower("even"), r"[.,;:!?]+(?= |\z)", ""), " ", -1)
    listed = F.array(*map(F.lit, COMMON_WORDS))
    letter = lambda w: F.substring(F.lit(LETTERS), F.array_position(listed, w).cast("int"), F.lit(1))
    step = step.withColumn("frequent", F.array_join(F.transform(F.filter(plain, lambda w: w.isin(COMMON_WORDS)), letter), ""))
    return step.select(
        *[c for c in base.columns if c != "solid"],
        F.length("solid").cast("long").alias("word_chars"),
        F.col("n_symbol").cast("long").alias("n_symbols"),
        F.array(*[F.col(f"n_{c}") for c in CLASSES[:-1]], F.length("left")).alias("classes"),
        "frequent",
    )


def with_common(measured: DataFrame) -> DataFrame:
    """Adds the common-word histogram, as counts; its last bin holds all other words."""
    all_ = F.length("frequent")
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: (all_ - F.length(F.replace("frequent", c, F.lit("")))).cast("long"))
    return measured.withColumn("common", F.array_append(counts, F.col("n_words") - all_))


def repeats(base: DataFrame) -> DataFrame:
    """Adds n_dup_lines and n_repeat_words.

    Windows of three words are hashed. Where no hash comes twice no window does, and nothing
    else is done. In the rest the sorted hashes, with the windows' places in their low bits,
    show the windows that may be repeated; only these are compared as texts.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = base.withColumn("lines", lines).withColumn("words", F.split("even", " ", -1))
    n = F.size("words")
    last = F.greatest(n - 3, F.lit(0))
    word = lambda i: F.get("words", i)
    part = lambda k: F.slice("words", k, F.greatest(n - 2, F.lit(0)))
    two = F.zip_with(part(1), part(2), lambda a, b: F.xxhash64(a, b))
    step = step.withColumn("hashes", F.when(n >= 3, F.zip_with(two, part(3), lambda h, c: F.xxhash64(h, c))))
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    packed = F.transform("hashes", lambda h, i: h.bitwiseOR(place).bitwiseXOR(place).bitwiseOR(i.cast("long")))
    some = F.size(F.array_distinct("hashes")) < F.size("hashes")
    step = step.withColumn("packed", F.when(some & (n < 1 << PLACE_BITS), F.sort_array(packed)))
    high = lambda k: F.shiftright(F.get("packed", k), PLACE_BITS)
    alike = F.filter("packed", lambda x, k: (high(k + 1) == F.shiftright(x, PLACE_BITS)) | (high(k - 1) == F.shiftright(x, PLACE_BITS)))
    candidates = F.transform(alike, lambda x: x.bitwiseAND(place).cast("int"))
    candidates = F.when(some, F.when(n < 1 << PLACE_BITS, candidates).otherwise(F.sequence(F.lit(0), last)))
    window = F.transform(candidates, lambda i: F.struct(F.concat_ws(" ", word(i), word(i + 1), word(i + 2)).alias("w"), i.alias("i")))
    step = step.withColumn("windows", F.sort_array(window))
    other = lambda k: F.get("windows", k)["w"]
    same = F.filter("windows", lambda x, k: (x["w"] == other(k + 1)) | (x["w"] == other(k - 1)))
    step = step.withColumn("at", F.array_sort(F.transform(same, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return step.select(
        *base.columns,
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each document, all from arrays within its own row."""
    return histograms(repeats(spaced(docs))).drop("text", "even")


def references(measured: DataFrame) -> DataFrame:
    """One row for each language, a null one too: its words and the two histograms, summed.

    Sums run per counter with partial aggregation, so a hot language or source is no burden.
    """
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(COMMON_WORDS) + 1)]
    total = with_common(measured).groupBy("lang").agg(F.sum("n_words").alias("ref_words"), *sums)
    classes = F.array(*[F.col(f"c{i}") for i in range(len(CLASSES))])
    common = F.array(*[F.col(f"w{i}") for i in range(len(COMMON_WORDS) + 1)])
    return total.select(F.col("lang").alias("ref_lang"), "ref_words", classes.alias("ref_classes"), common.alias("ref_common"))


def _shares(counts: Column) -> Column:
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1).cast("long"))
    return F.transform(counts, lambda x: x / total)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two arrays of shares."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(p, q, lambda a, b: (term(a, b) + term(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge(
    docs: DataFrame,
    refs: DataFrame | None = None,
    max_class: float = MAX_CLASS_DISTANCE,
    max_word: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_HISTOGRAM_WORDS,
) -> DataFrame:
    """The base counts, ``base_failed``, the distances to the references, and ``kept``.

    ``refs`` (as ``references`` makes them) may come from another corpus; by default they are
    those of all of ``docs``, from which each document's own counts are taken away.
    """
    measured = measure(docs)
    own = refs is None
    if own:
        # Some hundred bytes a document, without its text, so that texts are read once.
        path = scratch_path(docs.sparkSession, "measured")
        measured.write.parquet(path)
        measured = docs.sparkSession.read.parquet(path)
        refs = references(measured)
    refs = checkpoint(refs)
    # Seven numbers: the classes and words of the corpus.
    pool = refs.agg(*[F.sum(F.get("ref_classes", F.lit(i))) for i in range(len(CLASSES))], F.sum("ref_words")).first()
    *pooled, pool_words = [n or 0 for n in pool]
    known = refs.where("ref_lang IS NOT NULL")
    few = known.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS
    both = with_common(measured).join(F.broadcast(known) if few else known, F.col("lang") == F.col("ref_lang"), "left")
    others = lambda total, mine: F.zip_with(total, mine, lambda a, b: a - b) if own else total
    left = lambda words: words - F.col("n_words") if own else words
    enough = left(F.col("ref_words")) >= MIN_REFERENCE_WORDS
    whole = F.when(left(F.lit(pool_words)) >= MIN_REFERENCE_WORDS, others(F.array(*[F.lit(n).cast("long") for n in pooled]), F.col("classes")))
    both = both.withColumns(
        {
            "p": _shares(F.col("classes")),
            "q": _shares(F.col("common")),
            "ref_p": _shares(F.when(enough, others(F.col("ref_classes"), F.col("classes"))).otherwise(whole)),
            "ref_q": _shares(F.when(enough, others(F.col("ref_common"), F.col("common")))),
        }
    )
    both = both.withColumn("class_distance", F.when(F.col("word_chars") >= min_chars, distance(F.col("p"), F.col("ref_p"))))
    both = both.withColumn("word_distance", F.when(F.col("n_words") >= min_words, distance(F.col("q"), F.col("ref_q"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word)
    return both.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & near).alias("kept"),
        "class_distance",
        "word_distance",
    )
