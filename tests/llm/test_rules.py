from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from quillspark.llm import decontaminate, divergence


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


ODD = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c a b c", "x\nx\n\nx\ny", "a a a a a", "😀 € # | <x>", "one two " * 40, "p q r s " * 3 + "z"]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, n_words int")
    for r in divergence.judge(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == counted(ODD[r.doc_id]), ODD[r.doc_id]
        assert r.base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert not (r.kept and r.base_failed)
    assert divergence.judge(docs.limit(0)).count() == 0


def test_divergence_rejects_other_shapes(spark):
    import random

    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and", "to", "in", "river", "stone", "green", "walk", "table", "cloud", "seven", "winter"])
    prose = [" ".join(word() for _ in range(120)) + f" number{i}." for i in range(60)]
    junk = ["".join(f"{word()}###$$$ " for _ in range(80)), " ".join(word().upper() + "!!" for _ in range(80))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id: (r.base_failed, r.kept) for r in divergence.judge(docs).collect()}
    assert all(kept[i][1] or kept[i][0] for i in range(60))
    assert not kept[60][1]
    assert not kept[61][1]


def brute_verdicts(rows):
    """kept by plain Python, each document against all others of its language."""
    import math

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, _ in rows]
    classes, common = [], []
    for w in words:
        solid = "".join(w)
        kinds = Counter()
        for c in solid:
            n = "lower" if unicodedata.category(c) == "Ll" else "upper" if unicodedata.category(c) == "Lu" else "digit" if unicodedata.category(c) == "Nd" else ""
            kinds[n or ("symbol" if c in "#*$%&|<>" else "punct" if unicodedata.category(c)[0] == "P" else "other")] += 1
        classes.append([kinds[k] for k in divergence.CLASSES])
        plain = Counter(re.sub(r"[.,;:!?]+\Z", "", x.lower()) for x in w)
        listed = [plain[c] for c in divergence.COMMON_WORDS]
        common.append([*listed, len(w) - sum(listed)])

    def far(own, others):
        total = [sum(x) for x in zip(*others, strict=True)]
        p, q = ([x / max(1, sum(v)) for x in v] for v in (own, total))
        return math.sqrt(max(0, sum(a * math.log2(2 * a / (a + b)) for u, v in ((p, q), (q, p)) for a, b in zip(u, v, strict=True) if a > 0) / 2))

    out = []
    for i, (_, t, lang) in enumerate(rows):
        n, chars, _, _, again = counted(t)
        same = [k for k in range(len(rows)) if k != i and rows[k][2] == lang and lang is not None]
        every = [k for k in range(len(rows)) if k != i]
        enough = lambda ks: sum(len(words[k]) for k in ks) >= divergence.MIN_REFERENCE_WORDS
        by_class = same if enough(same) else every if enough(every) else []
        by_word = same if enough(same) else []
        ok = not (n < 50 or 100 * again > 50 * n)
        ok = ok and (chars < divergence.MIN_CHARS or not by_class or far(classes[i], [classes[k] for k in by_class]) <= divergence.MAX_CLASS_DISTANCE)
        ok = ok and (n < divergence.MIN_HISTOGRAM_WORDS or not by_word or far(common[i], [common[k] for k in by_word]) <= divergence.MAX_WORD_DISTANCE)
        out.append(ok)
    return out


def test_verdicts_against_all_other_documents_of_a_language(spark):
    """A rare language has its own reference, a lone one and a null one have the classes of all, and none has itself."""
    rng = random.Random(6)
    vocabulary = {"en": "the of and river stone green walk", "nl": "het een van rivier steen groen lopen", "xx": "ba bo bu"}
    made = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    prose = lambda lang, n: " ".join(rng.choice([*vocabulary[lang].split(), made(), made(), made()]) for _ in range(n))
    junk = lambda n: " ".join("#$%"[rng.randrange(3)] * rng.randrange(3, 9) + str(k) for k in range(n))
    rows = [(i, prose("en", rng.randrange(40, 200)), "en") for i in range(150)]
    rows += [(200 + i, prose("nl", 300), "nl") for i in range(5)]  # a small share of all
    rows += [(300, junk(70), "nl"), (301, prose("nl", 300), "en"), (302, junk(300), "lone"), (303, prose("en", 100), "lone two"), (304, prose("xx", 80), None)]
    rows += [(305, junk(90), None), (306, None, "en"), (307, "", None), (308, prose("en", 20_000), "en"), (200, rows[150][1], "nl")]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, n_words int, ref_lang string")
    got = sorted((r.doc_id, r.kept) for r in divergence.judge(docs).collect())
    want = brute_verdicts(rows)
    assert got == sorted((r[0], k) for r, k in zip(rows, want, strict=True))
    kept = dict(got)
    assert kept[201] and kept[303] and not kept[300] and not kept[301] and not kept[302] and not kept[305]
    alone = docs.where("doc_id = 302")
    assert [r.kept for r in divergence.judge(alone).collect()] == [True]  # nothing to hold it against
    assert [r.kept for r in divergence.judge(alone, divergence.references(divergence.measure(docs.where("doc_id < 200")))).collect()] == [False]


def test_parity_with_sql(spark, sf_dir):
    con = duckdb.connect()
    for table in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    for name in ("op1_bag_minhash", "op2_divergence_rules"):
        frame = entry.queries()[name](spark, sf_dir)
        got = sorted(tuple(r[c] for c in sorted(frame.columns)) for r in frame.collect())
        found = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in found.description]
        expected = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall())
        assert got == expected


QUESTION = "If Bob buys 12 apples at 3 dollars each and sells 12 of them to Alice later then what is left for Bob"
CASES = [
    (1, "so we ask: if Carol buys 15 apples at 4 dollars each and sells 15 of them to Dave later then what is left for Carol? ok", True),
    (2, "if Carol buys 15 apples at 4 dollars each and sells 17 of them to Dave later then what is left for Erin", False),
    (3, None, False), (4, "", False), (5, QUESTION, True), (6, "words " * 50 + QUESTION.upper().replace("BOB", "Bob") + " more", True),
    (7, "text before.\n" + QUESTION + ".\nText after", True), (8, "the quick brown fox jumps over the lazy dog again and again", False),
]


def test_contamination(spark):
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, QUESTION, "y"), (3, None, "z"), (4, "too short", "z"), (None, QUESTION, "n")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([(i, t, 9) for i, t, _ in CASES] + [(None, QUESTION, 9)], "doc_id long, text string, item_id int")
    rows = decontaminate.contaminated(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, k) for i, _, hit in CASES if hit for k in (1, 2)}
    assert {r.n_changed for r in rows if r.doc_id == 5} == {0}
    assert all(r.n_changed > 0 for r in rows if r.doc_id == 1)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs, items).collect()}
    assert kept == {2, 3, 4, 8}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_contamination_beside_lone_punctuation(spark):
    """Words of punctuation only, before or inside a copy, do not shift its values."""
    items = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    changed = CASES[0][1].removeprefix("so we ask: ")
    texts = ["Question - " + QUESTION, "* = | " + changed, QUESTION.replace(" and sells", " - and sells"), " \t- \n" + QUESTION + " -"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_changed for r in decontaminate.contaminated(docs, items).collect()} == {0: 0, 1: 4, 2: 0, 3: 0}
    assert decontaminate.keep_clean(docs, items).count() == 0


def test_contamination_of_dense_and_short_items(spark):
    """Items without sought windows are found whole, and names may change their number of words."""
    items = [
        (1, "What is 12 + 7 + 3 + 9 + 4 ?"), (2, "Seven green stones"), (3, "Then Bob and Alice met Carol and then they told Dave about Erin"),
        (4, "add 12 to 7 and take 3 then 9 off 4"),
    ]
    docs = [
        (1, "we ask: What is 12 + 7 + 3 + 9 + 4 ? now"), (2, "we saw seven green stones."), (3, "What is 12 + 7 + 3 + 9 + 5 ?"), (4, "seven stones"),
        (5, "so Then Mary Jane and Tom Lee met Ann and then they told John Paul about Eve now"), (6, "so add 15 to 8 and take 2 then 1 off 6 now"),
    ]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (5, 3), (6, 4)}


PROSE = [
    "A farmer keeps 14 hens in a yard. Each hen lays 5 eggs in a week. He sells every dozen for 3 dollars at the market in Lyon. How much does he earn?",
    "The committee shall publish its annual report within ninety days after the close of the fiscal year to which it relates",
    "Which of the following gases makes up the largest part of the air that we breathe: oxygen, nitrogen, argon or helium?",
    "Maria and Tom paint a fence together. Maria alone needs 6 hours; Tom alone needs 4. How long do they need if both work?",
    "Translate into French, please: my aunt has left the green umbrella - the old one - on the last train from Dover.",
]


def test_verbatim_copies_in_any_case(spark):
    """Whole items in capitals, title case, lower case, mixed case and other punctuation, and parts of ten words, are found."""
    mixed = lambda t: "".join(c.upper() if i % 3 else c.lower() for i, c in enumerate(t))
    ten = lambda t: " ".join(re.findall(r"[^\W_]+", t)[3:13])
    spoilt = lambda t: t.replace(" ", " - ").replace(".", " ...")
    ways = [str, str.upper, str.title, str.lower, mixed, spoilt, ten, lambda t: ten(t).upper()]
    items = [*enumerate([QUESTION, *PROSE]), (90, "Seven green stones"), (91, "What holds when nothing else does?")]
    docs, expected = [], set()
    for w, way in enumerate(ways):
        for k, text in items:
            if k >= 90 and w >= 6:
                continue
            docs.append((100 * w + k, f"some words before it and\nmore. {way(text)}\tand what comes then"))
            expected.add((100 * w + k, k))
    nine = lambda t: " ".join(re.findall(r"[^\W_]+", t)[3:12])
    docs += [(1000 + k, f"before {nine(t).lower()} after it") for k, t in enumerate(PROSE)]
    docs += [(2000, "seven stones"), (2001, "seven green"), (2002, "what holds when nothing does else"), (2003, "Stones Green Seven " * 20)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == expected


def test_thin_items_of_many_sizes_cost_no_more_places(spark):
    """Documents are cut only where a thin item's longest word stands."""
    items = [(k, " ".join(f"tiny{k}" if i == k // 2 else f"w{i}" for i in range(k + 1))) for k in range(8)]
    filler = " ".join(f"filler{i % 50}" for i in range(3000))
    docs = [(k, f"{filler} {items[k][1]} {filler}") for k in range(8)] + [(50, filler + " tiny3 " + filler), (51, filler)]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(8)}


NAMES = "Alice Bob Carla Dan Erin Frank Gita Hugo Iris Jack Lena Mark".split()
THINGS = "apples pears coins books stamps marbles cards shells".split()
QUESTIONS = [
    "{0} has {a} {x} and {b} {y}. {1} takes {c} of them. How many are left?", "{0} walks {a} km to the old mill and back. How far does {1} walk in {b} days at that pace?",
    "A train leaves the station with {a} people. At the next stop {b} get off and {c} get on. How many people does {0} count now?",
    "{0} buys {a} {x} for {b} dollars each, gives {c} to {1} and sells what is left for twice the price. What does {0} earn?",
    "In a box there are {a} red and {b} blue {x}. {0} draws {c} without looking. What is the chance that all are red?",
    "If {0} reads {a} pages on each day of a week and {1} reads {b} more than that, when will both have read {c} pages?",
]


def test_recall_of_reparameterised_questions(spark):
    """Questions with new names and numbers are found; the same sentences with values that clash, and others, are not."""
    rng = random.Random(3)

    def made(text, things):
        names = rng.sample(NAMES, 2)
        a, b, c = rng.sample(range(2, 99), 3)
        return text.format(*names, a=a, b=b, c=c, x=things[0], y=things[1])

    lead = lambda: " ".join(rng.choice("the of once some people like to think about old things in town".split()) for _ in range(15))
    items, docs, true = [], [], set()
    for k, q in enumerate(QUESTIONS * 5):
        things = rng.sample(THINGS, 2)
        items.append((k, made(q, things)))
        docs.append((k, f"{lead()}. {made(q, things)} {lead()}"))
        true.add((k, k))
    clean = [(1000 + k, f"{lead()}. {rng.choice(NAMES)} has {k} dogs. {lead()}? {lead()}") for k in range(60)]
    items, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs + clean, "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert len(found & true) >= 0.9 * len(true)
    # An item with the same words apart from its values is a match as well.
    assert all(d < 1000 and d % len(QUESTIONS) == i % len(QUESTIONS) for d, i in found)


def test_contamination_of_rows_without_own_ids(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "Alice has 3 apples and 4 pears. Bob takes 2 of them. How many are left?")], "item_id long, text string")
    changed = "Carla has 5 apples and 9 pears. Dan takes 3 of them. How many are left?"
    rows = [(1, "a clean text", "u"), (1, QUESTION, "v"), (None, "so: " + changed, "w"), (None, "another clean one", "x"), (2, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, canon string")
    assert sorted(r.canon for r in decontaminate.keep_clean(docs, items).collect()) == ["u", "x", "y"]
    # Two values of a long item may have become one.
    same = QUESTION.replace("12", "5").replace(" 3 ", " 5 ")
    docs = spark.createDataFrame([(1, same)], "doc_id long, text string")
    assert decontaminate.contaminated(docs, items).count() == 1


def test_contamination_against_plain_search(spark, sf_dir):
    """Every document that holds 13 words of an item in a row is found, and no other."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    known = set()
    for r in items.collect():
        w = words(r.text)
        known |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    expected = set()
    for r in docs.collect():
        w = words(r.text)
        if any(tuple(w[k : k + 13]) in known for k in range(len(w) - 12)):
            expected.add(r.doc_id)
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).collect()} == expected
