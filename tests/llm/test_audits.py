"""Operators 11 to 13 against brute-force versions on small, odd tables."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import filter_audit, mixing, source_audit
from quillspark.llm.running import running

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, mask string, bucket int, n string, p long, before string"


def docs_of(spark, rows, parts=3):
    """(doc_id, text, lang, source) rows with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], DOCS).repartition(parts)


# ---- filter interaction ----


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for i, text, _, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and i > least[text],
        }
        docs.append((source or "", {f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = [bool(d[1] & set(order[: step - 1])) for d in mine]
                removed = [d for d, g in zip(mine, gone, strict=True) if not g and f in d[1]]
                out[part, "".join(order), step] = [
                    sum(not g and f not in d[1] for d, g in zip(mine, gone, strict=True)),
                    len(removed),
                    sum(g and f in d[1] for d, g in zip(mine, gone, strict=True)),
                    sum(d[1] == {f} for d in mine),
                    sum(d[2] for d in removed),
                    sum(d[3] for d in removed),
                ]
    shapley = Counter()
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] += v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def odd_texts(rng):
    long = " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(70))
    return [None, "", " \n\t", "one two", "SHOUT " * 60, "a b " * 40, long, long + " #", "same copy", "word\x0bapart é ß 𐐨", "x" * 100_000]


def audit_rows(seed, n=150):
    rng = random.Random(seed)
    texts = odd_texts(rng)
    rows = [(rng.choice([None, *range(100)]), rng.choice(texts), None, rng.choice(["s", "t", None, ""])) for _ in range(n)]
    rows += [(7, "same copy", None, "s")] * 3  # equal rows
    rows += [(200 - k, "same copy", None, "hot") for k in range(100)]  # ids that fall as the files go on
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    return rows, labels


def as_files(spark, rows, folder, files):
    size = -(-len(rows) // files)
    for k in range(files):
        docs_of(spark, rows[k * size : (k + 1) * size], 1).write.mode("append").parquet(folder)


def as_dict(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_retractions_end_at_what_brute_force_counts(spark, tmp_path):
    rows, labels = audit_rows(1)
    as_files(spark, rows, str(tmp_path / "d"), 5)
    got = as_dict(filter_audit.audit(spark, str(tmp_path / "d"), spark.createDataFrame(labels, LABELS)))
    assert got == brute_audit(rows, labels)


def test_audit_goes_on_where_it_stopped(spark, tmp_path):
    rows, labels = audit_rows(2)
    folder, progress, labels_df = str(tmp_path / "d"), str(tmp_path / "progress"), spark.createDataFrame(labels, LABELS)
    as_files(spark, rows[:200], folder, 2)
    first = filter_audit.counters(spark, folder, labels_df, batches=2, progress=progress)
    assert as_dict(filter_audit.orders(first)) == brute_audit(rows[:200], labels)
    as_files(spark, rows[200:], folder, 2)
    again = filter_audit.counters(spark, folder, labels_df, batches=2, progress=progress)
    assert as_dict(filter_audit.orders(again)) == brute_audit(rows, labels)


def test_audit_of_one_file_and_of_nothing(spark, tmp_path):
    rows, labels = audit_rows(3, 40)
    docs_of(spark, rows, 1).write.parquet(str(tmp_path / "d"))
    alone = next((tmp_path / "d").glob("part-*")).rename(tmp_path / "alone.parquet")
    assert as_dict(filter_audit.audit(spark, str(alone), spark.createDataFrame(labels, LABELS))) == brute_audit(rows, labels)
    docs_of(spark, rows, 1).limit(0).write.parquet(str(tmp_path / "e"))
    assert filter_audit.audit(spark, str(tmp_path / "e"), spark.createDataFrame([], LABELS)).count() == 0


def test_a_smaller_id_takes_back_earlier_rows(spark):
    kind = "key binary, doc_id long, has_id boolean, part string, mask int, flags int"
    first = spark.createDataFrame([(b"k", 9, True, "s", 2, 0), (b"k", 12, True, "s", 2, 1), (b"k", None, False, "u", 2, 0)], kind)
    entered = filter_audit.first_holders(first, None)
    as_set = lambda df: {(r.part, r["mask"], r.flags, r.n) for r in df.collect() if r.n}
    assert as_set(filter_audit.changes(first, entered)) == {("s", 2, 0, 1), ("s", 18, 1, 1), ("u", 2, 0, 1)}
    second = spark.createDataFrame([(b"k", 5, True, "t", 2, 1), (b"k", 5, True, "t", 2, 1), (b"k", 9, True, "s", 2, 0)], kind)
    again = filter_audit.first_holders(second, entered)
    assert as_set(filter_audit.changes(second, again)) == {("t", 2, 1, 2), ("s", 2, 0, -1), ("s", 18, 0, 2)}
    third = spark.createDataFrame([(b"k", 5, True, "v", 2, 0), (b"k", 6, True, "v", 2, 0)], kind)
    met = filter_audit.first_holders(third, entered.union(again))
    assert as_set(filter_audit.changes(third, met)) == {("v", 2, 0, 1), ("v", 18, 0, 1)}
    last = spark.createDataFrame([(b"k", 1, True, "w", 2, 0)], kind)
    end = filter_audit.changes(last, filter_audit.first_holders(last, entered.union(again).union(met)))
    assert as_set(end) == {("w", 2, 0, 1), ("t", 2, 1, -2), ("t", 18, 1, 2), ("v", 2, 0, -1), ("v", 18, 0, 1)}


# ---- source divergence ----


def brute_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t in df if df[t] >= min_docs}
        groups = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        every = sum(groups.values(), Counter())
        v = len(kept)

        def shares(c, v=v, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}

        q = shares(every)
        for s, c in groups.items():
            p = shares(c)
            pairs = [(sum(abs(p[t] - o[t]) for t in kept), b) for b, o in ((b, shares(groups[b])) for b in groups if b != s)]
            terms = [(p[t] - q[t], t) for t in kept if c[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def test_divergence_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["The", "the", "THE", "é", "É", "naïve", "x1y", "über", "prefixed" * 3, "prefixed" * 3 + "a", "w" * 500, "w" * 501, "𐐨𐐀", "a b", "tie", "tye"]
    rows = [
        (rng.randrange(50), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 30)))]), rng.choice(["en", "de", None]), rng.choice(["s", "t", "u", None]))
        for _ in range(120)
    ]
    rows += [(3, "the tie tye", "en", "s")] * 5 + [(1, "rare", "fr", "s"), (2, None, "fr", "t"), (None, "12 34", "zz", "s")]
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in source_audit.audit(docs_of(spark, rows), 6, 4).collect()}
    assert got == brute_divergence(rows, 6, 4)
    assert source_audit.audit(docs_of(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abAé \x00.z", max_size=40), max_size=12), st.integers(1, 3))
def test_sorted_pointers_count_like_a_dictionary(texts, groups):
    import pyarrow as pa

    of = np.arange(len(texts)) % groups
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.replace("A", "a")) for t in texts]
    n = Counter((w.encode(), int(g)) for ws, g in zip(words, of, strict=True) for w in ws)
    docs = Counter((w.encode(), int(g)) for ws, g in zip(words, of, strict=True) for w in set(ws))
    if not texts:
        return
    terms, group, df, count = source_audit.count_slice(pa.array(texts), of)
    keys = list(zip(terms, group.tolist(), strict=True))
    assert dict(zip(keys, count.tolist(), strict=True)) == n and dict(zip(keys, df.tolist(), strict=True)) == docs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=30))
def test_pointers_sort_like_their_words(words):
    data = np.frombuffer(b"\x00".join(words) + bytes(300), np.uint8)
    start = np.cumsum([0, *[len(w) + 1 for w in words[:-1]]])
    order, new = source_audit.sort_pointers(data, start, np.array([len(w) for w in words]))
    assert [words[i] for i in order] == sorted(words)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: (words[i], i))
    assert [bool(x) for x in new] == [i == 0 or words[a] != words[b] for i, (a, b) in enumerate(zip(order, [None, *order[:-1]], strict=True))]


# ---- mixing ----


def level(sizes, weights):
    """Targets by sharing again what is above three times a size, until nothing is."""
    budget, full, out = sum(sizes.values()), set(), {}
    while True:
        left, of = budget - sum(3 * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        out = {s: 3 * sizes[s] if s in full else left * weights[s] / of for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        full |= over


MIXED = [
    [(k, "w " * (1 + k % 40), None, f"s{k % 4}") for k in range(300)],
    [(k, "w " * 30, None, "hot" if k % 3 else f"t{k}") for k in range(150)],
    [(1, "same text here", None, None)] * 20 + [(None, "null id", None, "a"), (None, None, None, "a"), (5, "", None, "z"), (6, "w " * 5000, None, "b")],
    [(1, "", None, "a"), (2, None, None, None)],
]


@pytest.mark.parametrize("rows", MIXED)
def test_mix_meets_its_targets(spark, rows):
    mixed = mixing.mix(docs_of(spark, rows))
    got = mixing.taken(mixed).collect()
    size = lambda t: len((t or "").split())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size) for r in got) == sorted((-1 if i is None else i, size(t)) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = level(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)})
    targets = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    assert targets == pytest.approx(want)
    assert sum(r.taken for r in got) == sum(sizes.values())
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by_source = {r.source: r.n for r in mixed.groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert all(abs(by_source[s] - want[s]) <= len(names) for s in names)
    # At most one copy of a source is cut.
    cut = Counter(r.source for r in mixed.where("finish IS NOT NULL AND taken < size").collect())
    assert all(n <= 1 for n in cut.values())


def test_mix_is_ordered_and_does_not_depend_on_partitions(spark):
    rows = MIXED[0]
    mixed = mixing.mix(docs_of(spark, rows)).where("taken > 0").orderBy("position").collect()
    ends = 0
    for r in mixed:
        assert r.position == ends
        ends += r.taken
    assert [r.finish for r in mixed] == sorted(r.finish for r in mixed)
    key = lambda d: sorted((r.doc_id, r.taken) for r in mixing.taken(mixing.mix(d)).collect())
    assert key(docs_of(spark, rows, 7)) == key(docs_of(spark, rows[::-1], 1))
    assert mixing.taken(mixing.mix(docs_of(spark, rows).limit(0))).count() == 0
    # Early parts of the mix hold the sources in the same proportions.
    half = Counter()
    for r in mixed:
        if r.position < ends / 2:
            half[r.source] += r.taken
    for s, t in {r.source: r.target for r in mixed}.items():
        assert abs(half[s] - t / 2) <= 45


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None, "hot", "hot"]), k, rng.choice([None, 0, 1, 7])) for k in range(400)]
    found = running(spark.createDataFrame(rows, "g string, k int, v int").repartition(9), ["g"], ["k"], "v").collect()
    assert len(found) == 400
    sums, places = Counter(), Counter()
    for r in sorted(found, key=lambda r: r.k):
        places[r.g] += 1
        assert (r.before, r.place) == (sums[r.g], places[r.g])
        sums[r.g] += r.v or 0
