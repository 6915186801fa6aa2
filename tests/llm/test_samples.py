"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.llm import quality, toxicity
from quillspark.llm.labelled import pieces, sample

LABELS = "doc_id long, quality int, toxic int, text string"


def label_rows(n):
    return [(i, i % 2, i % 2, "not the text") for i in range(n)] + [(5, 0, 0, "x"), (None, 1, 1, "x"), (8, None, 2, "x")]


def test_a_shard_uses_all_labels_that_its_documents_have(spark):
    labels = spark.createDataFrame(label_rows(5000), LABELS)
    docs = spark.createDataFrame([(i, f"text {i}", 1) for i in range(0, 5000, 49)] + [(98, "a second text", 1), (None, "no id", 1)], "doc_id long, text string, y int")
    texts, y, counts = sample(docs, labels.where("doc_id != 5 and doc_id != 8"), "quality", 3, 1, False, max_per_label=60)
    ids = [int(t.rpartition(" ")[2]) for t in texts if t.startswith("text")]
    assert sum(counts.values()) == len(texts) == len(y) and 50 <= len(texts) <= 75
    assert "a second text" in texts and "text 98" not in texts
    assert set(ids) <= set(range(0, 5000, 49))
    few, _, all_counts = sample(docs, labels, "quality", 3, 1, False, max_per_label=7)
    assert len(few) == 14 and all_counts == counts
    assert sample(docs.limit(0), labels, "quality", 3, 1, False) == ([], [], {})


def test_long_documents_take_part_over_their_whole_length(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    frame = spark.createDataFrame([(text,), ("short text",), ("x" * 200_000,), ("",)], "text string")
    cut, short, lone, empty = [r.p for r in frame.select(pieces(F.col("text")).alias("p")).collect()]
    assert (short, empty) == ("short text", "")
    assert 40_000 < len(cut) <= 50_000 and 40_000 < len(lone) <= 50_000
    words = cut.split()
    assert set(words) <= set(text.split())
    assert words[0] in ("w0", "w1") and int(words[-1][1:]) > 59_900
    assert max(int(b[1:]) - int(a[1:]) for a, b in zip(words, words[1:], strict=False)) < 2000


def test_fits_of_long_documents_only(spark):
    good = "A calm line of plain words that reads well.\n" * 1500
    bad = "$$$ ### BUY NOW !!! ||| 000\n" * 2500
    rows = [(i, good + str(i) if i % 2 else bad + str(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2, "") for i in range(60)], LABELS)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    assert min(scores[i] for i in range(1, 60, 2)) > max(scores[i] for i in range(0, 60, 2))
    assert quality.keep_good(docs, labels).count() == 30
    toxic = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert min(toxic[i] for i in range(0, 60, 2)) > max(toxic[i] for i in range(1, 60, 2))
