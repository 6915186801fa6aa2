from __future__ import annotations

import corpus_pipeline
from quillspark.llm import decontaminate, near_dedup, secret_scan
from quillspark.llm.common import read


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert kept["quality"].count() < read(spark, sf_dir, "documents").count()
    classes = near_dedup.near_duplicates(kept["near_dedup"]).collect()
    assert all(r.doc_id == r.class_id for r in classes)
    assert decontaminate.contaminated(kept["decontamination"], read(spark, sf_dir, "benchmark")).count() == 0
    assert secret_scan.scan(kept["secrets"]).where("n_secrets > 0").count() == 0
    assert {r.doc_id for r in kept["packing"].select("doc_id").collect()} == {r.doc_id for r in kept["secrets"].select("doc_id").collect()}


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]


def test_odd_rows_pass_every_stage(spark, sf_dir):
    """Nulls in any column, empty texts, repeated and missing ids, and columns with names that stages use themselves."""
    good = " ".join(r.text for r in read(spark, sf_dir, "documents").where("length(text) > 800").orderBy("doc_id").limit(1).collect())
    item = read(spark, sf_dir, "benchmark").orderBy("item_id").first().text
    rows = [
        (1, good, "en", "a", 5, "x", 1), (1, good[:300] + " " + item, None, None, None, None, None), (None, good, "en", "a", 5, "y", 2),
        (None, "password: hunter2Zq81xPq77 and " + good[400:700], None, None, None, "z", 3), (2, None, None, None, None, "n", 4), (3, "", "en", "b", 0, "e", 5),
        (None, None, None, None, None, None, None), (4, item, "en", "a", 1, "i", 6), (4, item, "en", "a", 1, "i", 6),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, piece int")
    for data in (docs, docs.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, data, sf_dir)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            got = out.collect()
            assert got or data is not docs
    kept = corpus_pipeline.near_dedup_stage(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.row or "") for r in kept) == [(-1, ""), (-1, "z"), (1, ""), (1, "x"), (2, "n"), (3, "e"), (4, "i")]
    clean = corpus_pipeline.decontamination_stage(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or -1, r.row or "") for r in clean) == [(-1, ""), (-1, "y"), (-1, "z"), (1, "x"), (2, "n"), (3, "e")]
