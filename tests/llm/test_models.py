from __future__ import annotations

import hashlib
import itertools
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import crf, forest, licences, pii, quality, secret_scan, toxicity


def enumerate_chain(emit, step):
    """All label sequences of one chain with their weights."""
    n, k = emit.shape
    out = {}
    for tags in itertools.product(range(k), repeat=n):
        score = sum(emit[i, t] for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:], strict=False))
        out[tags] = np.exp(score)
    return out


def test_chain_against_enumeration():
    rng = np.random.default_rng(0)
    lengths, k = [4, 1, 3], 3
    emit, step = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k))
    at, mask = crf.grid(lengths)
    alpha, beta, z, moves = crf.forward_backward(emit[at], mask, step)
    best = crf.viterbi(emit[at], mask, step)
    total_moves = np.zeros((k, k))
    start = 0
    for s, n in enumerate(lengths):
        paths = enumerate_chain(emit[start : start + n], step)
        total = sum(paths.values())
        assert np.isclose(z[s], np.log(total))
        for i in range(n):
            for label in range(k):
                share = sum(w for tags, w in paths.items() if tags[i] == label) / total
                assert np.isclose(np.exp(alpha[i, s, label] + beta[i, s, label] - z[s]), share)
        for tags, w in paths.items():
            for a, b in zip(tags, tags[1:], strict=False):
                total_moves[a, b] += w / total
        assert tuple(best[:n, s]) == max(paths, key=paths.get)
        start += n
    assert np.allclose(moves, total_moves)


@pytest.mark.parametrize("n", [9, 500])
def test_binary_marginals_equal_the_general_ones(n):
    """Chains are whole documents: nothing is cut at 64 tokens."""
    rng = np.random.default_rng(1)
    words = "alpha beta gamma delta".split()
    weights = {f: rng.normal(size=2) for w in words for f in ("w=" + w, "-1=" + w, "+1=" + w)}
    chain = crf.Model(weights, 2 * rng.normal(size=(2, 2)))
    model = toxicity.ToxicModel.of(chain)
    doc = rng.choice(words, n).tolist()
    got = toxicity.Scorer(model).marginals([doc[:3], doc, [], doc[:1], doc])
    emit = np.zeros((n, 2))
    for i, w in enumerate(doc):
        emit[i] = chain.emission([*toxicity.own_features(w), *(["-1=" + doc[i - 1]] if i else []), *(["+1=" + doc[i + 1]] if i < n - 1 else [])])
    at, mask = crf.grid([n])
    alpha, beta, z, _ = crf.forward_backward(emit[at], mask, chain.step)
    expected = np.exp(alpha + beta - z[None, :, None])[:, 0, 1]
    assert np.allclose(got[1], expected) and np.allclose(got[4], expected)
    assert [len(g) for g in got] == [3, n, 0, 1, n]


def test_word_tables_equal_the_features():
    rng = np.random.default_rng(3)
    words = ["Alpha", "BETA!", "x", "", "...", "abcdefgh", "abcdefg", "abcdef", "abcde", "abcd", "abc", "Straße,", "7up", "a=b=c", "p4=x"]
    feats = {f for w in words for f in toxicity.own_features(w)} | {k + toxicity.core(w) for w in words for k in ("-1=", "+1=")}
    model = toxicity.ToxicModel({f: float(rng.normal()) for f in sorted(feats)}, np.ones((2, 2)), (0.0, 0.0, 0.0))
    for w, got in zip(words, model.tables(words), strict=True):
        own = sum(model.odds.get(f, 0.0) for f in toxicity.own_features(w))
        c = toxicity.core(w)
        assert np.allclose(got, (own, model.odds["-1=" + c], model.odds["+1=" + c]))


#: The patterns of the base spans.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@@..-_ 1250\n", max_size=40))
def test_pii_search_equals_the_patterns(text):
    assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]
    expected = [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    assert pii.addresses(text) == expected


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("at AT (at) [At] dot (DOT) a.b .. x. dog 5 q@r , the".split()), max_size=9))
def test_pii_prefilter_loses_nothing(words):
    assert pii.may_be_tagged(" ".join(words)) == bool(pii.can_be_tagged(words).any())


@pytest.mark.parametrize(
    "text",
    ["9" * 10**6 + ".1.1.1", "a" * 10**6 + "@", "@" * 10**5, "1." * 10**5, "+" + "1(" * 10**5, "a@" * 10**5, "5 " * 10**5, "at " * 10**5, "1.2.3.4 " * 20000],
)
def test_pii_of_very_long_texts(text):
    start = time.process_time()
    pii.base_spans(text)
    pii.may_be_tagged(text)
    assert time.process_time() - start < 3


def test_pii_spelled_out_addresses():
    model = pii.fitted()
    texts = ["john (AT) example (DOT) com", "write to mary at mail dot example dot org please", "nothing at all to see here"]
    spans = pii.added_spans(texts, model, [[], [], []])
    assert [len(s) for s in spans] == [1, 1, 0]
    words = "x first dot last at mail dot dept dot example dot org y".split()
    on = pii.can_be_tagged(words)
    assert on[1:12].all() and not on[0]


def overlap_free(text):
    """Candidates by comparing each with all before."""
    found = [(1, *m.span()) for m in secret_scan.KNOWN.finditer(text)]
    found += [(0, *m.span(1)) for m in secret_scan.ASSIGNED.finditer(text)]
    found += [(2, *m.span()) for m in secret_scan.LONG.finditer(text) if re.search(r"[0-9]", m.group())]
    out = []
    for c in sorted(found, key=lambda c: (c[0] == 2, c[1], -c[2])):
        if all(c[2] <= s or e <= c[1] for _, s, e in out):
            out.append(c)
    return sorted(out, key=lambda c: c[1])


def test_secret_candidates_do_not_overlap():
    rng = np.random.default_rng(4)
    bits = ["token=", "sk-", "abcdefghij0123456789", "AKIA", "ABCDEFGHIJ012345", " ", "key:", "eyJ", ".", "ghp_", "secret: ", "/", "z" * 30]
    for _ in range(300):
        text = "".join(rng.choice(bits, 12))
        assert secret_scan.candidates(text) == overlap_free(text)
    text = "\n".join(f"api_key = 'k{i:030d}'" for i in range(20_000)) + "eyJ" * 100_000
    start = time.process_time()
    assert len(secret_scan.candidates(text)) >= 20_000
    assert time.process_time() - start < 5


def area(score, label):
    order = score.rank()
    pos, neg = (label == 1).sum(), (label == 0).sum()
    return (order[label == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(tables):
    docs, labels = tables
    got = toxicity.score_toxicity(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert area(held.score, held.toxic) > 0.8
    assert (held.predicted == held.toxic).mean() > 0.9
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality.score_quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert area(held.score, held.quality) > 0.97
    assert (held.predicted == held.quality).mean() > 0.95


def test_attention_gradients():
    rng = np.random.default_rng(2)
    x, bag, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0, 1])
    k = 3
    p = {n: rng.normal(0, 0.3, s) for n, s in {"W": (quality.N_FEATURES, k), "V": (k, k), "U": (k, k), "w": (k,), "c": (k,), "b": (k,)}.items()}
    model = quality.Attention(p | {"d": np.array(0.1)}, np.zeros(quality.N_FEATURES), np.ones(quality.N_FEATURES))
    weight = np.array([1.0, 2, 1])

    def loss():
        s = model.forward(x, bag, 3)["s"]
        return -(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).mean()

    grads = model.gradients(x, bag, y, weight)
    for name in ("W", "b", "V", "U", "w", "c"):
        at = (0,) * p[name].ndim
        old = p[name][at]
        model.p[name][at] = old + 1e-6
        up = loss()
        model.p[name][at] = old - 1e-6
        down = loss()
        model.p[name][at] = old
        assert np.isclose((up - down) / 2e-6, grads[name][at], atol=1e-5)


def test_passages_of_odd_texts():
    texts = ["", "\n\n", "a", "x " * 2000, "line one\n\nline two", "é" * 700]
    features, owner = quality.passages(texts)
    assert set(owner) == set(range(len(texts)))
    assert np.isfinite(features).all()
    alone = quality.passages([texts[4]])[0]
    assert np.allclose(alone, features[owner == 4])


def base(text):
    """The contract's patterns, plainly."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        check = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and check % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


PRIVATE = [
    None, "", "mail a.b+c@x-y.co.uk, or q@z", "ip 10.0.0.255 and 300.1.1.1 and 1.2.3.4.5.6.7.8", "card 4539 1488 0343 6467 and 4539148803436468",
    "call +1 (564) 555-4526 or +12 3", "x@y.z 1.1.1.1 +49 30 1234567 4111-1111-1111-1111 end", "phone (564) 555-4526 now", "é😀 a@b.cd", "john at example dot com please",
]


def test_pii(spark):
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(PRIVATE)], "doc_id long, text string, spans string")
    kinds = ["email", "ip", "card", "phone"]
    for r in pii.find(docs).collect():
        text = PRIVATE[r.doc_id] or ""
        spans = sorted(base(text), key=lambda s: (kinds.index(s[0]), s[1]))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in kinds]
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(r.spans.split(","))
        if r.doc_id == 7:
            assert r.spans == "phone:6:20"
        if r.doc_id == 9:
            assert r.spans == "email:0:23"


def test_forest_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = forest.fit(x[:400], y[:400])
    assert ((model.predict(x[400:]) >= 0.5) == y[400:]).mean() > 0.85


def test_secrets_on_held_out_findings():
    model = secret_scan.fitted()
    right = n = 0
    for text, (a, b), path, label in secret_scan.labelled_findings(400, seed=77):
        _, (kept,) = secret_scan.secrets([text], [path], model)
        right += bool([s for s in kept if s[0] < b and a < s[1]]) == bool(label)
        n += 1
    assert right / n > 0.93


def test_secret_scan_and_redaction(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'x token = "{key}" y', "a", "s", 5), (2, f"commit {key} is fine", "b", "s", 5), (3, None, "c", None, 5), (4, "", "d", "s", 5), (None, f'token = "{key}"', "e", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string, source string, n_chars long")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    assert (got[1].n_secrets, got[1].spans) == (1, "11:51")
    assert (got[2].n_candidates, got[2].n_secrets) == (1, 0)
    clean = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert clean[1].text == 'x token = "[SECRET]" y'
    assert clean[1].n_chars == len(clean[1].text)
    assert clean[2].text == rows[1][1]
    assert clean[3].text is None
    assert secret_scan.redact(docs).columns == docs.columns


def test_licences(spark):
    rows = [
        (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License."), (3, "you need a license to drive"),
        (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (7, "the MIT campus is large"), (8, "x\n" * 500),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    assert {i: r.families for i, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "", 4: "", 5: "", 6: "CC-BY-NC,Proprietary", 7: "", 8: ""}
    assert got[1].spans == "Apache-2.0:12:59"


WRAPPED = [
    ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    (
        "GPL",
        " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation; either version 2 of the License.",
    ),
    ("CC-BY-SA", "# licensed under a\n# Creative Commons\n# Attribution-\n# ShareAlike 4.0\n# International License"),
    ("MIT", '"SPDX-License-Identifier":"MIT"'), ("MIT", "/*SPDX-License-Identifier:MIT*/"),
]


@pytest.mark.parametrize(("family", "text"), WRAPPED)
def test_licences_over_lines_and_in_quotes(family, text):
    for before, after in (("", ""), ("Some prose.\n\n", "\n\nMore."), ("import os\n", "\nx = 1")):
        found = licences.statements([before + text + after], licences.fitted())[0]
        assert [k for k, _, _ in found] == [family]
        lines = (before + text + after)[found[0][1] : found[0][2]].split("\n")
        assert len(lines) >= min(2, text.count("\n") + 1)
    apart = text.replace("\n", "\n\n")
    assert "\n" not in text or licences.statements([apart], licences.fitted())[0] == []


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 1), (1, None, 7), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        assert {r.score for r in quality.score_quality(docs, labels).collect()} == {0.0}
        assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
    for f in (lambda d: pii.find(d), lambda d: licences.scan(d), lambda d: quality.score_quality(d, none), lambda d: toxicity.score_toxicity(d, none)):
        assert f(docs.limit(0)).count() == 0
    assert secret_scan.scan(docs.withColumn("source", F.lit("s")).limit(0)).count() == 0
