"""Operator 10: document quality by attention-based multiple-instance learning.

A document is a bag of passages (lines, cut at ``PASSAGE`` bytes). Each passage is encoded from
character-class shares, word lengths and word repetition; a small network embeds it, gated
attention (tanh times sigmoid) weighs it within its document, and the weighted sum of
embeddings is scored. Only document labels train it. Features of a batch of texts are
computed at once over one byte buffer.

Defined results: null and empty texts are one empty passage and get a score; null ids are
scored too; repeated rows get the same score; without labels of both kinds the score is the
share of label 1 (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, remainder, text_slices
from .labelled import MAX_PER_LABEL, sample

DIVISOR, HELD_OUT = 3, 1
PASSAGE = 512
HIDDEN = 12
ROUNDS = 250
#: Bytes of text in one vectorised step, whose arrays take some sixty times as much.
SLICE = 600_000

#: Byte classes; every other byte is "other".
CLASS_BYTES = {
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>@^~=+_/\\",
    "quote": b"'\"()[]{}-",
    "high": bytes(range(128, 256)),
}
SPACE = b" \t\n\x0b\f\r"
N_CLASSES = len(CLASS_BYTES) + 2
N_FEATURES = N_CLASSES + 8


def _lookup() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for k, members in enumerate(CLASS_BYTES.values(), 2):
        table[list(members)] = k
    table[list(SPACE)] = 1
    return table


LOOKUP = _lookup()
POWERS = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, document number) of all passages of a batch, documents in order."""
    raw = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw], np.int64)
    doc_start = np.cumsum(size) - size
    # A passage starts with a document, after a newline, and every PASSAGE bytes of a line.
    line = np.union1d(doc_start, np.flatnonzero(buf[:-1] == 10) + 1)
    length = np.diff(np.append(line, len(buf)))
    n = -(-length // PASSAGE)
    start = np.repeat(line, n) + PASSAGE * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    owner = np.searchsorted(doc_start, start, "right") - 1
    extent = np.diff(np.append(start, len(buf)))
    # Lines without a word are left to the document's other passages.
    kind = LOOKUP[buf]
    of = np.repeat(np.arange(len(start)), extent)
    counts = np.bincount(of * N_CLASSES + kind, minlength=len(start) * N_CLASSES).reshape(len(start), N_CLASSES)
    chars = np.maximum(extent, 1)[:, None]
    blank = kind == 1
    first = np.flatnonzero(~blank & np.append(True, blank[:-1]))
    f = np.zeros((len(start), N_FEATURES))
    f[:, :N_CLASSES] = counts / chars
    f[:, -8] = np.log1p(extent) / 6
    if len(first):
        word_len = np.diff(np.append(first, len(buf)))
        place = np.arange(first[0], len(buf)) - np.repeat(first, word_len)
        term = np.where(blank[first[0] :], np.uint64(0), (buf[first[0] :].astype(np.uint64) + np.uint64(1)) * POWERS[place & 63])
        names = np.add.reduceat(term, first - first[0])
        solid = np.add.reduceat((~blank[first[0] :]).astype(np.int64), first - first[0])
        home = of[first]
        words = np.bincount(home, minlength=len(start)).astype(float)
        some = np.maximum(words, 1)
        again = np.append(False, (names[1:] == names[:-1]) & (home[1:] == home[:-1]))
        order = np.lexsort((names, home))
        fresh = np.append(True, (names[order][1:] != names[order][:-1]) | (home[order][1:] != home[order][:-1]))
        f[:, -7] = np.bincount(home, again, len(start)) / some
        f[:, -6] = np.bincount(home[order], fresh, len(start)) / some
        f[:, -5] = np.bincount(home, solid, len(start)) / some / 10
        f[:, -4] = np.log1p(words) / 4
        f[:, -3] = np.bincount(home, kind[first] == 3, len(start)) / some
        f[:, -2] = np.bincount(home, solid == 1, len(start)) / some
        f[:, -1] = np.bincount(home, solid <= 3, len(start)) / some
    keep = counts[:, 1] < extent
    lonely = np.bincount(owner, keep, len(texts)) == 0
    keep |= lonely[owner] & np.isin(start, doc_start)
    return f[keep], owner[keep]


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``passages`` of any number of texts, ``SLICE`` bytes at a time."""
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    found, n = [(np.zeros((0, N_FEATURES)), np.zeros(0, np.int64))], 0
    for part, some in text_slices([rows], SLICE):
        x, bag = passages(some)
        found.append((x, bag + n))
        n += part.num_rows
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sums(x: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(bag, x[:, k], n) for k in range(x.shape[1])], axis=1)


class Attention:
    """Embedding, gated attention and score; parameters in a dict of arrays."""

    def __init__(self, p: dict[str, np.ndarray], centre: np.ndarray, spread: np.ndarray) -> None:
        self.p, self.centre, self.spread = p, centre, spread

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        x = np.clip((x - self.centre) / self.spread, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        a = np.exp(e - top[bag])
        a /= np.bincount(bag, a, n)[bag]
        z = _sums(a[:, None] * h, bag, n)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -40, 40)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "s": s}

    def gradients(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(y)
        v = self.forward(x, bag, n)
        ds = weight * (v["s"] - y) / n
        dz = ds[:, None] * p["c"][None]
        da = (dz[bag] * v["h"]).sum(axis=1)
        de = v["a"] * (da - np.bincount(bag, v["a"] * da, n)[bag])
        dgate = de[:, None] * p["w"][None]
        dt, dg = dgate * v["g"] * (1 - v["t"] ** 2), dgate * v["t"] * v["g"] * (1 - v["g"])
        dh = v["a"][:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
        du = dh * (1 - v["h"] ** 2)
        return {
            "W": v["x"].T @ du,
            "b": du.sum(axis=0),
            "V": v["h"].T @ dt,
            "U": v["h"].T @ dg,
            "w": (de[:, None] * v["t"] * v["g"]).sum(axis=0),
            "c": v["z"].T @ ds,
            "d": np.array(ds.sum()),
        }


def fit(texts: list[str], y: list[int], counts: dict[int, int], rounds: int = ROUNDS, hidden: int = HIDDEN) -> Attention | float:
    """Adam over all sampled bags at once, or a constant where labels of both kinds are missing."""
    if not (0 in y and 1 in y):
        return counts.get(1, 0) / max(1, sum(counts.values()))
    x, bag = bags(texts)
    rng = np.random.default_rng(5)
    shape = {"W": (N_FEATURES, hidden), "V": (hidden, hidden), "U": (hidden, hidden), "w": (hidden,), "c": (hidden,)}
    p = {k: rng.normal(0, 0.3, s) for k, s in shape.items()} | {"b": np.zeros(hidden), "d": np.array(0.0)}
    model = Attention(p, x.mean(axis=0), x.std(axis=0) + 1e-3)
    truth = np.array(y, float)
    weight = np.where(truth == 1, counts[1] / truth.sum(), counts[0] / (1 - truth).sum())
    weight /= weight.mean()
    m = {k: np.zeros_like(v) for k, v in p.items()}
    q = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, rounds + 1):
        for k, g in model.gradients(x, bag, truth, weight).items():
            g = g + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            q[k] = 0.99 * q[k] + 0.01 * g * g
            p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9**step)) / (np.sqrt(q[k] / (1 - 0.99**step)) + 1e-8)
    return model


def score(docs: DataFrame, model: Attention | float) -> DataFrame:
    """doc_id, score, n_passages and top_passage (number of the passage with the most attention)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, SLICE):
            x, bag = passages(texts)
            n = np.bincount(bag, minlength=len(texts))
            if isinstance(model, Attention):
                v = model.forward(x, bag, len(texts))
                s = v["s"]
                order = np.lexsort((-v["a"], bag))
                top = order[np.cumsum(n) - n] - (np.cumsum(n) - n)
            else:
                s, top = np.full(len(texts), float(model)), np.zeros(len(texts), np.int64)
            cols = [part.column(0), pa.array(s, pa.float64()), pa.array(n, pa.int64()), pa.array(top, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "score", "n_passages", "top_passage"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long")


def trained(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> Attention | float:
    """The model of a bounded sample of the training folds."""
    return fit(*sample(docs, labels, "quality", DIVISOR, HELD_OUT, False, max_per_label))


def score_quality(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """Every document's score and verdict."""
    return score(docs, trained(docs, labels, max_per_label)).select(
        "doc_id",
        (remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_passages",
        "top_passage",
    )


def keep_good(docs: DataFrame, labels: DataFrame, keep_at: float = 0.5, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """The documents, all their columns as they are, that score at least ``keep_at``.

    The model comes from the labelled documents that are in ``docs``.
    """
    model = trained(docs, labels, max_per_label)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        if not isinstance(model, Attention):
            return pa.array([model >= keep_at] * len(text), pa.bool_())
        rows = pa.RecordBatch.from_arrays([text.fill_null("")], names=["text"])
        kept = [model.forward(*passages(some), len(some))["s"] >= keep_at for _, some in text_slices([rows], SLICE)]
        return pa.array(np.concatenate([*kept, np.zeros(0, bool)]))

    return docs.where(good(F.col("text").cast("string")))
