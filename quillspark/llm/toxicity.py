"""Operator 4: toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not. On a bounded sample of labelled documents a
likelihood-ratio test marks words that belong to toxic documents; their occurrences in
toxic documents are the labelled tokens. A two-label chain is fitted to these by word,
affix, shape and neighbour features. Every token of every document then gets its
forward-backward marginal; the marginals of a document add up to its score (through a
logistic link fitted on the sample), and runs of likely tokens are the offending spans.

A chain is a whole document, however long. The recursions run over all documents of a batch
at once, one word of each at a step, on odds instead of logarithms: with two labels a message
is one number, and a step is one fraction. The fit sees pieces of ``FIT_TOKENS`` tokens, at
most ``MAX_CHAINS`` with a marked word and as many without one.

Defined results: null and empty texts score like any text without a toxic word; very long
texts take time in proportion to their words; null ids are scored too; repeated rows get the same score; without labels of both kinds the score is
the share of label 1 (0 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import id_and_text, remainder, text_slices
from .labelled import MAX_PER_LABEL, sample

DIVISOR, HELD_OUT = 5, 0
#: Tokens of a labelled piece in the fit.
FIT_TOKENS = 64
#: Marking a word as toxic: log-likelihood ratio and ratio of document shares.
MIN_EVIDENCE, MIN_RATIO = 9.0, 10.0
#: Pieces with a marked word in the fit at most, and as many without one.
MAX_CHAINS = 1200
#: Marginal from which a token belongs to a span.
SPAN_AT = 0.5
EDGE = ".,;:!?\"'()[]{}*#$%&|<>"
MAX_CACHED = 400_000


def core(word: str) -> str:
    return word.lower().strip(EDGE)


def own_features(word: str) -> list[str]:
    c = core(word)
    out = ["w=" + c, "bias"]
    out += [f"p{k}=" + c[:k] for k in (4, 5, 6, 7) if len(c) > k]
    out += [f"s{k}=" + c[-k:] for k in (3, 5) if len(c) > k]
    if word[:1].isupper():
        out.append("upper" if word.isupper() else "title")
    if c != word.lower():
        out.append("edge")
    return out


@dataclass
class ToxicModel:
    """Log odds of label 1 by feature, odds of the steps between labels, and the link to a score."""

    odds: dict[str, float]
    step: np.ndarray
    link: tuple[float, float, float]

    @classmethod
    def of(cls, chain: crf.Model) -> ToxicModel:
        odds = {f: float(w[1] - w[0]) for f, w in chain.weights.items()}
        return cls(odds, np.exp(chain.step), (0.0, 0.0, 0.0))

    def tables(self, words: Iterable[str]) -> list[tuple[float, float, float]]:
        """What each word adds to the log odds of its own label, the next one's and the one before.

        The first is the sum over ``own_features``, looked up by kind of feature so that no
        feature has to be spelled out for each of very many words.
        """
        kinds: dict[str, dict[str, float]] = {}
        for f, v in self.odds.items():
            kind, _, rest = f.partition("=")
            kinds.setdefault(kind, {})[rest] = v
        word, after, before, p4, p5, p6, p7, s3, s5 = (kinds.get(k, {}).get for k in ("w", "-1", "+1", "p4", "p5", "p6", "p7", "s3", "s5"))
        bias, upper, title, edge = (self.odds.get(f, 0.0) for f in ("bias", "upper", "title", "edge"))
        out = []
        for w in words:
            low = w.lower()
            c = low.strip(EDGE)
            n = len(c)
            own = bias + word(c, 0.0)
            if n > 3:
                own += s3(c[-3:], 0.0)
                if n > 4:
                    own += p4(c[:4], 0.0)
                    if n > 5:
                        own += p5(c[:5], 0.0) + s5(c[-5:], 0.0)
                        if n > 6:
                            own += p6(c[:6], 0.0)
                            if n > 7:
                                own += p7(c[:7], 0.0)
            if w[:1].isupper():
                own += upper if w.isupper() else title
            if c != low:
                own += edge
            out.append((own, after(c, 0.0), before(c, 0.0)))
        return out


def chain_odds(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Odds of label 1 for each token of each chain, given the log odds that its features add.

    ``emit`` has the chains one after the other, ``step`` the exponentials of the label-to-label
    weights. Tokens are dealt so that the k-th tokens of all chains that have one lie together,
    longer chains first; a recursion is a few vector operations on each such row.
    """
    order = np.argsort(-sizes, kind="stable")
    lane = np.empty(len(sizes), np.int64)
    lane[order] = np.arange(len(sizes))
    longest = int(sizes.max(initial=0))
    active = np.cumsum(np.bincount(sizes, minlength=longest + 1)[::-1])[::-1][1:]  # chains longer than k
    row = np.append(0, np.cumsum(active))
    depth = np.arange(len(emit)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = row[depth] + np.repeat(lane, sizes)
    e = np.empty(len(emit))
    e[at] = np.exp(np.clip(emit, -60, 60))
    fwd, bwd = e.copy(), np.ones(len(emit))
    (s00, s01), (s10, s11) = step.tolist()
    rows = row.tolist()
    for k in range(1, longest):
        a, b, c = rows[k - 1], rows[k], rows[k + 1]
        m = fwd[a : a + c - b]
        top = m * s11
        top += s01
        low = m * s10
        low += s00
        top /= low
        fwd[b:c] *= top
    for k in range(longest - 2, -1, -1):
        a, b, c = rows[k], rows[k + 1], rows[k + 2]
        m = e[b:c] * bwd[b:c]
        top = m * s11
        top += s10
        m *= s01
        m += s00
        np.divide(top, m, out=bwd[a : a + c - b])
    fwd *= bwd
    return fwd[at]


class Scorer:
    """Marginals of whole documents with a word cache; one for each task."""

    def __init__(self, model: ToxicModel) -> None:
        self.model = model
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, 3))

    def _ids(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.index)
        if new:
            if len(self.index) + len(new) > MAX_CACHED:
                self.index, self.table = {}, np.zeros((0, 3))
                new = set(words)
            rows = np.array(self.model.tables(new))
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def marginals(self, docs: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of each word of each document."""
        sizes = np.array([len(d) for d in docs], np.int64)
        words = [w for d in docs for w in d]
        if not words:
            return [np.zeros(0) for _ in docs]
        own, after, before = self.table_rows(words).T
        inner = np.ones(len(words) + 1, bool)  # whether a word has one before it in its document
        inner[np.append(0, np.cumsum(sizes))] = False
        emit = own.copy()
        emit[1:] += np.where(inner[1:-1], after[:-1], 0)
        emit[:-1] += np.where(inner[1:-1], before[1:], 0)
        odds = chain_odds(emit, sizes, self.model.step)
        return np.split(odds / (1 + odds), np.cumsum(sizes)[:-1])

    def table_rows(self, words: list[str]) -> np.ndarray:
        ids = self._ids(words)
        return self.table[ids]

    def score(self, prob: np.ndarray) -> float:
        a, b, c = self.model.link
        x = _summary(prob)
        return float(1 / (1 + np.exp(-np.clip(a + b * x[0] + c * x[1], -40, 40))))


def _summary(prob: np.ndarray) -> tuple[float, float]:
    """Log of one plus the expected number of toxic tokens, and the largest marginal."""
    return (float(np.log1p(prob.sum())), float(prob.max())) if len(prob) else (0.0, 0.0)


def fit(texts: list[str], y: list[int], counts: dict[int, int], tokens: int = FIT_TOKENS) -> ToxicModel | float:
    """The model, or a constant score where labels of both kinds are missing."""
    if not (0 in y and 1 in y):
        return counts.get(1, 0) / max(1, sum(counts.values()))
    docs = [t.split() for t in texts]
    seen = [Counter(), Counter()]
    total = [y.count(0), y.count(1)]
    for d, label in zip(docs, y, strict=True):
        seen[label].update({core(w) for w in d} - {""})
    marked = set()
    share = total[1] / (total[0] + total[1])
    for w, pos in seen[1].items():
        neg = seen[0][w]
        gain = pos * np.log(pos / (pos + neg) / share) + (neg * np.log(neg / (pos + neg) / (1 - share)) if neg else 0)
        if gain >= MIN_EVIDENCE and pos / total[1] >= MIN_RATIO * (neg + 0.5) / total[0]:
            marked.add(w)
    feats: list[list[str]] = []
    labels: list[int] = []
    lengths: list[int] = []
    plain: list[tuple[list[str], int, list[int]]] = []
    hot: list[tuple[list[str], int, list[int]]] = []
    for d, label in zip(docs, y, strict=True):
        for k in range(0, len(d), tokens):
            tags = [int(label == 1 and core(w) in marked) for w in d[k : k + tokens]]
            if any(tags):
                hot.append((d, k, tags))
            elif label == 0:
                plain.append((d, k, tags))
    rng = np.random.default_rng(7)
    taken = [hot[i] for i in sorted(rng.permutation(len(hot))[:MAX_CHAINS])]
    keep = sorted(rng.permutation(len(plain))[: max(len(taken), 20)])
    for d, k, tags in [*taken, *(plain[i] for i in keep)]:
        for i in range(k, k + len(tags)):
            fs = own_features(d[i])
            if i:
                fs.append("-1=" + core(d[i - 1]))
            if i + 1 < len(d):
                fs.append("+1=" + core(d[i + 1]))
            feats.append(fs)
        labels += tags
        lengths.append(len(tags))
    model = ToxicModel.of(crf.fit(feats, np.array(labels, np.int64), lengths, 2, min_count=4, rounds=25))
    scorer = Scorer(model)
    x = np.array([_summary(p) for p in scorer.marginals(docs)])
    model.link = _logistic(x, np.array(y), counts)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> tuple[float, float, float]:
    """Newton steps for a small logistic fit; rows are weighted to the labels' true shares."""
    design = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())
    weight = weight / weight.mean()
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 0.1 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, grad)
    return tuple(float(v) for v in beta)


def tag(docs: DataFrame, model: ToxicModel | float) -> DataFrame:
    """doc_id, score, n_toxic_tokens and spans (character offsets ``start:end`` of likely runs)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if isinstance(model, ToxicModel) else None
        for part, texts in text_slices(batches):
            split = [t.split() for t in texts]
            probs = scorer.marginals(split) if scorer else [np.zeros(len(d)) for d in split]
            scores = [scorer.score(p) for p in probs] if scorer else [float(model)] * len(texts)
            spans = []
            for text, p in zip(texts, probs, strict=True):
                on = np.flatnonzero(p >= SPAN_AT)
                runs: list[tuple[int, int]] = []
                if len(on):
                    ends = [m.span() for m in re.finditer(r"\S+", text)]
                    for first in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                        runs.append((ends[first[0]][0], ends[first[-1]][1]))
                spans.append([f"{a}:{b}" for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(scores, pa.float64()),
                    pa.array([int((p >= SPAN_AT).sum()) for p in probs], pa.int64()),
                    pa.array(spans, pa.list_(pa.string())),
                ],
                names=["doc_id", "score", "n_toxic_tokens", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, n_toxic_tokens long, spans array<string>")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """Fits on a bounded sample of the training folds and tags every document."""
    texts, y, counts = sample(docs, labels, "toxic", DIVISOR, HELD_OUT, False, max_per_label)
    return tag(docs, fit(texts, y, counts)).select(
        "doc_id",
        (remainder(F.col("doc_id"), DIVISOR) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_toxic_tokens",
        "spans",
    )
