"""Linear-chain conditional random fields in numpy: fitting, marginals and Viterbi, by batches.

Sequences lie in a padded (positions, sequences) grid; every step of a recursion is one
vector operation over all sequences.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def forward_backward(emit: np.ndarray, mask: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, log Z, expected transitions) for emissions (L, S, K) and a mask (L, S)."""
    length, _, _ = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, length):
        new = emit[t] + log_sum(alpha[t - 1][:, :, None] + step[None], 1)
        alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        new = log_sum(step[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(mask[t + 1][:, None], new, 0.0)
    z = log_sum(alpha[-1], 1)
    moves = np.zeros_like(step)
    for t in range(1, length):
        on = mask[t]
        if on.any():
            both = alpha[t - 1][on][:, :, None] + step[None] + (emit[t][on] + beta[t][on])[:, None, :]
            moves += np.exp(both - z[on][:, None, None]).sum(axis=0)
    return alpha, beta, z, moves


def viterbi(emit: np.ndarray, mask: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best label (L, S) of each position; padding repeats the last label."""
    length, n, _ = emit.shape
    score = emit[0]
    back = np.zeros(emit.shape, np.int8)
    for t in range(1, length):
        both = score[:, :, None] + step[None]
        back[t] = both.argmax(axis=1)
        new = both.max(axis=1) + emit[t]
        on = mask[t][:, None]
        score = np.where(on, new, score)
        back[t] = np.where(on, back[t], np.arange(emit.shape[2])[None])
    out = np.zeros((length, n), np.int8)
    out[-1] = score.argmax(axis=1)
    for t in range(length - 1, 0, -1):
        out[t - 1] = back[t][np.arange(n), out[t]]
    return out


def grid(lengths: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Token index (L, S) and mask (L, S) of consecutive sequences; padding points at token 0."""
    n = np.asarray(lengths, np.int64)
    start = np.cumsum(n) - n
    at = np.arange(n.max() if len(n) else 0)[:, None]
    mask = at < n[None]
    return np.where(mask, start[None] + at, 0), mask


class Model:
    """Weights by feature name, and label-to-label weights."""

    def __init__(self, weights: dict[str, np.ndarray], step: np.ndarray) -> None:
        self.weights, self.step = weights, step
        self.none = np.zeros(step.shape[0])

    def emission(self, features: Sequence[str]) -> np.ndarray:
        get, none = self.weights.get, self.none
        return sum((get(f, none) for f in features), none)


def fit(
    features: list[list[str]],
    labels: np.ndarray,
    lengths: Sequence[int],
    n_labels: int,
    min_count: int = 2,
    rounds: int = 60,
    l2: float = 0.02,
    rate: float = 0.3,
) -> Model:
    """Maximum conditional likelihood with an L2 penalty, by full-batch AdaGrad steps."""
    seen = Counter(f for fs in features for f in fs)
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= min_count))}
    dummy = len(index)
    width = max((len(fs) for fs in features), default=1)
    ids = np.full((len(features), width), dummy, np.int64)
    for row, fs in zip(ids, features, strict=True):
        row[: len(fs)] = [index.get(f, dummy) for f in fs]
    w, step = np.zeros((dummy + 1, n_labels)), np.zeros((n_labels, n_labels))
    if not len(features):
        return Model({}, step)
    at, mask = grid(lengths)
    truth = np.zeros((len(labels), n_labels))
    truth[np.arange(len(labels)), labels] = 1
    gold = labels[at]
    true_moves = np.zeros_like(step)
    pairs = mask[1:]
    np.add.at(true_moves, (gold[:-1][pairs], gold[1:][pairs]), 1)
    wide, flat = np.full_like(w, 1e-6), ids.reshape(-1)
    sq_step = np.full_like(step, 1e-6)
    for _ in range(rounds):
        emit = w[ids].sum(axis=1)
        alpha, beta, z, moves = forward_backward(emit[at], mask, step)
        prob = np.zeros_like(emit)
        prob[at[mask]] = np.exp(alpha + beta - z[None, :, None])[mask]
        diff = np.repeat(truth - prob, width, axis=0)
        grad = np.stack([np.bincount(flat, diff[:, k], dummy + 1) for k in range(n_labels)], axis=1) - l2 * w
        grad[dummy] = 0
        g_step = true_moves - moves - l2 * step
        wide += grad**2
        sq_step += g_step**2
        w += rate * grad / np.sqrt(wide)
        step = step + rate * g_step / np.sqrt(sq_step)
    return Model({f: w[i] for f, i in index.items()}, step)
