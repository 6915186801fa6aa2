"""BagMinHash signatures of weighted sets.

Every (shingle, weight) plane carries a Poisson process over time and weight, the same in
every document. A document sees the points below its own weights; slot ``s`` of its
signature is the earliest visible point that was dealt to ``s``. Weights are discretised by
occurrences and the weight axis is split in dyadic strips [0,1), [1,2), [2,4), ...; a strip
of width r is a process of rate r whose points are thinned by their weight coordinate, so
only the strips that reach below a weight are ever generated. The chance that two documents
agree in a slot is their weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from .shingles import mix

_STEP = 0x9E3779B97F4A7C15
_LEVEL = 0xD1B54A32D192ED03
#: exp(-SLACK) of the documents need a second, longer look at their processes.
SLACK = 3.0


def _times(k: int, step: int) -> np.uint64:
    return np.uint64(k * step & 0xFFFFFFFFFFFFFFFF)


def _points(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, until: np.ndarray, slots: int):
    """(document, slot, time, name) of all visible points up to each document's time ``until``."""
    levels = [(doc, shingle, weight, 0, 1.0, 0.0)]
    level, low = 1, 1
    while True:
        more = weight > low
        if not more.any():
            break
        levels.append((doc[more], shingle[more], weight[more], level, float(low), float(low)))
        level, low = level + 1, 2 * low
    out = []
    for d, s, w, lv, rate, base in levels:
        state = mix(s + _times(lv + 1, _LEVEL))
        time = np.zeros(len(d))
        k = 0
        while len(d):
            k += 1
            name = mix(state + _times(k, _STEP))
            time = time - np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = time <= until[d]
            d, w, state, time, name = d[on], w[on], state[on], time[on], name[on]
            other = mix(name + np.uint64(_LEVEL))
            if lv:
                y = base + rate * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32)
                seen = y < w
                slot = (other[seen] & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
                out.append((d[seen], slot.astype(np.int64), time[seen], name[seen]))
            else:
                slot = (other & np.uint64(0xFFFFFFFF)) % np.uint64(slots)
                out.append((d, slot.astype(np.int64), time, name))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """One row of ``slots`` 64-bit names for each non-empty bag (shingles, counts)."""
    n = len(bags)
    sig = np.zeros((n, slots), np.uint64)
    todo = np.array([i for i, b in enumerate(bags) if len(b[0])], np.int64)
    total = np.array([b[1].sum() for b in bags], np.float64)
    look = np.log(slots) + SLACK
    while len(todo):
        doc = np.repeat(todo, [len(bags[i][0]) for i in todo])
        shingle = np.concatenate([bags[i][0] for i in todo])
        weight = np.concatenate([bags[i][1] for i in todo])
        until = slots * look / np.maximum(total, 1)
        d, slot, time, name = _points(doc, shingle, weight, until, slots)
        order = np.argsort(-time, kind="stable")
        filled = np.zeros((n, slots), bool)
        filled[d, slot] = True
        whole = filled.all(axis=1)
        good = order[whole[d[order]]]
        sig[d[good], slot[good]] = name[good]  # later writes, that is earlier times, win
        todo = todo[~whole[todo]]
        look *= 2
    return sig


def bands(sig: np.ndarray, n_bands: int) -> np.ndarray:
    """A 64-bit key for each band; the band's number is part of the key."""
    rows = sig.shape[1] // n_bands
    cut = sig.reshape(len(sig), n_bands, rows)
    key = np.broadcast_to((np.arange(n_bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(_LEVEL), cut.shape[:2])
    for k in range(rows):
        key = mix(key + np.uint64(_STEP) + cut[:, :, k])
    return key
