"""Operator 6: personal data by patterns and a linear-chain conditional random field.

Base patterns find well-formed values. The chain, fitted to a small labelled table of
sentences, adds spans of the same kinds that the patterns miss: phone numbers without a
country code, obfuscated e-mail addresses, card numbers with other separators. Its features
are word shapes, never the words' digits.

A token can have a label other than O only if it has a digit or ``@`` or is one of a few
joining words; all others are O for certain, which parts a document's chain into short runs
that are decoded exactly, in numpy batches.

Defined results: null text counts as empty and has no spans; texts of any length are searched
whole, in time that grows no faster than they do, digit runs of any length included; null ids, ties and repeated
rows pass through one to one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import crf
from .common import id_and_text, text_slices

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: An e-mail address is a run of LOCAL characters, "@" and a DOMAIN; an IP address four parts of a DOTTED run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Digits that a span added as a card or phone number must have, and an address's parts.
CARD_DIGITS, PHONE_DIGITS = range(13, 20), range(9, 16)

#: The small labelled table. [kind:value] marks a value; # stands for any digit.
LABELLED = [
    "call me at [phone:(###) ###-####] tonight", "call [phone:###-###-####] for details", "phone: [phone:###.###.####]",
    "tel [phone:### ### ####] or visit us", "my number is [phone:(###) ###-####]", "mobile [phone:0## #### ####]",
    "text [phone:###-###-####] now", "fax [phone:(###) ### ####] office", "reach us on [phone:0### ######]",
    "please dial [phone:(###)###-####] before noon", "contact: [phone:###-###-####], ask for help",
    "mail [email:john at example dot com] please", "write to [email:mary.k at mail dot example dot org]",
    "e-mail [email:joe (at) example (dot) com] today", "email: [email:ann [at] corp [dot] net]",
    "send it to [email:sales(at)shop.example.com] soon", "contact [email:bob@localhost] for access",
    "reply to [email:x.y (at) site.net]", "ping [email:root@server] at night",
    "card [card:####.####.####.####] expires soon", "pay with [card:####/####/####/####] now",
    "credit card: [card:#### #### #### ####]", "my visa is [card:####_####_####_####]", "card no [card:####.####.####.####]",
    "card number [card:####-####-####-###] was used", "the amex [card:####/######/#####] is lost",
    "host [ip:###.##.#.#:####] is down", "server at [ip:##.##.##.##/##] answers", "ip [ip:###.###.#.##] logged in",
    "connect to [ip:10-0-0-1] first", "address [ip:###.###.###.#:##] blocked",
    "in 2024 we sold 15 units", "the date is 2024-05-12 today", "on 12/05/2024 at 10:30", "version 1.2.3 was released",
    "build 10.4.22.1187 of the tool", "it costs $ 1,299.00 now", "chapter 12 page 345", "order 123456 has shipped",
    "isbn 978-3-16-148410-0 in print", "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "id 550e8400-e29b-41d4-a716-446655440000",
    "meet at noon and dot the i", "we looked at example files", "the sum of 12 and 30 is 42", "from 1990 to 1995 only",
    "ratio 3.14159 of 2.71828", "see rfc 2616 section 14", "population 1 234 567 in 2010", "score 10-12 after 90 minutes",
    "call 3 people at 10", "phone model 5500 has 12 keys", "card 12 of 52", "ip version 6", "email 20 people at once",
    "serial ABC-1234-XYZ on the back", "hash 9f86d081884c7d659a2feaa0c55ad015", "room 101 and floor 12", "at 10 dot 5 percent",
    "phone 12 of 30", "license number 12-345", "figure 2.1.3 shows 4 parts", "the year 1999", "numbers 1 2 3 4 5 6 7 8",
    "value 123-45 in table 6", "run 1.0.0.1 release notes", "4534254f83b7e27b3670756d7cab6da61ccfcea9 is a commit",
]
#: Words that can stand inside an obfuscated address, with a name on either side.
JOINING = {"at", "dot", "(at)", "(dot)", "[at]", "[dot]"}
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
TOKEN = re.compile(r"\S+")
TAGGABLE = re.compile(r"[0-9@]|[(\[][aA][tT][)\]]")
#: A word "at", with the two words after it.
AT_WORD = re.compile(r"(?<!\S)(?:[aA][tT]|\([aA][tT]\)|\[[aA][tT]\])(?=\s+(\S+)(?:\s+(\S+))?)")
AT, DOT = frozenset(("at", "(at)", "[at]")), frozenset(("dot", "(dot)", "[dot]"))
VARIANTS = 6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each "@" outward in linear time."""
    out = []
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        low = m.end() if m else at + 1
        if m:
            out.append((start, low))
        at = text.find("@", low)
    return out


def small(part: str) -> bool:
    """Whether a run of digits, of any length, is a number up to 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def addresses(text: str) -> list[tuple[int, int]]:
    """Matches of the IP pattern with small parts: each next four parts of a dotted run."""
    out = []
    for m in DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        at = m.start()
        parts = run.split(".")
        for k in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[k : k + 4])) + 3
            if all(map(small, parts[k : k + 4])):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns' matches that pass their checks."""
    out: list[tuple[int, int, int]] = [(0, *s) for s in emails(text)]
    if DIGIT.search(text) is None:
        return out
    out += [(1, *s) for s in addresses(text)]
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def shape(word: str) -> str:
    return re.sub(r"[0-9]", "d", re.sub(r"[^\W\d_]", "x", word))


def token_features(words: list[str], i: int) -> list[str]:
    """Shape features of a token, and those of its neighbours."""
    out = ["bias"]
    for k in (-2, -1, 0, 1, 2):
        j = i + k
        if not 0 <= j < len(words):
            out.append(f"{k}:none")
            continue
        w = words[j].strip(",;!?\"'").rstrip(".:")
        s = shape(w)
        out.append(f"{k}:s=" + re.sub(r"x+", "x", re.sub(r"d{5,}", "ddddd+", s)))
        low = w.lower()
        if low in JOINING or not re.search(r"[0-9@]", w):
            out.append(f"{k}:w=" + low)
        if k == 0:
            n = sum(c.isdigit() for c in w)
            out += [f"n={min(n, 20)}", f"at={'@' in w}", f"alpha={any(c.isalpha() for c in w)}", f"dots={min(w.count('.'), 4)}"]
    return out


def _address_follows(after: list[str]) -> bool:
    """Whether the two words after an "at" can go on with an address."""
    return any(x.lower() in DOT or "." in x.rstrip(".,") for x in after)


def may_be_tagged(text: str) -> bool:
    """Whether ``can_be_tagged`` is true of any word; says so without splitting the text."""
    if TAGGABLE.search(text):
        return True
    return any(_address_follows([x for x in m.groups() if x]) for m in AT_WORD.finditer(text))


def can_be_tagged(words: list[str]) -> np.ndarray:
    """Tokens that may have a label other than O.

    Around an "at" these are the name before it and the parts after it, as far as "dot" and
    names alternate on either side, and five words in any case.
    """
    on = np.fromiter((TAGGABLE.search(w) is not None for w in words), bool, len(words))
    done = 0
    for i, w in enumerate(words):
        if w.lower() not in AT or not _address_follows(words[i + 1 : i + 3]):
            continue
        low = max(0, i - 1)
        while low - 2 >= done and words[low - 1].lower() in DOT:
            low -= 2
        high = i + 1
        while high + 2 < len(words) and words[high + 1].lower() in DOT:
            high += 2
        done = max(i, high)
        on[low : max(high + 1, i + 6)] = True
    return on


def _fill(pattern: str, rng: np.random.Generator) -> str:
    return re.sub("#", lambda _: str(rng.integers(0, 10)), pattern)


@lru_cache(maxsize=1)
def fitted() -> crf.Model:
    """The chain fitted to the labelled table, a few digit variants of each sentence."""
    rng = np.random.default_rng(11)
    feats: list[list[str]] = []
    labels: list[int] = []
    lengths: list[int] = []
    for sentence in LABELLED * VARIANTS:
        words: list[str] = []
        tags: list[int] = []
        for bit in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[at\]|\[dot\])*\])", _fill(sentence, rng)):
            m = re.fullmatch(r"\[(email|ip|card|phone):(.*)\]", bit)
            for k, w in enumerate((m[2] if m else bit).split()):
                words.append(w)
                tags.append(TAGS.index(("B-" if k == 0 else "I-") + m[1]) if m else 0)
        feats += [token_features(words, i) for i in range(len(words))]
        labels += tags
        lengths.append(len(words))
    return crf.fit(feats, np.array(labels, np.int64), lengths, len(TAGS), min_count=2, rounds=80, l2=0.05)


def _plausible(kind: int, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    if kind == 0:
        return "@" in value or re.search(r"\bat\b", value, re.I) is not None
    if kind == 1:
        parts = re.findall(r"[0-9]+", value)
        return len(parts) >= 4 and all(map(small, parts[:4]))
    if any(c.isalpha() for c in value):
        return False
    return digits in (CARD_DIGITS if kind == 2 else PHONE_DIGITS)


def added_spans(texts: list[str], model: crf.Model, bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans of the chain that are plausible and touch no base span, for a batch of texts."""
    feats: list[np.ndarray] = []
    lengths: list[int] = []
    where: list[tuple[int, int, int]] = []
    for n, text in enumerate(texts):
        if not may_be_tagged(text):
            continue
        found = list(TOKEN.finditer(text))
        words = [m.group() for m in found]
        on = can_be_tagged(words)
        at = np.flatnonzero(on)
        if not len(at):
            continue
        for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
            # An O on either side of a run is certain; it is where the run's chain ends.
            near = words[max(0, run[0] - 3) : run[-1] + 4]
            shift = run[0] - max(0, run[0] - 3)
            feats += [model.emission(token_features(near, shift + k)) for k in range(len(run))]
            lengths.append(len(run))
            where += [(n, *found[i].span()) for i in run]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not lengths:
        return out
    emit = np.array(feats)
    first = np.cumsum(lengths) - lengths
    emit[first] += model.step[0]
    last = first + np.array(lengths) - 1
    emit[last] += model.step[:, 0]
    at, mask = crf.grid(lengths)
    tags = np.zeros(len(where), np.int8)
    tags[at[mask]] = crf.viterbi(emit[at], mask, model.step)[mask]
    i = 0
    taken = [sorted((s, e) for _, s, e in base) for base in bases]
    furthest = [list(itertools.accumulate((e for _, e in t), max)) for t in taken]
    starts = set(first.tolist())
    while i < len(tags):
        t = tags[i]
        if t == 0:
            i += 1
            continue
        kind, j = (t - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 * kind + 2 and j not in starts:
            j += 1
        n, a = where[i][:2]
        b = where[j - 1][2]
        value = texts[n][a:b]
        a += len(value) - len(value.lstrip(",;!?\"'.:"))
        b -= len(value) - len(value.rstrip(",;!?\"'.:"))
        k = bisect.bisect_left(taken[n], (b,))  # spans that begin before b
        clear = k == 0 or furthest[n][k - 1] <= a
        if a < b and clear and _plausible(kind, texts[n][a:b]):
            out[n].append((int(kind), a, b))
        i = j
    return out


def _listed(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, and all spans as ``kind:start:end``."""
    model = fitted()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            bases = [base_spans(t) for t in texts]
            more = added_spans(texts, model, bases)
            listed = [_listed(b) for b in bases]
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *counts,
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
                    pa.array([_listed([*b, *m]) for b, m in zip(bases, more, strict=True)]),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return id_and_text(docs).mapInArrow(run, schema)
