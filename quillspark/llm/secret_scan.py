"""Operator 9: secret scan; a random forest removes false findings.

Patterns propose candidates (assignments to credential names, known key formats, long mixed
tokens with digits). A forest fitted to a table of labelled findings looks at each
candidate's length, character transitions, dictionary coverage, where it comes from (its
path) and the words beside it, and keeps the likely secrets.

Defined results: null text counts as empty and has no findings; texts of any length are
scanned whole, in time that grows no faster than they do; a null path is an empty one; null ids, ties and repeated rows pass through one to one; an empty table gives no rows;
other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest
from .common import text_slices

KEEP_AT = 0.5
MASK = "[SECRET]"
FINDINGS = 2400

#: Names of credentials, formats of known keys, and the long tokens looked at.
NAMES = r"token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credentials?"
ASSIGNED = re.compile(rf"(?i)(?:{NAMES})[\"']?\s*(?:=>|:=|[:=])\s*(?:bearer\s+)?[\"']?([^\s\"',;<>]{{6,}})")
KNOWN = re.compile(
    r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|"
    r"AIza[0-9A-Za-z_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|"
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"
)
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: What a text must have (in lower case) for any of the three to match, if it has no digit.
HINTS = ("token", "secret", "passw", "pwd", "key", "credential", "xox", "sk-", "eyj", "aiza", "gh")
DIGIT = re.compile(r"[0-9]")
#: Words that make a neighbouring token harmless or telling, and common words.
HARMLESS = re.compile(r"(?i)\b(?:commit|sha-?\d*|md5|hash|checksum|digest|uuid|guid|id|isbn|revision|build|example|sample|dummy|placeholder|etag|doi)\b")
TELLING = re.compile(rf"(?i)(?:{NAMES}|bearer|authorization|login|key)\b")
FILLER = re.compile(r"(?i)(?:x{4,}|\*{3,}|\.{3,}|your|example|sample|dummy|change ?me|placeholder|insert|todo|test|none|null|redacted|abc|1234|<|\$\{)")
COMMON = (
    "the and for you with that this from have not are was your change example password secret token user admin "
    "test demo value name here data file home local server config sample dummy string none null true false insert "
    "account service manager public private access simple letter number country market general development"
).split()
PATHS = re.compile(r"(?i)test|example|sample|doc|fixture|mock|readme")


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(rule, start, end) of non-overlapping candidates: 0 assigned, 1 known, 2 long; earlier rules first."""
    if DIGIT.search(text) is None:
        low = text.lower()
        if not any(h in low for h in HINTS):
            return []
    found = [(1, *m.span()) for m in KNOWN.finditer(text)]
    found += [(0, *m.span(1)) for m in ASSIGNED.finditer(text)]
    found += [(2, *m.span()) for m in LONG.finditer(text) if re.search(r"[0-9]", m.group())]
    out: list[tuple[int, int, int]] = []  # (start, end, rule); they never overlap, so neighbours tell
    for rule, a, b in sorted(found, key=lambda c: (c[0] == 2, c[1], -c[2])):
        k = bisect.bisect_left(out, (a, b))
        if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b, rule))
    return [(rule, a, b) for a, b, rule in out]


def _classes(value: str) -> str:
    return re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", re.sub(r"[^A-Za-z0-9]", "-", value))))


def features(text: str, found: tuple[int, int, int], path: str) -> list[float]:
    rule, a, b = found
    value = text[a:b]
    n = len(value)
    kinds = _classes(value)
    moves = sum(x != y for x, y in zip(kinds, kinds[1:], strict=False))
    low = value.lower()
    covered = sum(len(w) * low.count(w) for w in COMMON)
    runs = [len(r) for r in re.findall(r"[a-zA-Z]+", value)]
    before = text[max(0, a - 40) : a].split("\n")[-1]
    after = text[b : b + 20].split("\n")[0]
    share = np.array([value.count(c) for c in set(value)]) / n
    return [
        float(rule == 0),
        float(rule == 1),
        n,
        moves / n,
        kinds.count("0") / n,
        kinds.count("A") / n,
        kinds.count("-") / n,
        float(-(share * np.log2(share)).sum()),
        min(1.0, covered / n),
        max(runs, default=0) / n,
        sum(c in "aeiouAEIOU" for c in value) / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
        float(value.count("-") + value.count("_") + value.count("/")),
        float(bool(FILLER.search(value))),
        float(bool(HARMLESS.search(before))),
        float(bool(TELLING.search(before))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'" and after[:1] in "\"'" and after != "" and before != ""),
        float(bool(PATHS.search(path))),
        float(n % 8 == 0),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = 19) -> list[tuple[str, tuple[int, int], str, int]]:
    """(text, span, path, label): the labelled table, made by rule from templates of findings."""
    rng = np.random.default_rng(seed)
    hexa, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda s, k: "".join(rng.choice(list(s), k))
    one = lambda xs: xs[int(rng.integers(len(xs)))]
    name = lambda: one(["token", "secret", "api_key", "password", "access_key", "API_KEY", "Secret", "apikey", "pwd"])
    words = lambda k: one(["-", "_", ""]).join(one([*COMMON, "tion", "er", "ing"]) for _ in range(k))
    secret = [
        lambda: (f"{name()} = \"", pick(hexa, one([32, 40, 64])), "\""),
        lambda: (f"{name()}: ", pick(b62, int(rng.integers(16, 48))), ""),
        lambda: (f"{name()} = '", pick(b62 + "+/", int(rng.integers(20, 60))), "'"),
        lambda: (f"{name()}=", pick(b62 + "!@#%^", int(rng.integers(9, 20))), " x"),
        lambda: ("key ", "AKIA" + pick(b62[:26] + b62[52:], 16), " in use"),
        lambda: ("login with ", "ghp_" + pick(b62, 36), ""),
        lambda: ("Authorization: Bearer ", pick(b62, 40), ""),
        lambda: ("the key sk-", pick(b62, 40), " leaked"),
    ]
    plain = [
        lambda: (f"{one(['commit', 'sha1', 'md5', 'hash', 'checksum', 'revision', 'etag'])} {one(['', ': ', '= '])}", pick(hexa, one([32, 40, 64])), ""),
        lambda: (f"{one(['id', 'uuid', 'guid'])} ", "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), " seen"),
        lambda: (f"{name()} = \"", one(["your", "example", "change", "insert"]) + "_" + words(2) + "_here", "\""),
        lambda: (f"{name()}: ", "x" * int(rng.integers(8, 30)), ""),
        lambda: (f"{name()}=", one(["${", "$"]) + words(2).upper() + one(["}", ""]), ""),
        lambda: (f"the {name()}: ", words(int(rng.integers(1, 4))) or "value", " of things"),
        lambda: ("see ", words(5) + str(rng.integers(10, 99)) + "/" + words(3), " there"),
        lambda: ("number ", pick("0123456789", int(rng.integers(20, 30))), " is"),
        lambda: ("file ", "/usr/share/" + words(3) + "/" + words(2) + str(rng.integers(0, 9)), ""),
        lambda: ("", words(7) + str(rng.integers(0, 99)), " and"),
    ]
    out = []
    for k in range(n):
        make = one(secret if k % 2 else plain)
        lead, value, tail = make()
        lead = words(2) + " " + lead
        path = one(["src/app.py", "config/prod.yaml", "web", "src3", "src11"] + ([] if k % 2 else ["tests/data", "docs/example.md"]))
        out.append((lead + value + tail, (len(lead), len(lead) + len(value)), path, k % 2))
    return out


@lru_cache(maxsize=1)
def fitted() -> forest.Forest:
    """The forest of the labelled findings, with each finding's rule as the scan would see it."""
    x, y = [], []
    for text, (a, b), path, label in labelled_findings():
        rule = next((r for r, s, e in candidates(text) if s < b and a < e), 2)
        x.append(features(text, (rule, a, b), path))
        y.append(label)
    return forest.fit(np.array(x), np.array(y, float))


def secrets(texts: list[str], paths: list[str | None], model: forest.Forest, keep_at: float = KEEP_AT) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Number of candidates, and spans that the forest keeps, for each text."""
    found = [candidates(t) for t in texts]
    rows = [features(t, c, p or "") for t, cs, p in zip(texts, found, paths, strict=True) for c in cs]
    keep = iter((model.predict(np.array(rows)) >= keep_at) if rows else [])
    kept = [[(a, b) for _, a, b in cs if next(keep)] for cs in found]
    return [len(cs) for cs in found], kept


def scan(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, n_candidates, n_secrets and spans (``start:end`` of each secret) of every document."""
    model = fitted()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            n, kept = secrets(texts, part.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(n, pa.int64()),
                    pa.array([len(k) for k in kept], pa.int64()),
                    pa.array([",".join(f"{a}:{b}" for a, b in k) for k in kept]),
                ],
                names=["doc_id", "n_candidates", "n_secrets", "spans"],
            )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col(path_col).cast("string").alias("path"),
    )
    return rows.mapInArrow(run, "doc_id long, n_candidates long, n_secrets long, spans string")


def redact(docs: DataFrame, path_col: str = "source", mask: str = MASK) -> DataFrame:
    """The documents with every secret replaced by ``mask`` and ``n_chars`` (if there) brought up to date."""
    model = fitted()

    @F.arrow_udf("string")
    def masked(text: pa.Array, path: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text, path], names=["text", "path"])
        out = []
        for part, texts in text_slices([rows]):
            _, kept = secrets([t or "" for t in texts], part.column(1).to_pylist(), model)
            for i, spans in enumerate(kept):
                for a, b in reversed(spans):
                    texts[i] = texts[i][:a] + mask + texts[i][b:]
            out.append(pa.array(texts, pa.string()))
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    clean = docs.withColumn("text", masked(F.col("text").cast("string"), F.col(path_col).cast("string")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)
