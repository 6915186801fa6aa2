"""Token ids of whole texts with a public tokenizer file, at the speed of a word cache.

The byte-level pre-tokeniser never lets a token cross a single blank (it only leads a
token) or a single newline before a word. So a text whose only white space is single blanks
and single newlines can be encoded chunk by chunk, and equal chunks share their ids. Any
other text goes to the tokenizer as a whole.

Chunks are found, and counted once for a batch, in Arrow; those that are new go to the
tokenizer many at a time, as one text that its leading blanks part again.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Bytes of text that are encoded at once; a worker's memory grows by some forty bytes for each.
SLICE = 1_000_000
#: Bytes of chunks and ids that a worker keeps between batches, and what a chunk costs besides its letters.
CACHE_BYTES, ENTRY_BYTES = 40_000_000, 180
#: New chunks that go to the tokenizer as one text.
JOINED = 50
#: Characters that the tokenizer takes at a time; it needs some fifty bytes for each until their ids are copied.
AT_ONCE = 100_000
#: Chunks that are marked in the cache: one that needs its whole text encoded, and one that is new.
ODD, NEW = -1, -2
#: Bits by which a chunk is known to have been seen before; only then is it worth keeping.
SEEN = 1 << 22


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return name if os.path.sep in name else public_tokenizers.path(name)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size`` of each entry, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(start.max(initial=0))) < 1 << 30 else np.int64
    out = np.repeat((start - ends + size).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def _grouped(texts: list[str], limit: int) -> Iterator[list[str]]:
    """The texts in their order, in lists of about ``limit`` characters, whole texts only."""
    start = held = 0
    for i, n in enumerate(map(len, texts)):
        if held and held + n > limit:
            yield texts[start:i]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield texts[start:]


class ChunkEncoder:
    """Texts to ids equal to the tokenizer's own; keeps the ids of chunks, within ``CACHE_BYTES``.

    A chunk is what stands between two blanks. One that begins with ``\\n`` follows a newline,
    one with ``\\r`` begins a text; others follow a blank. ``\\r\\r`` is the end of a text.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        # In byte-level vocabularies these two letters stand for a blank and a newline.
        self.leads = np.array([n[:1] == "Ġ" or n == "Ċ" for n in names])
        # Such a pre-tokeniser makes one piece of a blank and ASCII letters, and changes the blank alone.
        self.parts = self.tokenizer.pre_tokenizer
        said = repr(self.parts)
        self.simple = said.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in said and self.tokenizer.normalizer is None
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {"\r\r": 0, "\r": 1}
        self.start, self.size = np.zeros(2, np.int64), np.array([1, 0], np.int64)
        self.flat = np.array([END_ID], np.uint32)
        self.seen = np.zeros(SEEN, bool)
        self.held = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the tokenizer's own results are large, and few of them are held at a time."""
        out: list[np.ndarray] = []
        for some in _grouped(texts, AT_ONCE):
            out += [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _fresh(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids) of chunks; the size of an odd one is ``ODD``."""
        simple = np.fromiter((c.isascii() and c.isalpha() for c in chunks), bool, len(chunks)) & self.simple
        words = [c for c, s in zip(chunks, simple, strict=True) if s]
        start, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        start[simple], size[simple], ids = self._words(words)
        other_start, size[~simple], other = self._others([c for c, s in zip(chunks, simple, strict=True) if not s])
        start[~simple] = other_start + len(ids)
        return start, size, np.append(ids, other)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of ASCII letters, which are pieces as they are, so that the tokenizer need not look for them."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.tokenizer.pre_tokenizer = WhitespaceSplit()
        try:
            ids = np.concatenate(self._whole(["Ġ" + " Ġ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]))
        finally:
            self.tokenizer.pre_tokenizer = self.parts
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(words):
            raise ValueError("the tokenizer is not a byte-level one that parts words at blanks")
        return at, np.diff(at, append=len(ids)), ids

    def _others(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        led = [" " + c if c[:1] not in ("\n", "\r") else "\n" + c[1:] for c in chunks]
        good = np.ones(len(chunks), bool)
        if "".join(led).split() != [c[1:] for c in led]:
            good[:] = [c[1:].split() == [c[1:]] for c in led]
            led = [c for c, g in zip(led, good, strict=True) if g]
        ids = self._whole(["".join(led[k : k + JOINED]) for k in range(0, len(led), JOINED)])
        ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        at = np.flatnonzero(self.leads[ids])
        if len(at) != len(led) or (led and at[0]):
            raise ValueError("the tokenizer is not a byte-level one that parts words at blanks")
        # The newline before the first chunk of a text was only there to part it from others.
        first = np.fromiter((c[:1] == "\r" for c in chunks), np.int64, len(chunks))[good]
        start, size = np.zeros(len(chunks), np.int64), np.full(len(chunks), ODD, np.int64)
        start[good] = at + first
        size[good] = np.diff(np.append(at, len(ids))) - first
        return start, size, ids

    def _known(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, ids) of all chunks of a batch; those that come a second time are kept."""
        slot = np.fromiter(map(self.slots.get, chunks, repeat(NEW)), np.int64, len(chunks))
        new = np.flatnonzero(slot == NEW)
        fresh = [chunks[i] for i in new]
        start, size, ids = self._fresh(fresh)
        base = len(self.flat)
        name = np.fromiter(map(hash, fresh), np.int64, len(fresh)) & (SEEN - 1)
        keep = np.flatnonzero(self.seen[name])
        self.seen[name] = True
        all_start, all_size = self.start[slot], self.size[slot]
        all_start[new], all_size[new] = start + base, size
        flat = np.append(self.flat, ids)
        if len(keep):
            kept = [fresh[i] for i in keep]
            self.slots.update(zip(kept, range(len(self.start), len(self.start) + len(kept)), strict=True))
            n = np.maximum(size[keep], 0)
            self.flat = np.append(self.flat, ids[_spread(start[keep], n)])
            self.start = np.append(self.start, base + np.cumsum(n) - n)
            self.size = np.append(self.size, size[keep])
            self.held += sum(map(len, kept)) + ENTRY_BYTES * len(kept) + 4 * int(n.sum())
        if self.held > CACHE_BYTES:
            self._forget(chunks, slot)
        return all_start, all_size, flat

    def _forget(self, chunks: list[str], slot: np.ndarray) -> None:
        """Keeps of the cache what the last batch took from it, or nothing if that is too much by itself."""
        used = [(c, s) for c, s in zip(chunks, slot.tolist(), strict=True) if s > 1]
        at = np.array([s for _, s in used], np.int64)
        start, size, flat = self.start[at], self.size[at], self.flat
        self.clear()
        n = np.maximum(size, 0)
        held = sum(len(c) for c, _ in used) + ENTRY_BYTES * len(used) + 4 * int(n.sum())
        if held <= CACHE_BYTES // 2:
            self.slots.update((c, k) for k, (c, _) in enumerate(used, 2))
            self.start = np.append(self.start, 1 + np.cumsum(n) - n)
            self.flat = np.append(self.flat, flat[_spread(start, n)])
            self.size = np.append(self.size, size)
            self.held = held

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none of them null), each with its end id, and where each begins; one more is the end."""
        led = pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), " \r\r", "")
        split = pc.split_pattern(led, " ")
        first = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        del led, split
        start, size, flat = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        whole = pc.match_substring(texts, "\r").to_numpy(zero_copy_only=False).astype(bool)
        if (size == ODD).any():
            whole[np.searchsorted(first, np.flatnonzero(size[at] == ODD), "right") - 1] = True
        if whole.any():
            # Such a text is one chunk of its own, and its other chunks are empty.
            rows = np.flatnonzero(whole)
            ids = self._whole(texts.take(pa.array(rows)).to_pylist())
            n = np.array([len(x) + 1 for x in ids], np.int64)
            at = np.where(np.repeat(whole, np.diff(first)), len(start), at)
            at[first[rows]] = len(start) + 1 + np.arange(len(rows))
            start = np.concatenate([start, [0], len(flat) + np.cumsum(n) - n])
            size = np.concatenate([size, [0], n])
            flat = np.concatenate([flat, *(np.append(x, np.uint32(END_ID)) for x in ids)])
        each = size[at]
        return flat[_spread(start[at], each)], np.append(0, np.cumsum(each))[first]


@lru_cache(maxsize=1)
def encoder(path: str) -> ChunkEncoder:
    """The encoder of a worker process."""
    return ChunkEncoder(path)
