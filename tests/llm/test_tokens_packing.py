from __future__ import annotations

import bisect
import itertools
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import id_files, packing, range_coder, tokens
from quillspark.llm.tokens import END_ID, ChunkEncoder, tokenizer_path

ODD = [
    "", " ", "a  b", "\n\n\nx", " lead", "trail ", "a\t b", "a\t \tb", "x y z", "\n", "don't we'll  go\n\n\n", "a \n b", "é\r\nb", "\x1c a b",
    "one, two. three", "one,, two.. end.", "5, 6. 7", "naïve, café.", "word.\nNext, line", "<|endoftext|> hi", "a\r, b", "x . y , z", "\r", "\r\r", "a \r\r b", "x\ny\nz", "a\xa0b c",
]


@pytest.fixture(scope="module")
def encoder():
    return ChunkEncoder(tokenizer_path())


def plain(encoder, text):
    return [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, END_ID]


def encoded(encoder, texts):
    ids, at = encoder.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_encoder_equals_tokenizer(encoder):
    for _ in range(3):  # new, seen, and kept
        assert encoded(encoder, ODD) == [plain(encoder, t) for t in ODD]
    assert encoded(encoder, []) == []


def test_encoder_keeps_a_bounded_cache(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 20_000)
    rng = np.random.default_rng(2)
    for _ in range(12):
        texts = [" ".join("w" + str(rng.integers(0, 400)) for _ in range(60)) + "." for _ in range(5)]
        assert encoded(encoder, texts) == [plain(encoder, t) for t in texts]
        assert encoder.held <= 20_000 and len(encoder.slots) < 200


def test_encoder_takes_very_long_texts(encoder):
    text = "ab cd\nef, " * 200_000 + "end"
    assert encoded(encoder, [text, "x", text + "  "]) == [plain(encoder, t) for t in (text, "x", text + "  ")]


def test_tokenizer_gets_few_characters_at_a_time(encoder, monkeypatch):
    """Its results take some fifty times the text, so that new words and odd texts go to it in small groups."""
    got = []

    class Tokenizer:
        def encode_batch_fast(self, texts, add_special_tokens):
            got.append(sum(map(len, texts)) - (len(texts[-1]) if texts else 0))
            return whole.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    whole = encoder.tokenizer
    monkeypatch.setattr(encoder, "tokenizer", Tokenizer())
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 500))) for _ in range(60)]
    texts += [f"a\t{'  '.join(map(str, rng.integers(0, 10**9, 500)))}" for _ in range(60)]
    ids, at = encoder.encode(pa.array(texts))
    monkeypatch.undo()
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [plain(encoder, t) for t in texts]
    assert max(got) <= 100_000 and packing.SLICE <= 1_000_000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab ,.\n\t 5é'!\r", max_size=20), max_size=5))
def test_encoder_property(texts):
    encoder = ChunkEncoder(tokenizer_path()) if not hasattr(test_encoder_property, "e") else test_encoder_property.e
    test_encoder_property.e = encoder
    assert encoded(encoder, texts) == [plain(encoder, t) for t in texts]


def best(lengths, capacity):
    """Fewest sequences, by trying every placement."""
    items = sorted(lengths, reverse=True)
    found = len(items)

    def place(i, bins):
        nonlocal found
        if len(bins) >= found:
            return
        if i == len(items):
            found = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return found


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_as_good_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 20, 9).tolist()
    histogram = {n: lengths.count(n) for n in set(lengths)}
    patterns = packing.plan(histogram, 20)
    used = sum(times for _, times in patterns)
    packed = sorted(itertools.chain.from_iterable([n] * times for pattern, times in patterns for n in pattern))
    assert packed == sorted(lengths)
    assert all(sum(pattern) <= 20 for pattern, _ in patterns)
    assert used == best(lengths, 20)


def test_plan_branches_beyond_the_first_dive():
    for lengths, capacity, fewest in (
        ([12, 12, 11, 11, 10, 9, 7, 7, 5, 4, 4, 4, 3], 20, 5),
        ([12, 12, 13, 13, 14, 14, 15, 18, 18, 20], 50, 3),
    ):
        patterns = packing.plan({n: lengths.count(n) for n in set(lengths)}, capacity)
        assert sorted(n for pattern, times in patterns for n in pattern * times) == sorted(lengths)
        assert all(sum(pattern) <= capacity for pattern, _ in patterns)
        assert sum(times for _, times in patterns) == fewest


def test_plan_is_near_the_bound_and_whole():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2049, 4000)
    histogram = dict(zip(*map(list, np.unique(lengths, return_counts=True)), strict=True))
    histogram = {int(k): int(v) for k, v in histogram.items()} | {509: 100_000}
    patterns = packing.plan(histogram)
    assert sum(t for _, t in patterns) <= 1.02 * packing.bound(histogram, 2048)
    assert packing.plan({}) == []


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else capacity) - n)
    return len(rooms)


@pytest.mark.parametrize(("low", "high", "n"), [(400, 1000, 300), (500, 900, 2000), (600, 1100, 5000), (1, 2048, 3000)])
def test_plan_is_never_worse_than_best_fit_decreasing(low, high, n):
    lengths = np.random.default_rng(low).integers(low, high + 1, n).tolist()
    histogram = {x: lengths.count(x) for x in set(lengths)}
    fewest = best_fit_decreasing(lengths, 2048)
    for patterns in (packing.best_fit(histogram), packing.plan(histogram)):
        assert sorted(x for p, times in patterns for x in p * times) == sorted(lengths)
        assert all(sum(p) <= 2048 for p, _ in patterns)
        assert sum(times for _, times in patterns) <= fewest


def test_dominated_fillings_go():
    assert packing.dominated((5, 3), (6, 3)) and packing.dominated((3, 3), (7,)) and packing.dominated((), (1,))
    assert not packing.dominated((6, 3), (5, 4)) and not packing.dominated((1,), ())
    assert packing.fillings(10, [2, 3, 5, 9], {2: 1, 3: 1, 5: 1, 9: 1}, every=True) == [(5, 3, 2), (9,)]


def test_ranks_in_parts_give_the_same_packing(spark, monkeypatch):
    """A length that many pieces share is ranked in several parts."""
    monkeypatch.setattr(packing, "ROWS_PER_RANK", 3)
    docs = spark.createDataFrame([(k % 5, "one two") for k in range(50)] + [(9, "word " * 2500)] * 3, "doc_id long, text string")
    got = packing.pack(docs).collect()
    assert len(got) == 56 and len({(r.sequence_id, r.offset) for r in got}) == 56
    assert all(r.offset + r.length <= 2048 for r in got)


ROWS = [(3, "a b"), (None, "q"), (1, None), (2, "word " * 9000), (2, "word " * 9000), (7, ""), (9, "x, y. z\n" * 50)]


def whole(encoder):
    return [(d, np.array(plain(encoder, t or ""), "<u4").tobytes()) for d, t in ROWS]


def test_pack_digest(spark, encoder):
    docs = spark.createDataFrame([(t, d, 1, 2) for d, t in ROWS], "text string, doc_id long, piece int, length long")
    got = packing.pack(docs, keep_ids=True).collect()
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    expected = []
    for doc, ids in whole(encoder):
        n = len(ids) // 4
        size, at, k = (n % 2048 or 2048) if n > 2048 else n, 0, 0
        while at < n:
            expected.append((doc, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
            at, k, size = at + size, k + 1, 2048
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(expected, key=key)
    assert len(by_sequence) == packing.bound({r: [x.length for x in got].count(r) for r in {x.length for x in got}}, 2048)
    assert packing.pack(docs.limit(0)).count() == 0


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 65536, n) for n in (0, 1, 5, 300)]
    blocks += [np.arange(8192) * 7 % 65536, rng.integers(0, 50, 8000), np.zeros(200, int), np.full(100, 65535), rng.integers(0, 3, 500), np.tile([1, 2, 3, 50256], 200)]
    coded = range_coder.encode(blocks)
    for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True):
        assert np.array_equal(a, b)
    assert len(coded[-1]) < 2 * len(blocks[-1]) / 2
    with pytest.raises(ValueError):
        range_coder.encode([np.array([65536])])
    alone = range_coder.encode([blocks[3]])[0]
    assert alone == coded[3]  # no block depends on its neighbours


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65535), max_size=30), max_size=4))
def test_range_coder_property(blocks):
    arrays = [np.array(b, np.int64) for b in blocks]
    decoded = range_coder.decode(range_coder.encode(arrays), [len(b) for b in blocks])
    assert [d.tolist() for d in decoded] == blocks


def test_ids_take_fewer_bits_than_plain_coders(encoder):
    """Fewer than zlib, and than the entropy of a block's own counts with its table of counts."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"]
    ids, _ = encoder.encode(docs.combine_chunks().fill_null(""))
    blocks = [ids[k : k + 8192] for k in range(0, 16 * 8192, 8192)]
    coded = range_coder.encode(blocks)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks]), strict=True))
    own = 8 * sum(map(len, coded))
    static = 0.0
    for b in blocks:
        names, n = np.unique(b, return_counts=True)
        static += -(n * np.log2(n / len(b))).sum() + 8 * len(zlib.compress(np.concatenate([np.diff(names, prepend=0), n]).astype("<u2").tobytes(), 9))
    assert own < 0.95 * static
    assert own < 0.95 * sum(8 * len(zlib.compress(b.astype("<u2").tobytes(), 9)) for b in blocks)


def test_blocks_take_little_time(encoder):
    """Both ways together take clearly less than the tokenizer needs for the texts."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")["text"]
    docs = docs.combine_chunks().fill_null("")
    began = time.process_time()
    for k in range(0, len(docs), 100):
        encoder.tokenizer.encode_batch_fast(docs[k : k + 100].to_pylist(), add_special_tokens=False)
    plain_time = time.process_time() - began
    ids, _ = encoder.encode(docs)
    blocks = [ids[k : k + 8192] for k in range(0, len(ids), 8192)]
    began = time.process_time()
    coded = range_coder.encode(blocks * 4)
    decoded = range_coder.decode(coded, [len(b) for b in blocks] * 4)
    took = (time.process_time() - began) / 4
    assert took < 0.7 * plain_time
    assert all(np.array_equal(a, b) for a, b in zip(blocks * 4, decoded, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_damaged_codes_end(seed):
    """Any damage ends in ids that differ or in an error that says so, never in a loop or in another error."""
    rng = np.random.default_rng(seed)
    blocks = [rng.integers(0, 65536, 400), np.arange(900) % 37, np.full(3, 9)]
    coded = range_coder.encode(blocks)
    for k in range(40):
        which, raw = k % 3, bytearray(coded[k % 3])
        raw[int(rng.integers(len(raw)))] ^= 1 << int(rng.integers(8))
        broken = [*coded]
        broken[which] = bytes(raw)
        try:
            found = range_coder.decode(broken, [len(b) for b in blocks])
        except ValueError as e:
            assert "checksum" in str(e)
            continue
        assert [len(f) for f in found] == [len(b) for b in blocks]
        assert all(np.array_equal(f, b) for i, (f, b) in enumerate(zip(found, blocks, strict=True)) if i != which)


def test_files_round_trip(spark, encoder, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    path = str(tmp_path / "ids")
    id_files.write(docs, path)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in id_files.read(spark, path).collect()))
    order = sorted(whole(encoder), key=lambda r: (-1 if r[0] is None else r[0]))
    at, expected = 0, []
    for doc, ids in order:
        expected.append((at, doc, len(ids) // 4, ids))
        at += len(ids) // 4
    assert got == expected
    digest = {(r.start, r.ids_crc32) for r in id_files.read(spark, path, digest=True).collect()}
    assert digest == {(s, zlib.crc32(ids)) for s, _, _, ids in expected}
    assert id_files.round_trip(docs.limit(0)).count() == 0


def test_crc_of_a_document_from_those_of_its_pieces():
    rng = np.random.default_rng(6)
    for k in range(30):
        raw = [rng.bytes(4 * int(n)) for n in rng.integers(0, 9000, k % 6)]
        assert id_files.joined_crc([zlib.crc32(r) for r in raw], [len(r) // 4 for r in raw]) == zlib.crc32(b"".join(raw))


def test_digests_take_one_decoding(spark, encoder, tmp_path):
    """Documents of one piece and of several come from the same decoded blocks."""
    path = str(tmp_path / "ids")
    texts = ["short", "ab cd\nef, " * 9000, "", "x y " * 5000, None]
    id_files.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    found = id_files.read(spark, path, digest=True)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    start = 0
    for doc, (row, text) in enumerate(zip(found.orderBy("doc_id").collect(), texts, strict=True)):
        ids = np.array(plain(encoder, text or ""), "<u4")
        assert tuple(row) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_no_small_part_is_left_over(monkeypatch):
    monkeypatch.setattr(id_files, "LANES", 8)
    for n in range(60):
        parts = list(id_files._even([[(k, 0, 0, 1, b"")] for k in range(n)]))
        assert [b[0][0] for p in parts for b in p] == list(range(n))
        assert n <= 8 or all(5 < len(p) <= 12 for p in parts)
        assert [size for _, size in id_files._spans(n)] == [] if not n else sum(size for _, size in id_files._spans(n)) == n


def test_words_with_signs_at_their_end(encoder):
    words = ["word.", "word,", "Word...", "a!?", "x$$$", "it's", "don't.", "e.g.", "1.", "b2,", "Ġ.", "é,", "zz'", "q)", "l.'s", "abc.,!?;:$&*%#", ".", "...", "a-b,"]
    texts = [" ".join(words), "\n".join(words), *words]
    for _ in range(3):
        assert encoded(encoder, texts) == [plain(encoder, t) for t in texts]


def test_damaged_block_is_found():
    _, (data,) = id_files._pack([[(1, 0, 0, 1, np.arange(50, dtype="<u4").tobytes())]], 0)
    broken = data[:-20] + bytes([data[-20] ^ 1]) + data[-19:]
    with pytest.raises(ValueError, match="checksum"):
        list(id_files._unpack([broken]))


def test_rows_without_an_id_are_dealt_over_the_files(spark, encoder, tmp_path):
    rows = [(None, f"text {k} of no id " * 3) for k in range(400)] + [(k, f"text {k}") for k in range(40)] + [(7, "text 7")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = str(tmp_path / "ids")
    id_files.write(docs, path)
    assert spark.read.parquet(path).select("file").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = id_files.read(spark, path, digest=True).orderBy("start").collect()
    assert len(got) == len(rows)
    ends = 0
    for r in got:
        assert r.start == ends
        ends += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
