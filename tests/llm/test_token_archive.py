import heapq
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera.llm import queries as Q
from tessera.llm import token_archive as A
from tessera.llm import tokens
from tessera.session import shared_dir

from .conftest import frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(Q.tokenizer_path())


def huffman_total(counts):
    heap = list(counts)
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total or sum(counts)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_lengths_are_optimal_without_a_limit(n):
    counts = np.random.default_rng(n).zipf(1.5, n).clip(1, 10**6)
    bits = A.code_lengths(counts, 40)
    assert int((counts * bits).sum()) == huffman_total(counts.tolist())


def test_lengths_keep_the_limit():
    counts = np.array([2**i for i in range(30)])
    for limit in (5, 6, 8, 16):
        bits = A.code_lengths(counts, limit)
        assert bits.max() <= limit and (0.5 ** bits).sum() <= 1
    with pytest.raises(ValueError):
        A.code_lengths(np.ones(9), 3)


def test_code_round_trip_from_every_lane():
    rng = np.random.default_rng(1)
    for n in (1, 2, 700):
        ids = np.sort(rng.choice(60_000, n, replace=False))
        code = A.Code(ids, A.code_lengths(rng.zipf(1.3, n).clip(1, 10**6)))
        text = rng.choice(ids, 3000)
        payload, lanes = code.encode(text)
        steps = np.minimum(A.LANE, len(text) - A.LANE * np.arange(len(lanes)))
        data = np.frombuffer(payload, np.uint8)
        assert (code.decode(data, lanes, steps) == text).all()
        # a single lane alone
        k = len(lanes) - 1
        assert (code.decode(data, lanes[k:], steps[k:]) == text[k * A.LANE:]).all()


def test_cached_encoding_equals_the_library(tokenizer):
    rng = random.Random(1)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "ß", "日本", "🙂", "'s", "don't", "12", "3.5", "!!", "<|endoftext|>", " ", "　", "\x1c",
             "\x85", "x|", ".\n", "#", "word.", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(5000)]
    enc = tokens.Encoder(Q.tokenizer_path(), "<u2", cache_bytes=200_000)
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u2").tolist() for b in enc.encode(texts)] == expected


def expected_rows(tokenizer, rows):
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def read(spark, docs, **options):
    path = shared_dir(spark, "test-archive")
    A.write_token_archive(docs, path, Q.tokenizer_path(), 2, **options)
    return [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in A.read_token_archive(spark, path).collect()]


def test_archive_round_trip(spark, tokenizer):
    rng = random.Random(2)
    rows = [(d, " ".join(rng.choice(["the", "and", "Zebra", "é!", "12"]) for _ in range(rng.randrange(200)))) for d in rng.sample(range(9999), 90)]
    got = read(spark, frame(spark, rows).repartition(6), block=300)
    assert sorted(got) == expected_rows(tokenizer, rows)


def test_odd_rows(spark, odd, odd_rows, none, tokenizer):
    got = read(spark, odd)
    expected = expected_rows(tokenizer, odd_rows)
    # rows that share an id may follow each other in any order
    key = lambda r: (str(r[0]), r[2], r[3])
    assert sorted(map(key, got)) == sorted(map(key, expected))
    ends = sorted((r[1], r[1] + r[2]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert read(spark, none) == []


def test_spaces_are_judged_as_the_words_are_looked_up():
    """No text is searched for odd spaces beforehand, and every mixture of spaces has the library's ids."""
    rng = random.Random(12)
    letters = "ab  .,\n\t\r\u00a0\u2003\u00e9\u4e2d1'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(3000)]
    enc = tokens.Encoder(Q.tokenizer_path(), "<u2")
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    assert enc.encode_spaced(texts) == [enc.whole(" " + t) for t in texts]
    with pytest.raises(tokens._Odd):
        enc.spaced["\tx"]


def test_decoding_needs_few_bytes_for_an_id():
    """Sixteen blocks of 65536 ids at once, read back exactly, in less than 24 bytes for an id."""
    rng = np.random.default_rng(3)
    blocks = [(rng.zipf(1.3, A.BLOCK + int(rng.integers(300))) % 5000).astype(np.int64) for _ in range(16)]
    counts = np.bincount(np.concatenate(blocks))
    ids = np.flatnonzero(counts)
    code = A.Code(ids, A.code_lengths(counts[ids]))
    parts = [code.encode(x) for x in blocks]
    base = np.cumsum([0] + [len(p) for p, _ in parts])
    data = np.frombuffer(b"".join(p for p, _ in parts), np.uint8)
    at = np.concatenate([lanes + 8 * b for (_, lanes), b in zip(parts, base.tolist(), strict=False)])
    steps = np.concatenate([np.minimum(A.LANE, len(x) - A.LANE * np.arange(len(lanes))) for x, (_, lanes) in zip(blocks, parts, strict=True)])
    tracemalloc.start()
    got = code.decode(data, at, steps)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == np.concatenate(blocks)).all()
    assert peak < 24 * len(got)
