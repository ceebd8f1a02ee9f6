import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import packing as P
from tessera.llm import queries as Q

from .conftest import frame


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(Q.tokenizer_path())


def sequential(lengths, capacity):
    """Best-two-fit one bin at a time."""
    left = sorted(lengths, reverse=True)
    bins = []
    while left:
        made, gap = [], capacity
        for n in list(left):
            if n <= gap:
                made.append(n)
                left.remove(n)
                gap -= n
        if gap and len(made) > 1:
            small = min(made)
            room = gap + small
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1:] if small < a + b <= room]
            if pairs:
                _, a, b = max(pairs)
                made.remove(small)
                left = sorted([*left, small], reverse=True)
                left.remove(a)
                left.remove(b)
                made += [a, b]
        bins.append(sorted(made))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_histogram_packs_like_one_bin_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 24, 50])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 120))]
    made = P.best_two_fit({n: lengths.count(n) for n in set(lengths)}, capacity)
    bins = [sorted(n for n, k in used.items() for _ in range(k)) for used, count in made for _ in range(count)]
    assert sorted(n for b in bins for n in b) == sorted(lengths)
    assert all(sum(b) <= capacity for b in bins)
    expected = sequential(lengths, capacity)
    assert abs(len(bins) - len(expected)) <= 1  # pairs of equal sums may be told apart otherwise
    assert len(bins) >= -(-sum(lengths) // capacity)


def test_patterns_do_not_grow_with_the_pieces():
    few = P.best_two_fit({n: 3 for n in range(1, 1025)}, 1024)
    many = P.best_two_fit({n: 3_000_000 for n in range(1, 1025)}, 1024)
    assert len(many) < 2 * len(few) + 2000
    assert sum(b for _, b in many) * 1024 < 1.01 * sum(3_000_000 * n for n in range(1, 1025))


def check(rows, docs, tokenizer, capacity, end=2):
    texts = defaultdict(list)
    for d, t in docs:
        texts[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, end])
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts)
    for d, found in pieces.items():
        n = len(texts[d][0])
        if len({len(t) for t in texts[d]}) > 1:
            continue  # texts that share an id
        cut = (n - 1) % capacity + 1
        expected = [(0, 0, cut), *((k + 1, a, capacity) for k, a in enumerate(range(cut, n, capacity)))]
        assert sorted((r.piece, r.start, r.length) for r in found) == sorted(expected * len(texts[d]))
        for r in found:
            assert np.frombuffer(r.ids, "<u4").tolist() in [t[r.start: r.start + r.length] for t in texts[d]]
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:], strict=False)) and sum(x[1] for x in b) <= capacity
    return len(bins)


def test_pieces_and_places(spark, tokenizer):
    rng = random.Random(1)
    docs = [(d, " ".join(rng.choice(["the", "Zebra", "é!", "12"]) for _ in range(int(rng.paretovariate(0.8))))) for d in range(300)]
    docs = [(d, t[:4000]) for d, t in docs]
    rows = P.pack(frame(spark, docs).repartition(7), Q.tokenizer_path(), 2, capacity=64).collect()
    n = check(rows, docs, tokenizer, 64)
    assert n <= 1.03 * sum(r.length for r in rows) / 64 + 1


def test_shuffled_shifts(spark, tokenizer, monkeypatch):
    """Beyond the broadcast bound the shifts are joined by shuffle."""
    from tessera.llm import common
    monkeypatch.setattr(common.bounded, "__defaults__", (0,))
    docs = [(d, "the same words") for d in range(40)]
    assert check(P.pack(frame(spark, docs).repartition(5), Q.tokenizer_path(), 2, capacity=8).collect(), docs, tokenizer, 8) == 20


def test_odd_rows(spark, odd, odd_rows, none, tokenizer):
    rows = P.pack(odd, Q.tokenizer_path(), 2).collect()
    check(rows, odd_rows, tokenizer, 1024)
    assert P.pack(none, Q.tokenizer_path(), 2).count() == 0
