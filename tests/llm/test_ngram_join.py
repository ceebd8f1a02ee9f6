import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import ngram_join as J

from .conftest import frame, words


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, n=4, num=85, den=100):
    sets = [(d, shingles(t, n)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    usable = [(d, s) for d, s in sets if d is not None and s]
    for i, (a, x) in enumerate(usable):
        for b, y in usable[:i]:
            both = len(x & y)
            if both * den >= (len(x) + len(y) - both) * num:
                u, v = top(a), top(b)
                parent[max(u, v)] = min(u, v)
    return sorted(((d, len(s), top(d) if d is not None else None) for d, s in sets), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def near_copies(rng, n_base=12, copies=9):
    rows = []
    for _ in range(n_base):
        base = words(rng, rng.choice([3, 6, 9, 15, 40, 90, 200]), 3000).split()
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, len(base) // 12])):
                k = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[k] = f"n{rng.randrange(10**6)}"
                else:
                    text[k:k] = [f"n{rng.randrange(10**6)}"]
            rows.append(" ".join(text))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 4, 85), (2, 5, 80)])
def test_join_equals_brute_force(spark, seed, n, num):
    rows = near_copies(random.Random(seed))
    expected = brute(rows, n, num)
    assert got(J.join(frame(spark, rows).repartition(5), n=n, num=num, den=100)) == expected
    assert sum(d != c for d, _, c in expected) > 30


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    """A bucket of many sets that the stars leave apart is compared in blocks."""
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = near_copies(random.Random(3), 3, 40)
    assert got(J.join(frame(spark, rows))) == brute(rows)


def one_bucket(sets):
    """The pairs that are left of a bucket of sets, each a component of its own."""
    import pyarrow as pa
    ids = pa.array(range(len(sets)), pa.int64())
    sketch = next(J._sketches(iter([pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "set"])]))).column(1)
    zero, size = pa.array([0] * len(sets), pa.int64()), pa.array([len(x) for x in sets], pa.int64())
    batch = pa.RecordBatch.from_arrays([zero, zero, zero, ids, ids, size, size, zero, sketch],
                                       names=["sig", "i", "j", "rep", "comp", "size", "c", "block", "sketch"])
    return {(r["a"], r["b"]) for b in J._cross(80, 100)(iter([batch])) for r in b.to_pylist()}


def similar(sets):
    found = set()
    for b, y in enumerate(sets):
        for a, x in enumerate(sets[:b]):
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                found.add((a, b))
    return found


def test_sets_a_little_too_different_are_not_paired():
    """A family of sets at a similarity of about 0.72, and some links among them."""
    rng = np.random.default_rng(11)
    base, sets = rng.integers(0, 2**63, 396, dtype=np.uint64), []
    for k in range(60):
        kept = base[rng.permutation(len(base))[:int(len(base) * 0.915)]] if k % 10 else base
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**63, len(base) - len(kept), dtype=np.uint64)])))
    links, left = similar(sets), one_bucket(sets)
    assert links and links <= left
    assert len(left) < len(links) + 200


@pytest.mark.parametrize("size", [3_000, 200_000])
def test_full_classes_rule_nothing_out(size):
    """Shingles that all fall into few classes, whose counts are full."""
    rng = np.random.default_rng(size)
    x = np.unique(rng.integers(0, 2**50, size, dtype=np.uint64) * np.uint64(J.CLASSES))
    sets = [x, x[: len(x) * 9 // 10], x[len(x) // 20:]]
    assert similar(sets) <= one_bucket(sets)


def test_chain_of_copies_is_one_component(spark):
    rng = random.Random(4)
    text = words(rng, 120, 10**6).split()
    rows = []
    for d in range(40):
        rows.append((d, " ".join(text)))
        text = text[2:] + [f"c{d}a", f"c{d}b"]
    assert {r.component_id for r in J.join(frame(spark, rows)).collect()} == {0}


@pytest.mark.parametrize("band", range(9))
def test_similar_sets_share_a_signature(band):
    """The guarantee of the index, at the largest difference that still links."""
    rng = np.random.default_rng(band)
    for sets in (1, 10**6, 10**9):
        for _ in range(60):
            size = int(rng.integers(1 << band, 1 << (band + 1)))
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            out = int(rng.integers(0, J.most_different(len(x)) + 1))
            y = x[rng.permutation(len(x))[: len(x) - out]] if rng.random() < 0.5 else x
            add = 0
            while 100 * len(y) >= 85 * (len(x) + add + 1) and rng.random() < 0.9:
                add += 1
            y = np.unique(np.concatenate([y, rng.integers(0, 2**63, add, dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            if not len(y) or 100 * both < 85 * (len(x) + len(y) - both):
                continue
            of = lambda s: set(np.concatenate([J.signatures(s, b, *J.allocate(b, sets)) for b in J.schemes(len(s))]).tolist())
            assert of(x) & of(y)


def test_originals_with_the_largest_id_link_all_their_copies(spark):
    """Two edited copies that share no bucket with each other are both hubs; the original picks one only."""
    rng = random.Random(7)
    rows = []
    for g in range(60):
        x = words(rng, 16, 10**6).split()
        rows += [(3 * g, " ".join([*x[:-1], f"last{g}"])), (3 * g + 1, " ".join([f"first{g}", *x[1:]])), (3 * g + 2, " ".join(x))]
    expected = brute(rows)
    assert {c for _, _, c in expected} == {3 * g for g in range(60)}
    assert got(J.join(frame(spark, rows))) == expected


def test_shared_rows_across_batches():
    import pyarrow as pa
    rng = random.Random(6)
    rows = sorted((rng.randrange(12), rng.randrange(4)) for _ in range(60))
    rows += [(50, 1), (51, 1), (51, 1), (52, 1), (52, 1), (52, 2)]
    ids = defaultdict(set)
    for s, d in rows:
        ids[s].add(d)
    expected = sorted({(s, d) for s, d in rows if len(ids[s]) > 1})
    for step in (1, 2, 3, 7, 100):
        parts = [pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows[a: a + step]]), pa.array([d for _, d in rows[a: a + step]])],
                                            names=["sig", "doc_id"]) for a in range(0, len(rows), step)]
        out = [(r["sig"], r["doc_id"]) for b in J._shared(iter(parts)) for r in b.to_pylist()]
        assert sorted(out) == expected, step


def test_odd_rows(spark, odd, odd_rows, none):
    expected = brute([r for r in odd_rows])
    assert got(J.join(odd)) == expected
    assert J.join(none).count() == 0


def test_an_id_with_two_texts_is_one_document(spark):
    rows = [(4, "a b c d e f"), (4, "u v w x y z"), (9, "a b c d e f"), (2, "u v w x y z"), (7, "alone in here now")]
    assert {(r.doc_id, r.component_id) for r in J.join(frame(spark, rows)).collect()} == {(4, 2), (9, 2), (2, 2), (7, 7)}


def test_a_worker_remembers_few_words():
    """Of 300000 words the hashes of 110000 at most stay in memory, and what is forgotten is hashed alike."""
    shingle = J.Shingler(4)
    text = lambda k: " ".join(f"w{i}" for i in range(1000 * k, 1000 * k + 1000))
    first = shingle(text(0))
    for k in range(1, 300):
        shingle(text(k))
        assert len(shingle.words) <= 110_000
    assert (shingle(text(0)) == first).all()
