import math
import random

import numpy as np
import pytest

from tessera.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int, score string, x string, row string, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "x", "r", "c") for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every=50, k=5, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (q, x) in enumerate(kept):
        if q is None or q % every:
            continue
        found = sorted((-sum(c * d for c, d in zip(x, y, strict=False)), i is None, i or 0) for b, (i, y) in enumerate(kept) if b != a)[:k]
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("block", [7, 64, T.BLOCK])
def test_equals_all_pairs(spark, block):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(30)]  # copies of a query's vector tie
    assert got(T.search(frame(spark, rows), block=block)) == brute(rows)
    assert got(T.search(frame(spark, rows), every=7, k=3, scale=1000, block=block)) == brute(rows, 7, 3, 1000)


def test_several_cells_and_groups(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(400)]
    assert got(T.search(frame(spark, rows), every=10, block=16, cell_blocks=2, group=10, step=4)) == brute(rows, 10)


def test_odd_vectors(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(0, 120, 10)]
    rows += [(0, [1.0, 2.0, 3.0, 4.0]), (50, [1.0, 2.0, 3.0, 4.0]), (None, [5.0, 5.0, 5.0, 5.0]), (None, [5.0, 5.0, 5.0, 5.0]),
             (200, None), (250, [1.0, None, 2.0, 1.0]), (300, [float("nan"), 1.0, 1.0, 1.0]), (350, [float("inf"), 1.0, 1.0, 1.0]),
             (400, []), (450, [2.0, -3.0]), (-50, [-1.0, -2.0, -3.0, -4.0]), (500, [0.0, 0.0, 0.0, 0.0])]
    assert got(T.search(frame(spark, rows))) == brute(rows)
    assert got(T.search(frame(spark, rows[:1]))) == []
    assert got(T.search(frame(spark, []))) == []
    few = rows[:3]
    assert got(T.search(frame(spark, few), every=10)) == brute(few, 10)
    # components too large for a long sum take no part
    assert got(T.search(frame(spark, [*rows, (0, [1e30, 0.0, 0.0, 0.0])]))) == brute(rows)


def test_large_components_stay_exact():
    """Beyond what floats add exactly, the bounds are integers."""
    rng = np.random.default_rng(1)
    x = rng.integers(-T.MOST + 1, T.MOST, (50, 3))
    order = np.argsort(-x, axis=0, kind="stable")
    block = T.Block(3, 50, np.arange(50).astype("<i8").tobytes(), np.arange(50).astype("<i8").tobytes(), bytes(50),
                    np.take_along_axis(x, order, 0).T.astype("<i4").tobytes(), order.T.astype("<u2").tobytes())
    assert (block.vectors() == x).all()
    i, j, _ = T.candidates(block, x[:4], np.arange(4), 2, np.full(4, -np.inf))
    full = x[:4] @ x.T
    np.fill_diagonal(full[:, :4], -(1 << 62))
    for q in range(4):
        assert set(np.argsort(-full[q])[:2]) <= set(j[i == q].tolist()) and q not in j[i == q]


def test_reading_stops_early_where_a_vector_stands_out():
    """A query with close neighbours stops before the lists' ends, and the others are ruled out unseen."""
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(0, 0.1, (1000, 32))).astype(np.int64)
    query = x[:1] * 3
    x[10:16] = query + rng.integers(-3, 3, (6, 32))
    order = np.argsort(-x, axis=0, kind="stable")
    block = T.Block(32, 1000, np.arange(1000).astype("<i8").tobytes(), np.arange(1000).astype("<i8").tobytes(), bytes(1000),
                    np.take_along_axis(x, order, 0).T.astype("<i4").tobytes(), order.T.astype("<u2").tobytes())
    i, j, share = T.candidates(block, query, np.array([-1]), 5, np.array([-np.inf]))
    assert share < 1 and len(j) <= 10
    assert set(np.argsort(-(x @ query[0]))[:5]) <= set(j.tolist())
