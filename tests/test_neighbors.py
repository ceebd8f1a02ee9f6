import math
import random

import numpy as np
import pytest

from tessera.operators.neighbors import dbscan, distances, knn, radius_counts, visits


def _points():
    random.seed(3)
    pts = [(i, random.random(), random.random()) for i in range(300)]
    pts += [(1000 + i, 0.5, 0.5) for i in range(60)]          # a point mass (hot cell)
    pts += [(2000 + i, 0.9 + 0.002 * i, 0.1) for i in range(8)]  # a thin chain
    return pts


def _brute(pts, eps, min_samples):
    nb = {a: [b for b, bx, by in pts if math.hypot(ax - bx, ay - by) <= eps] for a, ax, ay in pts}
    core = {a for a in nb if len(nb[a]) >= min_samples}
    parent = {a: a for a in core}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    for a in core:
        for b in nb[a]:
            if b in core:
                ra, rb = find(a), find(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
    comp = {}
    for a in core:
        comp.setdefault(find(a), []).append(a)
    label = {a: min(members) for members in comp.values() for a in members}
    out = {}
    for a, _, _ in pts:
        if a in label:
            out[a] = label[a]
        else:
            cl = [label[b] for b in nb[a] if b in label]
            out[a] = min(cl) if cl else -1
    return {a: len(v) for a, v in nb.items()}, out


def test_radius_counts_and_dbscan_match_brute_force(spark):
    pts = _points()
    df = spark.createDataFrame(pts, "id long, x double, y double")
    counts, labels = _brute(pts, 0.05, 5)
    got = {r["id"]: r["n_neighbors"] for r in radius_counts(df, "id", ["x", "y"], 0.05).collect()}
    assert got == counts
    got = {r["id"]: r["cluster"] for r in dbscan(df, "id", ["x", "y"], 0.05, 5).collect()}
    assert got == labels


def _brute_knn(queries, reference, k, exclude_self, dist):
    out = []
    for a, x in queries:
        near = sorted((dist(x, y), b) for b, y in reference if not (exclude_self and a == b))[:k]
        out += [(a, n + 1, b, round(d, 9)) for n, (d, b) in enumerate(near)]
    return sorted(out)


def _knn_rows(df):
    return sorted((r["query_id"], r["rank"], r["neighbor_id"], round(r["distance"], 9)) for r in df.collect())


METRICS = {"euclidean": math.dist, "manhattan": lambda x, y: sum(abs(a - b) for a, b in zip(x, y)),
           "minkowski": lambda x, y: sum(abs(a - b) ** 3 for a, b in zip(x, y)) ** (1 / 3)}


@pytest.mark.parametrize("metric", METRICS)
def test_knn_equals_brute_force(spark, metric):
    rng = random.Random(5)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(120)] + [(500 + i, [0.5] * 4) for i in range(40)]  # a point mass ties
    df = spark.createDataFrame([*rows, (900, None), (None, [0.1] * 4)], "id long, v array<double>").repartition(3)
    expected = _brute_knn(rows, rows, 3, True, METRICS[metric])
    for sizes in ({}, {"block_rows": 7, "query_rows": 20}, {"block_rows": 30, "query_rows": 1000}):
        got = knn(df, df, k=3, qvec="v", rvec="v", exclude_self=True, metric=metric, p=3.0, **sizes)
        assert _knn_rows(got) == expected
    few = spark.createDataFrame(rows[:2], "id long, v array<double>")
    assert _knn_rows(knn(few, few, k=3, qvec="v", rvec="v")) == _brute_knn(rows[:2], rows[:2], 3, False, math.dist)
    assert knn(df, few.limit(0), k=3, qvec="v", rvec="v").count() == 0


def test_below_one_minkowski_is_not_pruned(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = knn(df, df, k=2, qvec="v", rvec="v", metric="minkowski", p=0.5, block_rows=10, query_rows=30)
    assert _knn_rows(got) == _brute_knn(rows, rows, 2, False, lambda x, y: sum(abs(a - b) ** 0.5 for a, b in zip(x, y)) ** 2)


def test_pivots_prune_most_blocks():
    """Rows in groups: a query visits few cells, and none of those it skips holds a neighbour."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 10, (20, 8))
    ref = np.repeat(centres, 50, axis=0) + rng.normal(0, 0.3, (1000, 8))
    q = centres[rng.integers(0, 20, 100)] + rng.normal(0, 0.3, (100, 8))
    pivots = ref[rng.permutation(1000)[:64]]
    cell = distances(ref, pivots, "euclidean", 2).argmin(axis=1)
    cells = np.unique(cell)
    sizes = np.array([(cell == c).sum() for c in cells])
    radii = np.array([distances(ref[cell == c], pivots[c:c + 1], "euclidean", 2).max() for c in cells])
    go = visits(distances(q, pivots, "euclidean", 2), cells, sizes, radii, 5)
    assert go.mean() < 0.25
    nearest = distances(q, ref, "euclidean", 2).argsort(axis=1)[:, :5]
    assert all(go[i, np.searchsorted(cells, cell[j])] for i in range(100) for j in nearest[i])


def test_kernel_keeps_its_matrix_bounded(monkeypatch):
    import tessera.operators.neighbors as N
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    whole = N._topk_kernel(np.arange(300), x, np.arange(300), x, 4, True, "euclidean", 2.0)
    shapes = []
    plain = N.distances
    monkeypatch.setattr(N, "distances", lambda a, b, m, p: shapes.append((len(a), len(b))) or plain(a, b, m, p))
    monkeypatch.setattr(N, "MATRIX_BYTES", 8 * 300 * 11)
    assert N._topk_kernel(np.arange(300), x, np.arange(300), x, 4, True, "euclidean", 2.0).equals(whole)
    assert max(a for a, _ in shapes) == 11


def _brute_counts(points, eps):
    return {a: sum(math.dist(x, y) <= eps for _, y in points) for a, x in points}


@pytest.mark.parametrize("dims", [1, 3, 4])
def test_radius_in_any_number_of_columns(spark, monkeypatch, dims):
    import tessera.operators.neighbors as N
    rng = random.Random(dims)
    points = [(i, [rng.random() for _ in range(dims)]) for i in range(250)] + [(900 + i, [0.25] * dims) for i in range(30)]
    cols = [f"c{k}" for k in range(dims)]
    df = spark.createDataFrame([(i, *x) for i, x in points] + [(5000, *[None] * dims), (5001, *[float("nan")] * dims)], ["id", *cols])
    eps = 0.05 if dims == 1 else 0.3
    expected = _brute_counts(points, eps)
    for small in (1, 4096) if dims < 4 else (4096,):  # few pairs compared one by one: cells are halved further
        monkeypatch.setattr(N, "SMALL", small)
        got = {r["id"]: r["n_neighbors"] for r in radius_counts(df, "id", cols, eps).collect()}
        assert got == expected
    pairs = {(r["a"], r["b"]) for r in N.radius_pairs(df, "id", cols, eps).collect()}
    assert pairs == {(a, b) for a, x in points for b, y in points if math.dist(x, y) <= eps}


def test_dense_adjacent_cells_finish(spark):
    """Two adjacent cells of 10 000 points each: cells wholly within reach are added as numbers."""
    rng = random.Random(7)
    side = 1 / math.sqrt(2)
    points = [(i, (i % 2 + rng.random()) * side, rng.random() * side) for i in range(20_000)]
    df = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: r["n_neighbors"] for r in radius_counts(df, "id", ["x", "y"], 1.0).collect()}
    xy = np.array([p[1:] for p in points])
    for i in range(0, 20_000, 997):
        assert got[i] == int((np.sqrt(((xy - xy[i]) ** 2).sum(axis=1)) <= 1.0).sum())
    labels = {r["cluster"] for r in dbscan(df, "id", ["x", "y"], 1.0, 5).collect()}
    assert labels == {0}


def test_many_leaves_and_shares_match_brute_force(spark, monkeypatch):
    """Small leaves, whose other sides come in shares: counts and clusters stay exact."""
    import tessera.operators.neighbors as N
    for name, value in (("LEAF_ROWS", 16), ("FEWEST_ROWS", 16), ("BESIDE_ROWS", 32)):
        monkeypatch.setattr(N, name, value)
    pts = _points()
    df = spark.createDataFrame(pts, "id long, x double, y double")
    counts, labels = _brute(pts, 0.05, 5)
    assert {r["id"]: r["n_neighbors"] for r in radius_counts(df, "id", ["x", "y"], 0.05).collect()} == counts
    assert {r["id"]: r["cluster"] for r in dbscan(df, "id", ["x", "y"], 0.05, 5).collect()} == labels


def test_dense_points_are_counted_by_blocks():
    """Of 4000 x 4000 pairs only those near the distance eps are compared; sums, labels and links are exact."""
    import tessera.operators.neighbors as N
    rng = np.random.default_rng(3)
    x, value = rng.random((4000, 2)), rng.integers(1, 5, 4000)
    a = N._Blocks(x, value)
    assert sum(len(rows) * hit.shape[0] for _, _, found in N._near(a, a, 0.5) for rows, hit in found) < 0.5 * 4000 ** 2
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= 0.5
    assert (N._counted(a, a, 0.5) == (near @ value)[a.order]).all()
    assert (N._least(a, a, 0.5) == np.where(near, value, 9).min(axis=1)[a.order]).all()
    few = N._Blocks(x[:300], np.arange(300))
    assert set(zip(*(v.tolist() for v in N._linked(few, few, 0.1)), strict=True)) == {
        (i, j) for i in range(300) for j in range(i + 1, 300) if math.dist(x[i], x[j]) <= 0.1}


def test_radius_and_dbscan_take_a_bounded_number_of_jobs(spark):
    """Their number follows neither the density nor the halvings of cells."""
    rng = random.Random(8)
    points = [(i, rng.random(), rng.random()) for i in range(20_000)]
    df = spark.createDataFrame(points, "id long, x double, y double").cache()
    jobs = []
    for eps in (0.02, 0.3):
        spark.sparkContext.setJobGroup(f"radius-{eps}", "")
        radius_counts(df, "id", ["x", "y"], eps).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"radius-{eps}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(jobs) <= 40


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1.0, 1e4), (1e-3, 0.0), (1e20, 0.0), (1e-60, 0.0)])
def test_matrix_product_loses_no_neighbour(monkeypatch, scale, shift):
    """The filtered kernel gives the rows of the plain one, with ties, equal ids and any scale,
    without its full matrix of differences."""
    import tessera.operators.neighbors as N
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)) * scale + shift
    x[700:900] = x[:200]  # ties
    ids = np.where(np.arange(1500) % 50 == 0, 7, np.arange(1500))  # an id comes often
    args = (ids, x, ids, x, 5, True, "euclidean", 2.0)
    monkeypatch.setattr(N, "MATRIX_BYTES", 8 * 1500 * 400)
    made = []
    monkeypatch.setattr(N, "distances", lambda a, b, m, p: made.append(1) or distances(a, b, m, p))
    got = N._topk_kernel(*args)
    assert not made
    monkeypatch.setattr(N, "FILTER_ROWS", 10 ** 9)
    assert got.equals(N._topk_kernel(*args)) and made
