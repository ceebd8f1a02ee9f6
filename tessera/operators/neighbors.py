"""Neighbour operators.

Exact k-nearest neighbours never materialise all (query, reference) pairs:

* pivots (a bounded sample of the reference rows) cut the reference into the cells
  of their nearest pivot, a row for each of which, its size and radius, comes to the
  driver.  A query's distances to the pivots bound its k-th neighbour from above and
  the rows of a cell from below (triangle and bisector bounds, which hold for every
  metric), so a query visits only the cells that can still hold a neighbour;
* a cell larger than ``block_rows`` is cut into blocks and the queries of a block into
  groups of about ``query_rows``; a (block, group) is a task's work whatever the
  tables' sizes.  Its kernel keeps one distance matrix of bounded size at a time, and
  the final top k per query is taken over k candidates of each block it visited.

Distances are computed from coordinate differences (not the |q|^2 + |r|^2 -
2 q.r shortcut) so they agree with a plain SQL evaluation.  For Euclidean distances
that shortcut, a matrix product, only says which rows can be among the k nearest, with
a margin above its rounding.  Rows without an id or a vector take no part.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import connected_components
from tessera.session import cut_lineage

KNN_SCHEMA = "query_id long, neighbor_id long, rank int, distance double"
BLOCK_ROWS, QUERY_ROWS = 32768, 32768
#: Reference rows from which a matrix product precedes the exact distances, and rows that share a least value there.
FILTER_ROWS, SHARED = 1024, 64
#: Most pivots; their coordinates and pairwise bounds travel to every task.
PIVOTS = 512
#: Bytes of one distance matrix.
MATRIX_BYTES = 16 << 20
#: Relative slack of the bounds, far above the rounding of the distances.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray, metric: str, p: float) -> np.ndarray:
    """All distances of two sets of points, one coordinate at a time."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        diff = np.abs(x[:, None] - y[None, :])
        out += diff if metric == "manhattan" else diff * diff if metric != "minkowski" or p == 2 else diff ** p
    return out if metric == "manhattan" else np.sqrt(out) if metric != "minkowski" or p == 2 else out ** (1.0 / p)


def _margins(a: np.ndarray, b: np.ndarray) -> tuple[type, np.ndarray] | None:
    """The type in which |b|^2 - 2 a.b is safe and how far it can be off for each row of
    ``a``; None where neither is."""
    reach = (np.sqrt((a * a).sum(axis=1)) + math.sqrt((b * b).sum(axis=1).max())) ** 2
    for kind, least, most in ((np.float32, 1e-24, 1e30), (np.float64, 1e-200, 1e200)):
        if least < reach.min() and reach.max() < most:
            return kind, (4.0 * (a.shape[1] + 16) * float(np.finfo(kind).eps) * reach)
    return None


def _candidates(qids: np.ndarray, qx: np.ndarray, rids: np.ndarray, rx: np.ndarray, k: int, exclude_self: bool, step: int):
    """(first query, rows, columns): pairs that hold the k nearest of every query with all
    that tie with them.  Every ``SHARED`` rows share their least value; the k-th least of
    these is no less than the k-th of all rows."""
    middle = rx.mean(axis=0)
    a, b = qx - middle, rx - middle
    found = _margins(a, b)
    if found is None:
        return None
    kind, margin = found
    groups = -(-len(rx) // SHARED)
    dim = rx.shape[1]
    wide = np.zeros((groups * SHARED, dim + 1), kind)  # b, |b|^2; what only fills the last group is at no distance
    wide[:, dim] = np.inf
    wide[:len(rx), :dim], wide[:len(rx), dim] = b, (b * b).sum(axis=1)
    order = np.argsort(rids, kind="stable")
    first, last = (np.searchsorted(rids[order], qids, side=x) for x in ("left", "right"))

    def run():
        for s in range(0, len(qids), step):
            d = np.hstack([-2 * a[s:s + step], np.ones((len(a[s:s + step]), 1))]).astype(kind) @ wide.T
            if exclude_self:
                own = last[s:s + step] - first[s:s + step]
                row = np.repeat(np.arange(len(d)), own)
                at = np.arange(len(row)) - np.repeat(np.cumsum(own) - own, own) + np.repeat(first[s:s + step], own)
                d[row, order[at]] = np.inf
            least = d.reshape(len(d), SHARED, groups).min(axis=1)
            most = np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * margin[s:s + step]
            row, group = np.nonzero(least <= most[:, None])
            near = d.reshape(len(d), SHARED, groups)[row, :, group] <= most[row, None]
            at, line = np.nonzero(near)
            row, col = row[at], line * groups + group[at]
            keep = col < len(rx)
            yield s, row[keep], col[keep]
    return run()


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired points, one coordinate at a time as in ``distances``."""
    out = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        diff = x - y
        out += diff * diff
    return np.sqrt(out)


def _topk_kernel(qids: np.ndarray, qx: np.ndarray, rids: np.ndarray, rx: np.ndarray, k: int, exclude_self: bool, metric: str, p: float) -> pa.Table:
    """The k nearest of ``rx`` for each row of ``qx``, ties by id."""
    parts: list[tuple[np.ndarray, ...]] = []
    step = max(1, MATRIX_BYTES // (8 * max(1, len(rids))))

    def ranked(s: int, row: np.ndarray, col: np.ndarray, found: np.ndarray) -> None:
        row, col, found = (x[np.isfinite(found)] for x in (row, col, found))
        order = np.lexsort((rids[col], found, row))
        row, col, found = row[order], col[order], found[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
        keep = rank <= k
        parts.append((qids[s:s + step][row[keep]], rids[col[keep]], rank[keep], found[keep]))

    filtered = None
    if len(qids) and len(rids) >= max(FILTER_ROWS, SHARED * (k + 1)) and (metric == "euclidean" or metric == "minkowski" and p == 2) and np.isfinite(qx).all() and np.isfinite(rx).all():
        filtered = _candidates(qids, qx, rids, rx, k, exclude_self, step)
    if filtered is not None:
        for s, row, col in filtered:
            if exclude_self:
                row, col = (x[qids[s + row] != rids[col]] for x in (row, col))
            ranked(s, row, col, _apart(qx[s + row], rx[col]))
    for s in range(0, len(qids), step) if filtered is None else ():
        d = distances(qx[s:s + step], rx, metric, p)
        if exclude_self:
            d[qids[s:s + step, None] == rids[None, :]] = np.inf
        if len(rids) > k:
            row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1, None])  # ties included
        else:
            row, col = (x.ravel() for x in np.indices(d.shape))
        ranked(s, row, col, d[row, col])
    cols = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.float64())
    return pa.table({n: pa.array(c.astype(t.to_pandas_dtype())) for n, c, t in
                     zip(("query_id", "neighbor_id", "rank", "distance"), cols, types, strict=True)})


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(flat), dim)


def _nearest(pivots: np.ndarray, metric: str, p: float):
    """(_id, _x) with the cell of the nearest pivot and the distance to it."""
    def run(batches):
        for b in batches:
            d = distances(_matrix(b.column(1), pivots.shape[1]), pivots, metric, p)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                             names=["_id", "_x", "_cell", "_d"])
    return run


def visits(d: np.ndarray, cells: np.ndarray, sizes: np.ndarray, radii: np.ndarray, k: int) -> np.ndarray:
    """Which cells each query must visit, from its distances ``d`` to all pivots: those
    whose nearest possible row is no farther than a distance within which k rows lie."""
    far = d[:, cells] + radii  # no row of a cell is farther
    order = np.argsort(far, axis=1)
    enough = (np.cumsum(sizes[order], axis=1) >= k).argmax(axis=1)
    rows = np.arange(len(d))
    bound = np.where(sizes.sum() >= k, far[rows, order[rows, enough]], np.inf)
    near = np.maximum(d[:, cells] - radii, (d[:, cells] - d.min(axis=1, keepdims=True)) / 2)
    return near <= bound[:, None] * (1 + SLACK) + SLACK


def knn(queries: DataFrame, reference: DataFrame, k: int = 5, qid: str = "id", rid: str = "id",
        qvec: str = "vector", rvec: str = "vector", exclude_self: bool = False, metric: str = "euclidean",
        p: float = 2.0, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, neighbor_id, rank, distance), exactly k rows per query
    (fewer if the reference is smaller), ties broken by neighbour id."""
    # float vectors travel as floats; every distance is taken in double
    kind = "array<float>" if all(d.schema[c].dataType.simpleString() == "array<float>" for d, c in ((queries, qvec), (reference, rvec))) else "array<double>"

    def points(df: DataFrame, id_col: str, vec: str) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec).cast(kind).alias("_x")).where("_id is not null and _x is not null")

    q, r = points(queries, qid, qvec), points(reference, rid, rvec)
    facts = r.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("dim")).first()
    n_r, dim, n_q = facts["n"], facts["dim"] or 0, q.count()
    n_pivots = min(PIVOTS, math.ceil(n_r / block_rows))
    sample = r.orderBy(F.xxhash64("_id"), "_id").limit(max(1, n_pivots)).collect()  # at most PIVOTS rows
    pivots = np.unique(np.array([x["_x"] for x in sample], dtype=np.float64).reshape(len(sample), dim), axis=0)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], KNN_SCHEMA)
    cell_schema = f"_id long, _x {kind}, _cell int, _d double"
    placed = cut_lineage(r.mapInArrow(_nearest(pivots, metric, p), cell_schema))
    by_cell = placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_d").alias("radius")).orderBy("_cell").collect()  # a row per pivot
    cells, sizes, radii = (np.array([x[c] for x in by_cell]) for c in ("_cell", "n", "radius"))
    blocks = {int(c): math.ceil(n / block_rows) for c, n in zip(cells, sizes, strict=True)}
    need = k + bool(exclude_self)
    prune = metric != "minkowski" or p >= 1  # below 1 it is no metric

    def target(batches):
        for b in batches:
            d = distances(_matrix(b.column(1), dim), pivots, metric, p)
            go = visits(d, cells, sizes, radii, need) if prune else np.ones((len(d), len(cells)), bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([cells[x].tolist() for x in go], pa.list_(pa.int32()))], names=["_id", "_x", "_cells"])

    n_blocks = F.create_map(*[F.lit(int(v)) for c in blocks.items() for v in c])
    groups = max(1, math.ceil(n_q / query_rows))
    rg = placed.select("_cell", F.pmod(F.xxhash64("_id"), n_blocks[F.col("_cell")]).cast("int").alias("_block"),
                       F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "_id", "_x")
    qg = (q.mapInArrow(target, f"_id long, _x {kind}, _cells array<int>").select("_id", "_x", F.explode("_cells").alias("_cell"))
          .select("_cell", F.explode(F.sequence(F.lit(0), n_blocks[F.col("_cell")] - 1)).alias("_block"),
                  F.pmod(F.xxhash64("_id"), F.lit(groups)).cast("int").alias("_group"), "_id", "_x"))

    def cell(qp: pa.Table, rp: pa.Table) -> pa.Table:
        ids = [t.column("_id").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for t in (qp, rp)]
        if not len(ids[0]) or not len(ids[1]):
            return _topk_kernel(np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros(0, np.int64), np.zeros((0, dim)), k, exclude_self, metric, p)
        return _topk_kernel(ids[0], _matrix(qp.column("_x"), dim), ids[1], _matrix(rp.column("_x"), dim), k, exclude_self, metric, p)

    keys = ("_cell", "_block", "_group")
    found = qg.groupBy(*keys).cogroup(rg.groupBy(*keys)).applyInArrow(cell, KNN_SCHEMA)
    if sum(blocks.values()) == 1:
        return found
    w = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("int")))


def knn_classify(neighbors: DataFrame, labels: DataFrame, label_id: str, label_col: str,
                 weights: str = "uniform") -> DataFrame:
    """Vote of the neighbours' labels (uniform or 1/distance weights);
    ties -> smallest label."""
    lab = labels.select(F.col(label_id).cast("long").alias("neighbor_id"), F.col(label_col).alias("_y"))
    j = neighbors.join(lab, "neighbor_id")
    w = F.lit(1.0) if weights == "uniform" else F.when(F.col("distance") == 0, F.lit(1e300)).otherwise(
        1.0 / F.col("distance"))
    votes = j.groupBy("query_id", "_y").agg(F.sum(w).alias("_v"))
    return votes.groupBy("query_id").agg(F.min_by("_y", F.struct(-F.col("_v"), F.col("_y"))).alias("prediction"))


def knn_regress(neighbors: DataFrame, targets: DataFrame, target_id: str, target_col: str,
                weights: str = "uniform") -> DataFrame:
    """Mean (or inverse-distance weighted mean) of neighbour targets."""
    t = targets.select(F.col(target_id).cast("long").alias("neighbor_id"), F.col(target_col).cast("double").alias("_y"))
    j = neighbors.join(t, "neighbor_id")
    if weights == "uniform":
        return j.groupBy("query_id").agg(F.avg("_y").alias("prediction"))
    w = 1.0 / F.col("distance")
    exact = j.groupBy("query_id").agg(F.avg(F.when(F.col("distance") == 0, F.col("_y"))).alias("_z"),
                                      (F.sum(w * F.col("_y")) / F.sum(w)).alias("_w"))
    return exact.select("query_id", F.coalesce("_z", "_w").alias("prediction"))


def local_outlier_factor(neighbors: DataFrame, k: int) -> DataFrame:
    """L37 from a kNN table (self excluded): k-distance, reachability
    distance, local reachability density (with the reference library's
    1e-10 guard) and LOF as joins and grouped means."""
    neighbors = cut_lineage(neighbors)  # read three times
    kd = neighbors.where(F.col("rank") == k).select(F.col("query_id").alias("neighbor_id"),
                                                    F.col("distance").alias("_kdist"))
    r = neighbors.join(kd, "neighbor_id").withColumn("_reach", F.greatest("_kdist", "distance"))
    lrd = r.groupBy("query_id").agg((1.0 / (F.avg("_reach") + 1e-10)).alias("lrd"))
    nl = neighbors.join(lrd.select(F.col("query_id").alias("neighbor_id"), F.col("lrd").alias("_nlrd")), "neighbor_id")
    lof = nl.groupBy("query_id").agg(F.avg("_nlrd").alias("_m")).join(lrd, "query_id")
    return lof.select("query_id", "lrd", (F.col("_m") / F.col("lrd")).alias("lof"))


#: Pairs of points that two cells may have between them and still be compared one by one.
SMALL = 4096
#: Halvings of a cell's side, after which what is undecided is compared one by one.
DEEPEST = 40


def _points(points: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """(id, x): rows whose coordinates are all finite numbers."""
    x = [F.col(c).cast("double") for c in cols]
    fit = F.lit(True)
    for c in x:
        fit = fit & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return points.where(fit).select(F.col(id_col).alias("id"), F.array(*x).alias("x"))


def _key(x, side: float):
    return F.transform(x, lambda v: F.floor(v / F.lit(side)).cast("long"))


def _boxes(points: DataFrame, side: float, dims: int) -> DataFrame:
    """(key, n, low, high): the cells of a grid with the box around their points."""
    x = [F.col("x")[k] for k in range(dims)]
    return points.groupBy(_key(F.col("x"), side).alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(c) for c in x]).alias("low"), F.array(*[F.max(c) for c in x]).alias("high"))


def _offsets(dims: int) -> list[list[int]]:
    """Steps from a cell to the others whose boxes come within eps (side eps / sqrt(dims))."""
    reach = range(-math.ceil(math.sqrt(dims)), math.ceil(math.sqrt(dims)) + 1)
    return [list(o) for o in itertools.product(reach, repeat=dims) if any(o) and sum(max(0, abs(v) - 1) ** 2 for v in o) <= dims]


def _side(eps: float, dims: int) -> float:
    return eps / math.sqrt(dims)  # any two points of one cell are within eps


def within(left: DataFrame, right: DataFrame, dims: int, eps: float, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """What lies within ``eps`` of each other in different cells of two sets of points
    (id, x): (whole cells, single pairs).

    Pairs of cells are judged by the least and the greatest distance of the boxes around
    their points: too far, wholly within, or neither.  What is neither is halved in each
    dimension and judged again, until a pair has at most ``SMALL`` pairs of points, which
    are compared.  So two dense cells cost the pairs of points near the distance ``eps``
    and not their product.

    Whole cells: (level, a, b, n_b, root_a, root_b), where ``a`` and ``b`` are keys of the
    grid of that level and the roots those of the first.  Single pairs: (id_a, id_b,
    root_a, root_b).  With ``once`` a pair of first cells is settled by its first find."""
    side = _side(eps, dims)
    a, b = _boxes(left, side, dims), _boxes(right, side, dims)
    steps = F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in o]) for o in _offsets(dims)])

    def side_of(boxes: DataFrame, name: str) -> DataFrame:
        return boxes.select(F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "low", "high")])

    near = a.select("*", F.explode(steps).alias("o")).select(F.zip_with("key", "o", lambda k, o: k + o).alias("b"), *[F.col(c) for c in a.columns])
    pairs = near.select("b", F.col("key").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("n", "low", "high")]).join(side_of(b, "b"), "b")
    pairs = pairs.withColumns({"root_a": F.col("a"), "root_b": F.col("b")})
    cells, single, level = [], [], 0
    norm = lambda parts: F.sqrt(sum(parts[1:], parts[0]))
    sq = lambda v: v * v
    while True:
        gap = [F.greatest(F.lit(0.0), F.col("b_low")[k] - F.col("a_high")[k], F.col("a_low")[k] - F.col("b_high")[k]) for k in range(dims)]
        span = [F.greatest(F.col("b_high")[k] - F.col("a_low")[k], F.col("a_high")[k] - F.col("b_low")[k]) for k in range(dims)]
        judged = cut_lineage(pairs.where(norm([sq(v) for v in gap]) <= F.lit(eps))
                             .select("root_a", "root_b", "a", "b", "a_n", "b_n", (norm([sq(v) for v in span]) <= F.lit(eps)).alias("whole")))
        cells.append(judged.where("whole").select(F.lit(level).alias("level"), "a", "b", F.col("b_n").alias("n_b"), "root_a", "root_b"))
        rest = judged.where("not whole")
        if once:
            rest = rest.join(judged.where("whole").select("root_a", "root_b").distinct(), ["root_a", "root_b"], "left_anti")
        few = F.lit(level >= DEEPEST) | (F.col("a_n") * F.col("b_n") <= SMALL)
        here = side / 2 ** level
        keyed = lambda d, n: d.select(_key(F.col("x"), here).alias(n), F.col("id").alias(f"id_{n}"), F.col("x").alias(f"x_{n}"))
        compared = rest.where(few).select("root_a", "root_b", "a", "b").join(keyed(left, "a"), "a").join(keyed(right, "b"), "b")
        dist = norm([sq(F.col("x_a")[k] - F.col("x_b")[k]) for k in range(dims)])
        single.append(compared.where(dist <= F.lit(eps)).select("id_a", "id_b", "root_a", "root_b"))
        open_ = rest.where(~few)
        if level >= DEEPEST or open_.isEmpty():
            break
        level += 1

        def children(points: DataFrame, name: str) -> DataFrame:
            """The cells of the next grid below the undecided ones."""
            parents = open_.select(F.col(name).alias("parent")).distinct()
            inside = points.withColumn("parent", _key(F.col("x"), side / 2 ** (level - 1))).join(parents, "parent", "left_semi")
            return (side_of(_boxes(inside, side / 2 ** level, dims), name)
                    .withColumn("parent", F.transform(name, lambda v: F.shiftright(v, 1))))

        up = open_.select("root_a", "root_b", F.col("a").alias("pa"), F.col("b").alias("pb"))
        pairs = (up.join(children(left, "a").withColumnRenamed("parent", "pa"), "pa")
                 .join(children(right, "b").withColumnRenamed("parent", "pb"), "pb").drop("pa", "pb"))
    return functools.reduce(DataFrame.unionByName, cells), functools.reduce(DataFrame.unionByName, single)


def _each_level(cells: DataFrame, points: DataFrame, side: float, value, name: str) -> DataFrame:
    """(id, name): ``value`` over the whole cells that a point's cell of their level is paired with."""
    cells = cut_lineage(cells.groupBy("level", "a").agg(value.alias(name)))
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # at most DEEPEST
    out = None
    for level in levels:
        found = (points.select("id", _key(F.col("x"), side / 2 ** level).alias("a"))
                 .join(cells.where(F.col("level") == level).select("a", name), "a").select("id", name))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else points.sparkSession.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, {name} long")


def radius_pairs(points: DataFrame, id_col: str, cols: list[str], eps: float) -> DataFrame:
    """All pairs (a, b) with distance <= eps, self pairs included.  The result has
    a row for each; use ``radius_counts`` where only their number is needed."""
    p, dims = cut_lineage(_points(points, id_col, cols)), len(cols)
    side = _side(eps, dims)
    keyed = p.select("id", _key(F.col("x"), side).alias("key"))
    same = keyed.select(F.col("id").alias("a"), "key").join(keyed.select(F.col("id").alias("b"), "key"), "key").select("a", "b")
    cells, single = within(p, p, dims, eps)
    out = same.unionByName(single.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    for level in sorted(r[0] for r in cells.select("level").distinct().collect()):
        at = p.select("id", _key(F.col("x"), side / 2 ** level).alias("key"))
        whole = cells.where(F.col("level") == level).select(F.col("a").alias("ka"), F.col("b").alias("kb"))
        out = out.unionByName(whole.join(at.select(F.col("id").alias("a"), F.col("key").alias("ka")), "ka")
                              .join(at.select(F.col("id").alias("b"), F.col("key").alias("kb")), "kb").select("a", "b"))
    return out


#: Distinct points aimed at in a leaf, the fewest, and most halvings that make the leaves.
LEAF_ROWS, FEWEST_ROWS, DEEPEST_LEAF = 16384, 1024, 12
#: Points drawn for each leaf to place the cuts.
DRAWN = 32
#: Most points of the other side that one task takes beside a leaf.
BESIDE_ROWS = 1 << 20
#: Points in a block of the kernels, and distances they keep at a time.
MICRO, AT_ONCE = 64, 1 << 20
#: A label above all others.
NONE = 2 ** 63 - 1


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Halving planes (dimension, value) of a complete binary tree over a sample, node i above 2i+1 and 2i+2."""
    dim, value = np.zeros(2 ** depth - 1, np.int64), np.zeros(2 ** depth - 1)
    below = {0: sample}
    for i in range(2 ** depth - 1):
        x = below.pop(i)
        if len(x):
            dim[i] = np.argmax(x.max(axis=0) - x.min(axis=0))
            value[i] = np.median(x[:, dim[i]])
        right = x[:, dim[i]] > value[i]
        below[2 * i + 1], below[2 * i + 2] = x[~right], x[right]
    return dim, value


def _place(cuts: tuple[np.ndarray, np.ndarray], dims: int):
    dim, value = cuts

    def run(batches):
        for b in batches:
            x = _matrix(b.column("x"), dims)
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(len(dim).bit_length()):
                at = 2 * at + 1 + (x[rows, dim[at]] > value[at])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((at - len(dim)).astype(np.int32))], names=[*b.schema.names, "leaf"])
    return run


def _leaves(points: DataFrame, dims: int) -> DataFrame:
    """``points`` (x, ...) with ``leaf``: about equal shares of space cut at the medians of
    a bounded sample.  The sample only steers the cuts; every point gets its leaf."""
    n = points.count()
    rows = min(LEAF_ROWS, max(FEWEST_ROWS, n // 32))
    depth = min(DEEPEST_LEAF, max(0, math.ceil(math.log2(max(1, n / rows)))))
    drawn = points.where(F.pmod(F.xxhash64("x"), F.lit(max(1, n // (DRAWN * 2 ** depth)))) == 0).select("x").collect() if depth else []
    cuts = _cuts(np.array([r["x"] for r in drawn], np.float64).reshape(len(drawn), dims), depth)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", leaf int"
    return cut_lineage(points.mapInArrow(_place(cuts, dims), schema))


class _Blocks:
    """Points in blocks of at most ``MICRO`` near ones, with the box around each."""

    def __init__(self, x: np.ndarray, value: np.ndarray):
        order, todo, cuts = np.arange(len(x)), [(0, len(x))], []
        while todo:
            s, e = todo.pop()
            if e - s <= MICRO:
                cuts.append(s)
                continue
            part, half = x[order[s:e]], (e - s) // 2
            wide = np.argmax(part.max(axis=0) - part.min(axis=0))
            order[s:e] = order[s:e][np.argpartition(part[:, wide], half)]
            todo += [(s, s + half), (s + half, e)]
        self.starts = np.array(sorted(cuts))
        self.ends = np.append(self.starts[1:], len(x))
        self.order, self.x, self.value = order, x[order], value[order]
        self.low, self.high = (f.reduceat(self.x, self.starts, axis=0) for f in (np.minimum, np.maximum))


def _length(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0] * parts[0]
    for v in parts[1:]:
        out = out + v * v
    return np.sqrt(out)


def _near(a: _Blocks, b: _Blocks, eps: float):
    """For each block of ``a``: (its slice, blocks of ``b`` wholly within ``eps``, [(rows of
    ``b`` compared one by one, which are within ``eps``: a row for each point of the block)])."""
    dims, sizes = a.x.shape[1], b.ends - b.starts
    for low, high, s, e in zip(a.low, a.high, a.starts, a.ends, strict=True):
        gap = _length([np.maximum(0.0, np.maximum(b.low[:, k] - high[k], low[k] - b.high[:, k])) for k in range(dims)])
        span = _length([np.maximum(b.high[:, k] - low[k], high[k] - b.low[:, k]) for k in range(dims)])
        whole = span <= eps
        rows = np.nonzero(np.repeat((gap <= eps) & ~whole, sizes))[0]

        def compared(rows=rows, s=s, e=e):
            step = max(1, AT_ONCE // (e - s))
            for f in range(0, len(rows), step):
                some = rows[f:f + step]
                yield some, _length([a.x[s:e, k, None] - b.x[None, some, k] for k in range(dims)]) <= eps
        yield slice(s, e), whole, compared()


def _counted(a: _Blocks, b: _Blocks, eps: float) -> np.ndarray:
    """For each point of ``a`` the sum of the values of ``b`` within ``eps``."""
    out, sums = np.zeros(len(a.x), np.int64), np.add.reduceat(b.value, b.starts)
    for at, whole, compared in _near(a, b, eps):
        out[at] += sums[whole].sum()
        for rows, hit in compared:
            out[at] += np.rint(hit @ b.value[rows].astype(np.float64)).astype(np.int64)
    return out


def _least(a: _Blocks, b: _Blocks, eps: float) -> np.ndarray:
    """For each point of ``a`` the smallest value of ``b`` within ``eps``, the largest long without any."""
    out, least = np.full(len(a.x), NONE), np.minimum.reduceat(b.value, b.starts)
    for at, whole, compared in _near(a, b, eps):
        out[at] = np.minimum(out[at], least[whole].min(initial=NONE))
        for rows, hit in compared:
            out[at] = np.minimum(out[at], np.where(hit, b.value[rows], NONE).min(axis=1))
    return out


def _linked(a: _Blocks, b: _Blocks, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of values of points within ``eps``, smaller one first."""
    names, code = np.unique(b.value, return_inverse=True)
    sizes, found = b.ends - b.starts, set()
    for at, whole, compared in _near(a, b, eps):
        order = np.argsort(a.value[at], kind="stable")
        mine, starts = np.unique(a.value[at][order], return_index=True)
        seen = np.zeros((len(mine), len(names)), bool)
        seen[:, code[np.repeat(whole, sizes)]] = True
        for rows, hit in compared:
            for row, some in enumerate(np.logical_or.reduceat(hit[order], starts, axis=0)):
                seen[row, code[rows[some]]] = True
        row, col = np.nonzero(seen)
        found.update((min(p), max(p)) for p in zip(mine[row].tolist(), names[col].tolist()) if p[0] != p[1])
    u, v = zip(*found, strict=True) if found else ((), ())
    return np.array(u, np.int64), np.array(v, np.int64)


def _beside(left: DataFrame, right: DataFrame, dims: int, eps: float, kernel, schema: str) -> tuple[DataFrame, DataFrame]:
    """What points (x, value, leaf) of two sets have to do with each other within ``eps``:
    (pairs of leaves (a, b) wholly within it, what ``kernel`` finds in the others).

    Leaves are judged by the least and the greatest distance of the boxes around their
    points.  A leaf that is neither too far from another nor wholly within reach meets the
    other's points within ``eps`` of its box; where these are many they come in shares, so
    that a task holds a leaf and a bounded share whatever the density."""
    def boxes(points: DataFrame, name: str) -> DataFrame:
        x = [F.col("x")[k] for k in range(dims)]
        return points.groupBy(F.col("leaf").alias(name)).agg(
            F.count(F.lit(1)).alias(f"{name}_rows"), F.array(*[F.min(c) for c in x]).alias(f"{name}_low"), F.array(*[F.max(c) for c in x]).alias(f"{name}_high"))

    norm = lambda parts: F.sqrt(sum([v * v for v in parts[1:]], parts[0] * parts[0]))
    al, ah, bl, bh = (lambda k, c=c: F.col(c)[k] for c in ("a_low", "a_high", "b_low", "b_high"))
    gap = norm([F.greatest(F.lit(0.0), bl(k) - ah(k), al(k) - bh(k)) for k in range(dims)])
    span = norm([F.greatest(bh(k) - al(k), ah(k) - bl(k)) for k in range(dims)])
    pairs = cut_lineage(boxes(left, "a").crossJoin(boxes(right, "b")).where(gap <= F.lit(eps)).withColumn("whole", span <= F.lit(eps)))
    open_ = pairs.where("not whole")
    shares = open_.groupBy("a").agg(F.ceil(F.sum("b_rows") / F.lit(BESIDE_ROWS)).cast("int").alias("shares"))
    own = (left.withColumnRenamed("leaf", "a").join(shares, "a")
           .select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "x", "value"))
    x = F.col("x")
    out = norm([F.greatest(F.lit(0.0), x[k] - ah(k), al(k) - x[k]) for k in range(dims)])
    other = (right.withColumnRenamed("leaf", "b").join(open_.join(shares, "a").select("a", "b", "a_low", "a_high", "shares"), "b").where(out <= F.lit(eps))
             .select("a", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"), F.col("x").alias("x"), F.col("value").alias("value")))

    def meet(lp: pa.Table, rp: pa.Table) -> pa.Table:
        if not len(lp) or not len(rp):
            return kernel(None, None)
        return kernel(*[_Blocks(_matrix(t.column("x"), dims), t.column("value").combine_chunks().to_numpy(zero_copy_only=False)) for t in (lp, rp)])

    found = own.groupBy("a", "share").cogroup(other.groupBy("a", "share")).applyInArrow(meet, schema)
    return pairs.where("whole").select("a", "b"), found


def _by_point(left: DataFrame, right: DataFrame, dims: int, eps: float, kernel, merge) -> DataFrame:
    """(x, value): for each point of ``left`` the values of ``right`` within ``eps``, merged."""
    def rows(a: _Blocks | None, b: _Blocks | None) -> pa.Table:
        x, value = (np.zeros((0, dims)), np.zeros(0, np.int64)) if a is None else (a.x, kernel(a, b, eps))
        ends = pa.array(np.arange(0, dims * len(x) + 1, dims, dtype=np.int32))
        return pa.table({"x": pa.ListArray.from_arrays(ends, pa.array(x.ravel())), "value": pa.array(value)})

    whole, found = _beside(left, right, dims, eps, rows, "x array<double>, value long")
    of_leaf = whole.join(right.groupBy(F.col("leaf").alias("b")).agg(merge("value").alias("value")), "b").groupBy(F.col("a").alias("leaf")).agg(merge("value").alias("value"))
    rest = left.select("x", "leaf").join(of_leaf, "leaf").select("x", "value")
    return found.unionByName(rest).groupBy("x").agg(merge("value").alias("value"))


def _distinct_points(p: DataFrame, dims: int) -> DataFrame:
    """(x, n, leaf): a row for each place with the number of its points."""
    return _leaves(p.groupBy("x").agg(F.count(F.lit(1)).alias("n")), dims)


def radius_counts(points: DataFrame, id_col: str, cols: list[str], eps: float) -> DataFrame:
    """E08 neighbour counts within eps in any number of columns, self included.  Equal
    points are counted once with their number; leaves of near points wholly within reach of
    each other are added as numbers, and so are blocks of points inside a task, so only
    points near the distance ``eps`` are compared (``_beside``, ``_near``)."""
    p, dims = cut_lineage(_points(points, id_col, cols)), len(cols)
    return _radius_counts(p, _distinct_points(p, dims), dims, eps)


def _radius_counts(p: DataFrame, places: DataFrame, dims: int, eps: float) -> DataFrame:
    d = places.select("x", F.col("n").alias("value"), "leaf")
    found = _by_point(d, d, dims, eps, _counted, F.sum)
    return p.join(found, "x").groupBy("id").agg(F.sum("value").cast("long").alias("n_neighbors"))


def dbscan(points: DataFrame, id_col: str, cols: list[str], eps: float, min_samples: int = 5) -> DataFrame:
    """Core points have >= min_samples neighbours within eps (self included, counted
    as by ``radius_counts``).  All core points of a grid cell of side eps / sqrt(columns)
    are in one cluster and stand under its smallest id; cells are linked by core points
    within eps, and clusters are components of cells from alternating stars, run until they
    converge.  Border points take the smallest label of a core neighbour; noise, and a
    point without finite coordinates, is -1.  Cluster label = smallest core id in it."""
    p, dims = cut_lineage(_points(points, id_col, cols)), len(cols)
    side = _side(eps, dims)
    places = _distinct_points(p, dims)
    flagged = cut_lineage(p.join(_radius_counts(p, places, dims, eps), "id").select("id", "x", (F.col("n_neighbors") >= min_samples).alias("core")))
    core, other = flagged.where("core").select("id", "x"), flagged.where("not core").select("id", "x")
    leaf = places.select("x", "leaf")
    core_places = core.groupBy("x").agg(F.min("id").cast("long").alias("low_id")).withColumn("key", _key(F.col("x"), side)).join(leaf, "x")
    hubs = core_places.groupBy("key").agg(F.min("low_id").alias("value"))
    placed = cut_lineage(core_places.join(hubs, "key").select("x", "value", "leaf"))

    def links(a: _Blocks | None, b: _Blocks | None) -> pa.Table:
        u, v = (np.zeros(0, np.int64),) * 2 if a is None else _linked(a, b, eps)
        return pa.table({"a": pa.array(u), "b": pa.array(v)})

    whole, found = _beside(placed, placed, dims, eps, links, "a long, b long")
    of_leaf = lambda n: placed.select(F.col("leaf").alias(n), F.col("value").alias(f"{n}_hub")).distinct()
    met = whole.join(of_leaf("a"), "a").join(of_leaf("b"), "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    components = connected_components(found.unionByName(met))
    label = F.coalesce("label", "value").alias("value")
    named = cut_lineage(placed.join(components.withColumnRenamed("id", "value"), "value", "left").select("x", label, "leaf"))
    edge = other.select("x").distinct().join(leaf, "x").select("x", F.lit(0).cast("long").alias("value"), "leaf")
    border = _by_point(edge, named, dims, eps, _least, F.min).where(F.col("value") < F.lit(NONE))
    labels = (core.join(named.select("x", "value"), "x").select("id", F.col("value").alias("label"))
              .unionByName(other.join(border, "x").groupBy("id").agg(F.min("value").alias("label"))))
    out = points.select(F.col(id_col).alias("id")).join(labels, "id", "left")
    return out.select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("cluster"))
