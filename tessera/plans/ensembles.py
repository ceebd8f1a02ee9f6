"""Model compositions built from Spark ML estimators (L06, L14-L16, L21,
L29, L34-L36, L38, L40).

Each member fit is a distributed Spark ML fit; combining members is column
arithmetic on the prediction table.  Iterative loops (boosting rounds,
RANSAC candidates, concentration steps) keep only small per-round numbers
on the driver and cut lineage in the shared checkpoint folder.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_below, hash_hex
from tessera.operators.split import kfold, poisson_weights
from tessera.session import cut_lineage


def _predict_as(model, df: DataFrame, name: str, keep_prob: bool = False) -> DataFrame:
    out = model.transform(df)
    cols = [c for c in df.columns] + [F.col("prediction").alias(name)]
    if keep_prob and "probability" in out.columns:
        cols.append(vector_to_array("probability").alias(f"{name}_prob"))
    return out.select(*cols)


def vote(df: DataFrame, pred_cols, weights=None, name: str = "prediction") -> DataFrame:
    """L15 hard vote: weighted count per class, ties -> smallest class."""
    weights = weights or [1.0] * len(pred_cols)
    arr = F.array(*[F.struct(F.col(c).alias("c"), F.lit(float(w)).alias("w")) for c, w in zip(pred_cols, weights)])
    classes = F.array_distinct(F.transform(arr, lambda s: s["c"]))
    scored = F.transform(classes, lambda k: F.struct(
        F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + F.when(s["c"] == k, s["w"]).otherwise(0.0)).alias("v"),
        (-k).alias("neg"), k.alias("k")))
    return df.withColumn(name, F.array_max(scored)["k"])


def soft_vote(df: DataFrame, prob_cols, weights=None, name: str = "prediction") -> DataFrame:
    """L15 soft vote: weighted mean of class-probability arrays, argmax."""
    weights = weights or [1.0] * len(prob_cols)
    tot = float(sum(weights))
    avg = None
    for c, w in zip(prob_cols, weights):
        term = F.transform(F.col(c), lambda x: x * F.lit(float(w) / tot))
        avg = term if avg is None else F.zip_with(avg, term, lambda a, b: a + b)
    best = F.array_max(F.transform(F.arrays_zip(avg.alias("p"), F.sequence(F.lit(0), F.size(avg) - 1).alias("i")),
                                   lambda z: F.struct(z["p"].alias("p"), (-z["i"]).alias("ni"))))
    return df.withColumn(name, (-best["ni"]).cast("double"))


def fit_bagging(make, df: DataFrame, id_col: str, n_estimators: int = 5, seed: int = 42):
    """Members trained on Poisson(1) bootstrap weights (weightCol), one
    weight column per member from the row's hash draw; all draws are made in one
    pass and written, as every fit reads its rows several times."""
    members, drawn = [], df
    for b in range(n_estimators):
        drawn = poisson_weights(drawn, id_col, 1.0, seed + b, f"_bw{b}")
    drawn = cut_lineage(drawn)
    for b in range(n_estimators):
        d = drawn.where(F.col(f"_bw{b}") > 0).select(*df.columns, F.col(f"_bw{b}").cast("double").alias("_bw"))
        est = make(seed + b)
        est.setWeightCol("_bw")
        members.append(est.fit(d))
    return members


def predict_members(members, df: DataFrame, keep_prob: bool = False) -> tuple[DataFrame, list]:
    names = []
    out = df
    for i, m in enumerate(members):
        out = _predict_as(m, out, f"_m{i}", keep_prob)
        names.append(f"_m{i}")
    return out, names


def bagging_predict(members, df: DataFrame, task: str = "classification") -> DataFrame:
    out, names = predict_members(members, df)
    if task == "classification":
        return vote(out, names)
    return out.withColumn("prediction", sum(F.col(n) for n in names) / float(len(names)))


def fit_stacking(makes, meta_make, df: DataFrame, id_col: str, k: int = 3, seed: int = 42):
    """Out-of-fold member predictions (G07 folds) become the meta
    model's features; members are then refitted on all rows."""
    from pyspark.ml.feature import VectorAssembler
    f = kfold(df, k, id_col, True, seed)
    oof = []
    for fold in range(k):
        train, hold = f.where(F.col("fold") != fold), f.where(F.col("fold") == fold)
        part = hold
        for i, mk in enumerate(makes):
            part = _predict_as(mk(seed).fit(train), part, f"_s{i}")
        oof.append(part)
    meta_df = oof[0]
    for p in oof[1:]:
        meta_df = meta_df.unionByName(p)
    names = [f"_s{i}" for i in range(len(makes))]
    va = VectorAssembler(inputCols=names, outputCol="_meta")
    meta = meta_make().setFeaturesCol("_meta").fit(va.transform(meta_df))
    members = [mk(seed).fit(df) for mk in makes]
    return members, va, meta


def stacking_predict(model, df: DataFrame) -> DataFrame:
    members, va, meta = model
    out = df
    for i, m in enumerate(members):
        out = _predict_as(m, out, f"_s{i}")
    return meta.transform(va.transform(out))


def fit_adaboost(make_stump, df: DataFrame, n_rounds: int = 10, n_classes: int = 2, checkpoint_every: int = 3):
    """L06 SAMME: per round a weighted shallow tree; error and alpha are two
    numbers per round; weights are updated by an expression and the weight
    column is checkpointed every few rounds."""
    d = df.withColumn("_aw", F.lit(1.0))
    models, alphas = [], []
    for r in range(n_rounds):
        est = make_stump(r)
        est.setWeightCol("_aw")
        m = est.fit(d)
        p = m.transform(d).withColumn("_miss", (F.col("prediction") != F.col("label")).cast("double"))
        agg = p.agg(F.sum(F.col("_aw") * F.col("_miss")).alias("e"), F.sum("_aw").alias("w")).first()
        err = (agg["e"] or 0.0) / agg["w"]
        if err >= 1 - 1.0 / n_classes:
            break
        err = max(err, 1e-10)
        alpha = math.log((1 - err) / err) + math.log(n_classes - 1)
        models.append(m)
        alphas.append(alpha)
        d = p.select(*[c for c in df.columns], (F.col("_aw") * F.exp(F.lit(alpha) * F.col("_miss"))).alias("_aw"))
        if (r + 1) % checkpoint_every == 0:
            d = cut_lineage(d)
        if err <= 1e-10:
            break
    return models, alphas


def adaboost_predict(model, df: DataFrame) -> DataFrame:
    models, alphas = model
    out, names = predict_members(models, df)
    return vote(out, names, alphas)


def fit_ransac(df: DataFrame, feature_cols, label: str, id_col: str, n_candidates: int = 20,
               min_samples: int | None = None, threshold: float | None = None, seed: int = 42):
    """Candidate linear fits on tiny hash samples; inliers of all
    candidates counted in ONE pass (their predictions are column
    expressions); refit on the inliers of the best candidate.  Threshold
    defaults to the median absolute deviation of the label."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from tessera.operators.aggregates import exact_median
    n = df.count()
    s = min_samples or (len(feature_cols) + 1) * 5
    if threshold is None:
        med = exact_median(df, label).first()[0]
        threshold = exact_median(df.withColumn("_ad", F.abs(F.col(label) - F.lit(med))), "_ad").first()[0]
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="_rf")
    cands = []
    for c in range(n_candidates):
        sample = df.where(hash_below(hash_hex(id_col, seed=seed + c, salt="ransac"), s / n))
        m = LinearRegression(featuresCol="_rf", labelCol=label).fit(va.transform(sample))
        cands.append((list(m.coefficients.toArray()), float(m.intercept)))

    def pred(c):
        w, b = cands[c]
        e = F.lit(b)
        for col, wi in zip(feature_cols, w):
            e = e + F.lit(float(wi)) * F.col(col)
        return e
    counts = df.agg(*[F.count_if(F.abs(F.col(label) - pred(c)) <= F.lit(threshold)).alias(f"c{c}")
                      for c in range(n_candidates)]).first()
    best = max(range(n_candidates), key=lambda c: (counts[f"c{c}"], -c))
    inliers = df.where(F.abs(F.col(label) - pred(best)) <= F.lit(threshold))
    final = LinearRegression(featuresCol="_rf", labelCol=label).fit(va.transform(inliers))
    return final, va, int(counts[f"c{best}"])


def isolation_forest(df: DataFrame, feature_cols, id_col: str, n_trees: int = 50, sample_size: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """Each tree is grown in one pandas call from its own ~256-row hash
    sample (``groupBy(tree).applyInPandas``); the forest (trees x <= 2*256
    nodes) is broadcast and rows are scored by ``mapInPandas``; the anomaly
    threshold is the exact score quantile at ``contamination``."""
    from tessera.operators.aggregates import exact_quantiles
    spark = df.sparkSession
    n = df.count()
    frac = min(1.0, sample_size / max(n, 1))
    cols = list(feature_cols)
    # a row's trees are picked inside the row, so only the trees' samples are ever made
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.shiftrightunsigned(F.xxhash64(F.col(id_col), t, F.lit(seed)), 4) < F.lit(int(frac * (1 << 60))))
    samp = df.select(id_col, *[F.col(c).cast("double") for c in cols], F.explode(trees).alias("tree"))
    max_depth = int(math.ceil(math.log2(max(sample_size, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 1000 + t)
        X = pdf[cols].to_numpy(dtype=float)
        nodes = []  # (node, feature, split, left, right, size)

        def build(idx, depth):
            node = len(nodes)
            nodes.append(None)
            if depth >= max_depth or len(idx) <= 1:
                nodes[node] = (node, -1, 0.0, -1, -1, len(idx))
                return node
            f = int(rng.integers(len(cols)))
            lo, hi = X[idx, f].min(), X[idx, f].max()
            if lo == hi:
                nodes[node] = (node, -1, 0.0, -1, -1, len(idx))
                return node
            sp = float(rng.uniform(lo, hi))
            left = build(idx[X[idx, f] < sp], depth + 1)
            right = build(idx[X[idx, f] >= sp], depth + 1)
            nodes[node] = (node, f, sp, left, right, len(idx))
            return node
        build(np.arange(len(X)), 0)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "left", "right", "size"])
        out.insert(0, "tree", t)
        return out
    schema = "tree int, node int, feature int, split double, left int, right int, size long"
    forest = samp.groupBy("tree").applyInPandas(grow, schema).collect()  # bounded: trees x nodes
    by_tree = {}
    for r in forest:
        by_tree.setdefault(r["tree"], []).append((r["node"], r["feature"], r["split"], r["left"], r["right"], r["size"]))
    arrays = []
    for t, rows in sorted(by_tree.items()):
        rows.sort()
        arrays.append(tuple(np.array([x[i] for x in rows]) for i in range(1, 6)))
    bc = spark.sparkContext.broadcast(arrays)

    def c_n(m):
        m = np.asarray(m, dtype=float)
        out = np.where(m > 2, 2.0 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2.0 * (m - 1) / np.maximum(m, 1),
                       np.where(m == 2, 1.0, 0.0))
        return out
    cnorm = float(c_n(min(sample_size, n)))

    def score(batches):
        trees = bc.value
        for b in batches:
            X = b[cols].to_numpy(dtype=float)
            rows = np.arange(len(X))
            depth_sum = np.zeros(len(X))
            for feat, split, left, right, size in trees:
                node = np.zeros(len(X), dtype=np.int64)
                depth = np.zeros(len(X))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = X[rows[active], f] < split[node[active]]
                    node[active] = np.where(go_left, left[node[active]], right[node[active]])
                    depth[active] += 1
                    active = feat[node] >= 0
                depth_sum += depth + c_n(size[node])
            s_ = np.power(2.0, -(depth_sum / max(len(trees), 1)) / cnorm)
            yield pd.DataFrame({id_col: b[id_col], "score": s_})
    id_type = dict(df.dtypes)[id_col]
    scored = df.select(id_col, *[F.col(c).cast("double") for c in cols]).mapInPandas(
        score, f"{id_col} {id_type}, score double")
    scored = cut_lineage(scored)
    thr = exact_quantiles(scored, "score", [1 - contamination]).first()["value"]
    return scored.withColumn("prediction", F.when(F.col("score") > F.lit(thr), -1).otherwise(1))


def _mahalanobis(cols, mu: np.ndarray, inv: np.ndarray):
    diffs = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mu, strict=True)]
    terms = [diffs[i] * diffs[j] * F.lit(float(inv[i, j]) * (1 if i == j else 2)) for i in range(len(cols)) for j in range(i, len(cols))]
    return functools.reduce(lambda a, b: a + b, terms)


def _means(df: DataFrame, cols, parts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and covariance of the rows of each condition of ``parts``, in one pass: a task
    gives one row for each.  A mean is over the values that are there, a covariance over the
    rows that have both."""
    p, most = len(cols), len(parts)

    def joined(a, b):
        """Counts, means and summed products of deviations of two sets of rows together."""
        (n, m, c), (k, o, d) = a, b
        step, share = o - m, k / np.maximum(n + k, 1)
        return n + k, m + step * share, c + d + step * step.T * n * share

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros((p, p)),) * 3] * most
        for batch in batches:
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[:p]], axis=1).astype(float)
            x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[:p]], axis=1)
            for s, c in enumerate(batch.columns[p:]):
                keep = c.fill_null(False).to_numpy(zero_copy_only=False)
                if keep.any():
                    w, y = there[keep], x[keep]
                    centre = y.sum(axis=0) / np.maximum(w.sum(axis=0), 1)
                    y = (y - centre) * w
                    n = w.T @ w  # [i, j]: of the rows that have both i and j
                    off = (y.T @ w) / np.maximum(n, 1)
                    held[s] = joined(held[s], (n, (centre[:, None] + off) * (n > 0), y.T @ y - n * off * off.T))
        flat = [pa.array([list(h[k].ravel()) for h in held], pa.list_(pa.float64())) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(range(most), pa.int32()), *flat], names=["part", "n", "mean", "dev"])

    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], *[keep.alias(f"k{s}") for s, keep in enumerate(parts)])
    found = [(np.zeros((p, p)),) * 3] * most
    for r in rows.mapInArrow(moments, "part int, n array<double>, mean array<double>, dev array<double>").collect():  # a few numbers of each task
        found[r["part"]] = joined(found[r["part"]], tuple(np.array(r[k]).reshape(p, p) for k in ("n", "mean", "dev")))
    return [(np.diagonal(mean).copy(), dev / np.maximum(n, 1)) for n, mean, dev in found]


def elliptic_envelope(df: DataFrame, feature_cols, contamination: float = 0.05, starts: int = 10, support: float | None = None,
                      id_col: str | None = None, seed: int = 42, finalists: int = 3, most_steps: int = 30) -> DataFrame:
    """Robust mean and covariance (minimum covariance determinant).

    ``starts`` random subsets (rows by a hash of ``id_col``, or of the features) are
    refined together: each step finds, in one pass, for every start the distance within
    which the closest ``support`` of the rows lie, and in another the mean and covariance
    of these.  After two steps the ``finalists`` of the least determinants go on until none
    falls any more (at most ``most_steps``).  The least determinant wins; its cut is exact.  Outliers are the farthest
    ``contamination`` share.  Rows with a null feature get no distance and count as
    inliers."""
    from tessera.operators.aggregates import exact_quantiles
    cols, p = list(feature_cols), len(list(feature_cols))
    df = cut_lineage(df)  # read by every step
    n = df.count()
    if support is None:
        support = min(1.0, max((n + p + 1) / 2.0 / max(n, 1), 0.5))
    key = F.col(id_col) if id_col else F.struct(*cols)
    # about 20 rows for each column begin a start
    first = min(1.0, 20.0 * (p + 1) / max(n, 1))
    now = _means(df, cols, [F.shiftrightunsigned(F.xxhash64(key, F.lit(s), F.lit(seed)), 4) < F.lit(int(first * (1 << 60))) for s in range(starts)])
    det = [np.inf] * starts
    moving = list(range(starts))
    for step in range(most_steps):
        if step == 2:
            moving = sorted(moving, key=lambda s: (det[s], s))[:finalists]
        inv = {s: np.linalg.pinv(now[s][1]) for s in moving}
        dist = {s: _mahalanobis(cols, now[s][0], inv[s]) for s in moving}
        # the distances are columns first: an expression inside the aggregate would be interpreted for every row
        cuts = df.select(*[dist[s].alias(f"d{s}") for s in moving]).agg(*[F.percentile_approx(f"d{s}", support, 2_000).alias(f"q{s}") for s in moving]).first()
        after = _means(df, cols, [dist[s] <= F.lit(cuts[f"q{s}"]) for s in moving])
        still = []
        for s, found in zip(moving, after, strict=True):
            new = float(np.linalg.det(found[1]))
            if new < det[s] * (1 - 1e-4):
                now[s], det[s] = found, new
                still.append(s)
        moving = still
        if not moving:
            break
    best = min(range(starts), key=lambda s: (det[s], s))
    d = df.withColumn("mahalanobis", _mahalanobis(cols, now[best][0], np.linalg.pinv(now[best][1])))
    thr = exact_quantiles(d, "mahalanobis", [1 - contamination]).first()["value"]
    return d.withColumn("prediction", F.when(F.col("mahalanobis") > F.lit(thr), -1).otherwise(1))


@dataclass
class Components:
    """Directions of the rows of a table: ``vectors`` has one in each row, ``values``
    the variance (or squared length) along each, ``total`` that along all."""
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def project(self, df: DataFrame, features: str, out: str) -> DataFrame:
        """``df`` with ``out``, the row's coordinates along the directions, as an expression."""
        x = F.transform(F.col(features), lambda v: v.cast("double"))
        shift = self.vectors @ self.mean
        dot = lambda w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(c)) for c in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        return df.withColumn(out, F.array(*[dot(w) - F.lit(float(b)) for w, b in zip(self.vectors, shift, strict=True)]))


def gram_components(df: DataFrame, features: str, k: int | None = None, centred: bool = False) -> Components:
    """The first ``k`` components of an array column.

    Every task adds up its rows' sums and products (dims squared numbers), these are
    added over the tasks, and the driver takes the eigenvectors of the one matrix.
    ``centred`` gives principal components (sample covariance), else those of the
    uncentred SVD.  The largest entry of a direction is positive.  Rows with a null or
    without an array take no part."""
    rows = df.where(F.col(features).isNotNull() & F.forall(features, lambda v: v.isNotNull())).select(F.transform(F.col(features), lambda v: v.cast("double")).alias("x"))
    dims = rows.agg(F.max(F.size("x")).alias("d")).first()["d"] or 0

    def add(batches):
        n, total, gram = 0, np.zeros(dims), np.zeros((dims, dims))
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(b.num_rows, dims)
            n, total, gram = n + len(x), total + x.sum(axis=0), gram + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + dims + dims * dims)), pa.array(np.concatenate([[float(n)], total, gram.ravel()]))], names=["at", "v"])

    sums = rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # 1 + dims + dims squared numbers
    flat = np.zeros(1 + dims + dims * dims)
    for r in sums:
        flat[r["at"]] = r["v"]
    n, mean, gram = flat[0], flat[1:1 + dims] / max(flat[0], 1), flat[1 + dims:].reshape(dims, dims)
    if centred:
        gram = (gram - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values, kind="stable")[:k]
    vectors = vectors[:, order].T
    for v in vectors:
        if len(v) and v[np.argmax(np.abs(v))] < 0:
            v *= -1
    return Components(mean if centred else np.zeros(dims), vectors, np.maximum(values[order], 0), float(np.trace(gram)))


def truncated_svd(df: DataFrame, features: str, k: int = 5) -> Components:
    """Uncentred SVD of an array column; singular values are the roots of ``values``."""
    return gram_components(df, features, k)


def birch_like(df: DataFrame, features_cols, k: int, cell: float, seed: int = 42):
    """Micro-clusters by grid cell (count and linear sum per cell), then
    weighted k-means over the cell centroids; points take the nearest final
    centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    cols = list(features_cols)
    key = [F.floor(F.col(c) / F.lit(cell)).alias(f"_g{i}") for i, c in enumerate(cols)]
    micro = df.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("_n"), *[F.avg(c).alias(c) for c in cols])
    va = VectorAssembler(inputCols=cols, outputCol="features")
    km = KMeans(k=k, seed=seed, weightCol="_n").fit(va.transform(micro))
    return km.transform(va.transform(df))


def fit_adaboost_r2(make, df: DataFrame, n_rounds: int = 5, checkpoint_every: int = 3):
    """L24 AdaBoost.R2 (linear loss): per round a weighted regressor; the
    largest error and the weighted mean loss are two numbers per round; the
    weights are multiplied by beta^(1 - loss) in an expression."""
    df = cut_lineage(df)  # read several times in each round
    d = df.withColumn("_aw", F.lit(1.0))
    models, alphas = [], []
    for r in range(n_rounds):
        est = make(r)
        est.setWeightCol("_aw")
        m = est.fit(d)
        p = m.transform(d).withColumn("_err", F.abs(F.col("prediction") - F.col("label")))
        dmax = p.agg(F.max("_err")).first()[0] or 0.0
        if dmax <= 0:
            models.append(m)
            alphas.append(1.0)
            break
        p = p.withColumn("_loss", F.col("_err") / F.lit(dmax))
        a = p.agg((F.sum(F.col("_aw") * F.col("_loss")) / F.sum("_aw")).alias("l")).first()["l"]
        if a >= 0.5:
            if not models:
                models.append(m)
                alphas.append(1.0)
            break
        beta = max(a / (1 - a), 1e-12)
        models.append(m)
        alphas.append(math.log(1 / beta))
        d = p.select(*df.columns, (F.col("_aw") * F.pow(F.lit(beta), 1 - F.col("_loss"))).alias("_aw"))
        if (r + 1) % checkpoint_every == 0:
            d = cut_lineage(d)
    return models, alphas


def weighted_median(pred_cols, weights) -> "F.Column":
    """Per row: the smallest member prediction whose cumulative weight reaches
    half of the total (members sorted by prediction)."""
    half = float(sum(weights)) / 2.0
    arr = F.array_sort(F.array(*[F.struct(F.col(c).alias("p"), F.lit(float(w)).alias("w"))
                                 for c, w in zip(pred_cols, weights)]))
    init = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("double").alias("med"))
    res = F.aggregate(arr, init, lambda acc, s: F.struct(
        (acc["cum"] + s["w"]).alias("cum"),
        F.when(acc["med"].isNull() & (acc["cum"] + s["w"] >= F.lit(half)), s["p"]).otherwise(acc["med"]).alias("med")))
    return res["med"]


def adaboost_r2_predict(model, df: DataFrame) -> DataFrame:
    models, alphas = model
    out, names = predict_members(models, df)
    return out.withColumn("prediction", weighted_median(names, alphas))
