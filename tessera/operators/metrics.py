"""Evaluation metrics (M01-M22), each an aggregate over a prediction table.

``group_cols`` turns any metric into per-fold / per-slice / per-scenario
metrics in the same job.  Classification metrics come from the confusion
counts (classes x classes rows); AUC, ROC points and NDCG use exact prefix
sums over distinct scores, never a row-level global sort.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import null_safe_join, prefix_sums
from tessera.session import cut_lineage

EPS64 = 2.220446049250313e-16
# Metrics where lower is better (negated into a score).
LOWER_IS_BETTER = ("rmse", "mae", "mape", "msle", "hamming_loss", "log_loss")
# Tasks whose score is clipped at 0.
CLIPPED_TASKS = ("classification", "clustering", "anomaly_detection", "dimensionality_reduction")


def with_bounded(df: DataFrame, small: DataFrame) -> DataFrame:
    """Attach every row of ``small`` -- a side of proven tiny size (one
    summary row, or one row per cluster) -- to each row of ``df`` through a
    broadcast equi-join on a constant key."""
    k = "_bk_key"
    return df.withColumn(k, F.lit(0)).join(F.broadcast(small.withColumn(k, F.lit(0))), k).drop(k)


def _safe_div(a, b):
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_table(df: DataFrame, label: str, prediction: str, group_cols=()) -> DataFrame:
    """Per class: support (true count), predicted count and true positives."""
    g = list(group_cols)
    y, p = F.col(label).cast("string"), F.col(prediction).cast("string")
    cm = df.groupBy(*g, y.alias("_y"), p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    # each cell counts for its true class and for its predicted one; one pass, null classes included
    zero = F.lit(0).cast("long")
    tp = F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(zero)
    side = lambda c, s, p, t: F.struct(F.col(c).alias("cls"), s.alias("support"), p.alias("predicted"), t.alias("tp"))
    cells = cm.select(*g, F.explode(F.array(side("_y", F.col("_n"), zero, tp), side("_p", zero, F.col("_n"), zero))).alias("_c"))
    return cells.groupBy(*g, F.col("_c.cls").alias("cls")).agg(
        F.sum("_c.support").alias("support"), F.sum("_c.tp").alias("tp"), F.sum("_c.predicted").alias("predicted"))


def classification_metrics(df: DataFrame, label: str, prediction: str, group_cols=()) -> DataFrame:
    """Accuracy, balanced accuracy, weighted precision / recall / F1
    (0 on zero division), Cohen's kappa and multiclass MCC."""
    g = list(group_cols)
    c = class_table(df, label, prediction, g)
    prec = _safe_div(F.col("tp"), F.col("predicted"))
    rec = _safe_div(F.col("tp"), F.col("support"))
    f1 = _safe_div(2 * prec * rec, prec + rec)
    c = c.withColumns({"_prec": prec, "_rec": rec, "_f1": f1})
    a = c.groupBy(*g).agg(
        F.sum("support").alias("_n"), F.sum("tp").alias("_c"),
        F.sum(F.col("support") * F.col("_prec")).alias("_wp"), F.sum(F.col("support") * F.col("_rec")).alias("_wr"),
        F.sum(F.col("support") * F.col("_f1")).alias("_wf"),
        F.avg(F.when(F.col("support") > 0, F.col("_rec"))).alias("balanced_accuracy"),
        F.sum(F.col("predicted") * F.col("support")).alias("_pt"),
        F.sum(F.col("predicted") * F.col("predicted")).alias("_pp"),
        F.sum(F.col("support") * F.col("support")).alias("_tt"))
    n, cc = F.col("_n").cast("double"), F.col("_c").cast("double")
    pe = F.col("_pt") / (n * n)
    acc = cc / n
    mcc_den = F.sqrt((n * n - F.col("_pp")) * (n * n - F.col("_tt")))
    return a.select(
        *g, acc.alias("accuracy"), "balanced_accuracy", (F.col("_wp") / n).alias("precision"),
        (F.col("_wr") / n).alias("recall"), (F.col("_wf") / n).alias("f1"),
        F.when(pe == 1, F.lit(0.0)).otherwise((acc - pe) / (1 - pe)).alias("kappa"),
        _safe_div(cc * n - F.col("_pt"), mcc_den).alias("mcc"))


def _score_counts(df: DataFrame, label: str, score: str, group_cols, positive=1) -> DataFrame:
    y = (F.col(label) == F.lit(positive))
    return df.groupBy(*group_cols, F.col(score).cast("double").alias("_s")).agg(
        F.count_if(y).alias("_pos"), F.count_if(~y).alias("_neg"))


def roc_auc(df: DataFrame, label: str, score: str, group_cols=(), positive=1) -> DataFrame:
    """Binary ROC-AUC by the rank-sum rule with tie-averaged ranks:
    sum over distinct scores of pos_s * (neg_below_s + neg_s / 2) / (P * N)."""
    g = list(group_cols)
    sc = cut_lineage(_score_counts(df, label, score, g, positive))
    cum = prefix_sums(sc, "_s", ["_neg"], partition_cols=g)
    below = F.col("_neg_cum") - F.col("_neg")
    a = cum.groupBy(*g).agg(F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("_u"),
                            F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return a.select(*g, F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(None))
                    .otherwise(F.col("_u") / (F.col("_P") * F.col("_N"))).alias("roc_auc"))


def class_probabilities(df: DataFrame, label: str, probs: str, classes, keep=()) -> DataFrame:
    """(keep..., class, is_class, p): a row for each class of each row of ``df``, whose
    array ``probs`` holds the probabilities in the order of ``classes``."""
    y = F.col(label).cast("string")
    cells = [F.struct(F.lit(str(c)).alias("class"), F.coalesce((y == F.lit(str(c))), F.lit(False)).cast("int").alias("is_class"),
                      F.col(probs)[k].cast("double").alias("p")) for k, c in enumerate(classes)]
    return df.select(*keep, F.inline(F.array(*cells)))


def roc_auc_ovr(df: DataFrame, label: str, probs: str, classes, group_cols=()) -> DataFrame:
    """M05 multiclass: macro average of the one-vs-rest AUCs, all classes in one job;
    a class without positives or negatives has no AUC and no say."""
    g = list(group_cols)
    each = roc_auc(class_probabilities(df, label, probs, classes, g), "is_class", "p", [*g, "class"])
    return each.groupBy(*g).agg(F.avg("roc_auc").alias("roc_auc"))


def log_loss_classes(df: DataFrame, label: str, probs: str, classes, group_cols=(), eps: float = EPS64) -> DataFrame:
    """M07 multiclass: -mean(ln p of the true class), p as its share of the row's
    clipped probabilities; rows of an unknown class are left out."""
    clip = F.transform(F.col(probs), lambda p: F.least(F.greatest(p.cast("double"), F.lit(eps)), F.lit(1 - eps)))
    total = F.aggregate(clip, F.lit(0.0), lambda a, p: a + p)
    at = F.array_position(F.array(*[F.lit(str(c)) for c in classes]), F.col(label).cast("string"))
    p = F.when(at > 0, F.element_at(clip, at.cast("int"))) / total
    return df.groupBy(*group_cols).agg((-F.avg(F.log(p))).alias("log_loss"))


def brier_classes(df: DataFrame, label: str, probs: str, classes, group_cols=()) -> DataFrame:
    """M08 multiclass: the mean over classes of each class's mean((p - is_class)^2)."""
    g = list(group_cols)
    d = F.col("p") - F.col("is_class")
    return class_probabilities(df, label, probs, classes, g).groupBy(*g).agg(F.avg(d * d).alias("brier"))


def roc_curve(df: DataFrame, label: str, score: str, group_cols=(), positive=1) -> DataFrame:
    """One point per distinct threshold: fpr, tpr of score >= threshold."""
    g = list(group_cols)
    sc = cut_lineage(_score_counts(df, label, score, g, positive).withColumn("_neg_s", -F.col("_s")))
    cum = prefix_sums(sc, "_neg_s", ["_pos", "_neg"], partition_cols=g)
    tot = sc.groupBy(*g).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    j = cum.join(F.broadcast(tot), g) if g else with_bounded(cum, tot)
    return j.select(*g, F.col("_s").alias("threshold"), _safe_div(F.col("_neg_cum"), F.col("_N")).alias("fpr"),
                    _safe_div(F.col("_pos_cum"), F.col("_P")).alias("tpr"))


def log_loss(df: DataFrame, label: str, prob: str, group_cols=(), eps: float = EPS64) -> DataFrame:
    """M07 (binary): -mean(y ln p + (1 - y) ln(1 - p)), p clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(prob).cast("double"), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.groupBy(*group_cols).agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def brier(df: DataFrame, label: str, prob: str, group_cols=()) -> DataFrame:
    """M08 (binary): mean((p - y)^2)."""
    d = F.col(prob).cast("double") - F.col(label).cast("double")
    return df.groupBy(*group_cols).agg(F.avg(d * d).alias("brier"))


def multilabel_metrics(df: DataFrame, label_cols, pred_cols, group_cols=()) -> DataFrame:
    """Micro precision / recall / F1 (0 on zero division), subset
    accuracy and Hamming loss over several 0/1 label columns."""
    tps = [F.when((F.col(l) == 1) & (F.col(p) == 1), 1).otherwise(0) for l, p in zip(label_cols, pred_cols)]
    fps = [F.when((F.col(l) != 1) & (F.col(p) == 1), 1).otherwise(0) for l, p in zip(label_cols, pred_cols)]
    fns = [F.when((F.col(l) == 1) & (F.col(p) != 1), 1).otherwise(0) for l, p in zip(label_cols, pred_cols)]
    mism = [F.when(F.col(l) != F.col(p), 1).otherwise(0) for l, p in zip(label_cols, pred_cols)]

    def total(xs):
        out = xs[0]
        for x in xs[1:]:
            out = out + x
        return out
    a = df.groupBy(*group_cols).agg(
        F.sum(total(tps)).alias("_tp"), F.sum(total(fps)).alias("_fp"), F.sum(total(fns)).alias("_fn"),
        F.avg(F.when(total(mism) == 0, 1.0).otherwise(0.0)).alias("subset_accuracy"),
        F.avg(total(mism) / F.lit(float(len(label_cols)))).alias("hamming_loss"))
    tp, fp, fn = F.col("_tp").cast("double"), F.col("_fp").cast("double"), F.col("_fn").cast("double")
    return a.select(*group_cols, "subset_accuracy", _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
                    _safe_div(tp, tp + fp).alias("precision_micro"), _safe_div(tp, tp + fn).alias("recall_micro"),
                    "hamming_loss")


def regression_metrics(df: DataFrame, label: str, prediction: str, group_cols=()) -> DataFrame:
    """Rmse, mae, mse, r2, explained variance, MAPE (eps-floored
    denominator) and MSLE (predictions clipped at 0; any negative truth -> 0)."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    r = y - p
    pc = F.greatest(p, F.lit(0.0))
    a = df.groupBy(*group_cols).agg(
        F.avg(r * r).alias("mse"), F.avg(F.abs(r)).alias("mae"), F.var_pop(y).alias("_vy"),
        F.var_pop(r).alias("_vr"), F.sum(r * r).alias("_ssr"), F.count(F.lit(1)).alias("_n"),
        F.avg(F.abs(r) / F.greatest(F.abs(y), F.lit(EPS64))).alias("mape"),
        F.avg((F.log1p(y) - F.log1p(pc)) * (F.log1p(y) - F.log1p(pc))).alias("_msle"),
        F.min(y).alias("_ymin"))
    sst = F.col("_vy") * F.col("_n")
    return a.select(
        *group_cols, F.sqrt("mse").alias("rmse"), "mae", "mse",
        F.when(sst == 0, F.lit(0.0)).otherwise(1 - F.col("_ssr") / sst).alias("r2"),
        F.when(F.col("_vy") == 0, F.lit(0.0)).otherwise(1 - F.col("_vr") / F.col("_vy")).alias("explained_variance"),
        "mape", F.when(F.col("_ymin") < 0, F.lit(0.0)).otherwise(F.col("_msle")).alias("msle"))


def median_absolute_error(df: DataFrame, label: str, prediction: str, group_cols=()) -> DataFrame:
    """Exact median of |y - p| (interpolated)."""
    from tessera.operators.aggregates import exact_median
    d = df.withColumn("_ae", F.abs(F.col(label).cast("double") - F.col(prediction).cast("double")))
    return exact_median(d, "_ae", group_cols, "median_ae")


#: Positions summed one by one; longer runs are differences of the prefix sum.
_DIRECT = 1024


def _discount_prefix(n):
    """Sum of 1/log2(i + 1) for i = 1..n, n >= ``_DIRECT``, without enumerating
    positions: Euler-Maclaurin, the integral by Gauss-Legendre on spans that
    double, so the work is constant for any n (relative error below 1e-9)."""
    f = lambda x: 1.0 / math.log2(x + 1)
    slope = lambda x: -math.log(2) / ((x + 1) * math.log(x + 1) ** 2)
    nodes, weights = np.polynomial.legendre.leggauss(12)
    edges = [_DIRECT * 2 ** k for k in range(44)]
    area = [0.0]
    for a, b in zip(edges, edges[1:]):
        area.append(area[-1] + (b - a) / 2 * sum(w * f((a + b) / 2 + (b - a) / 2 * x) for x, w in zip(nodes, weights)))
    start = sum(f(i) for i in range(1, _DIRECT + 1)) - f(_DIRECT) / 2 - slope(_DIRECT) / 12
    x = n.cast("double")
    span = F.greatest(F.lit(0), F.floor(F.log2(x / _DIRECT) + 1e-9)).cast("int")
    low = F.get(F.array(*[F.lit(float(e)) for e in edges]), span)
    g = lambda v: F.lit(math.log(2)) / F.log(v + 1)
    part = sum((F.lit(float(w)) * g((low + x) / 2 + (x - low) / 2 * float(t)) for t, w in zip(nodes, weights)), F.lit(0.0))
    return (F.lit(start) + F.get(F.array(*[F.lit(a) for a in area]), span) + (x - low) / 2 * part + g(x) / 2
            - F.lit(math.log(2)) / ((x + 1) * F.pow(F.log(x + 1), F.lit(2.0))) / 12)


def _discounts(first, last):
    """Sum of 1/log2(pos + 1) over positions first..last in constant memory."""
    direct = lambda a, b: F.when(a > b, F.lit(0.0)).otherwise(F.aggregate(
        F.sequence(a, F.greatest(a, b)), F.lit(0.0), lambda acc, pos: acc + F.lit(1.0) / F.log2(pos + F.lit(1))))
    head = F.lit(_DIRECT).cast("long")
    short = last - first < _DIRECT
    return (F.when(short, direct(first, F.least(last, first + _DIRECT)))
            .when(first > _DIRECT, _discount_prefix(last) - _discount_prefix(first - 1))
            .otherwise(direct(first, F.least(last, head)) + _discount_prefix(last) - _discount_prefix(head)))


def _tie_dcg(df: DataFrame, group_cols, score: str, rel: str, name: str) -> DataFrame:
    """Sum over tie groups (equal score, ranked descending) of the group's
    mean gain times the sum of 1/log2(pos + 1) over its positions."""
    g = list(group_cols)
    t = df.groupBy(*g, F.col(score).cast("double").alias("_s")).agg(
        F.count(F.lit(1)).alias("_m"), F.sum(F.col(rel).cast("double")).alias("_g"))
    t = cut_lineage(t.withColumn("_neg_s", -F.col("_s")))
    cum = prefix_sums(t, "_neg_s", ["_m"], partition_cols=g)
    cum = cum.withColumn("_d", (F.col("_g") / F.col("_m")) * _discounts(F.col("_m_cum") - F.col("_m") + 1, F.col("_m_cum")))
    return cum.groupBy(*g).agg(F.sum("_d").alias(name))


def ndcg(df: DataFrame, label: str, score: str, query_cols=(), group_cols=()) -> DataFrame:
    """Mean over queries of DCG / ideal DCG with linear gains and
    tie-averaged ranks; a query with no relevant item scores 0.  Without
    ``query_cols`` the whole table is one query (as in the reference)."""
    q = [*group_cols, *query_cols]
    if not q:
        d = df.withColumn("_q", F.lit(0))
        q = ["_q"]
    else:
        d = df
    dcg = _tie_dcg(d, q, score, label, "_dcg")
    idcg = _tie_dcg(d, q, label, label, "_idcg")
    j = null_safe_join(dcg, idcg, q)
    per = j.select(*q, F.when(F.col("_idcg") == 0, F.lit(0.0)).otherwise(F.col("_dcg") / F.col("_idcg")).alias("_nd"))
    return per.groupBy(*group_cols).agg(F.avg("_nd").alias("ndcg"))


def _vec(col):
    return F.transform(F.col(col), lambda x: x.cast("double"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _centroids(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Per cluster: size, mean vector (exact, dimension-wise) and mean squared norm."""
    long = df.select(F.col(cluster).alias("_c"), F.posexplode(_vec(features)).alias("_i", "_x"))
    means = long.groupBy("_c", "_i").agg(F.avg("_x").alias("_mu"))
    cen = means.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_i", "_mu"))).alias("_e"))
    cen = cen.select("_c", F.transform("_e", lambda e: e["_mu"]).alias("_mu"))
    sizes = df.groupBy(F.col(cluster).alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(_dot(_vec(features), _vec(features))).alias("_sq"))
    return cen.join(sizes, "_c")


def silhouette_sqeuclidean(df: DataFrame, features: str, cluster: str, id_col: str) -> DataFrame:
    """M15 (squared Euclidean, exact, no pairs): mean squared distance from x
    to cluster C is |x|^2 - 2 x.mu_C + mean_C |y|^2; own cluster excludes x
    (scaled by n/(n-1)); singleton clusters score 0; one cluster -> -1.
    Cluster summaries are k rows (broadcast)."""
    cen = _centroids(df, features, cluster)
    k = cen.count()
    if k < 2:
        return df.sparkSession.createDataFrame([(-1.0,)], "silhouette_sqeuclidean double")
    pts = df.select(F.col(id_col).alias("_id"), F.col(cluster).alias("_own"),
                    _vec(features).alias("_x"))
    pts = pts.withColumn("_xx", _dot(F.col("_x"), F.col("_x")))
    j = with_bounded(pts, cen)  # k cluster rows
    j = j.withColumn("_d", F.col("_xx") - 2 * _dot(F.col("_x"), F.col("_mu")) + F.col("_sq"))
    per = j.groupBy("_id", "_own").agg(
        F.max(F.when(F.col("_c") == F.col("_own"), F.col("_d") * F.col("_n") / (F.col("_n") - 1))).alias("_a"),
        F.max(F.when(F.col("_c") == F.col("_own"), F.col("_n"))).alias("_na"),
        F.min(F.when(F.col("_c") != F.col("_own"), F.col("_d"))).alias("_b"))
    s = F.when(F.col("_na") <= 1, F.lit(0.0)).otherwise(
        (F.col("_b") - F.col("_a")) / F.greatest(F.col("_a"), F.col("_b")))
    return per.agg(F.avg(s).alias("silhouette_sqeuclidean"))


def cluster_separation(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and the number of clusters
    (-1 scores for a single cluster)."""
    cen = _centroids(df, features, cluster)
    spark = df.sparkSession
    k = cen.count()
    if k < 2:
        return spark.createDataFrame([(-1.0, -1.0, int(k))], "calinski_harabasz double, davies_bouldin double, n_clusters long")
    pts = df.select(F.col(cluster).alias("_c"), _vec(features).alias("_x"))
    j = pts.join(F.broadcast(cen.select("_c", "_mu")), "_c")
    diff = F.zip_with(F.col("_x"), F.col("_mu"), lambda a, b: a - b)
    j = j.withColumn("_w", _dot(diff, diff))
    within = j.groupBy("_c").agg(F.sum("_w").alias("_W"), F.avg(F.sqrt("_w")).alias("_s"))
    # global mean = size-weighted centroid mean
    n_total = F.sum("_n")
    dims = cen.select(F.posexplode("_mu").alias("_i", "_m"), "_n").groupBy("_i").agg(
        (F.sum(F.col("_m") * F.col("_n")) / n_total).alias("_g"))
    g = dims.agg(F.array_sort(F.collect_list(F.struct("_i", "_g"))).alias("_e")).select(
        F.transform("_e", lambda e: e["_g"]).alias("_gm"))
    cg = with_bounded(cen, g)  # one row
    gd = F.zip_with(F.col("_mu"), F.col("_gm"), lambda a, b: a - b)
    between = cg.select("_c", "_n", "_mu", (F.col("_n") * _dot(gd, gd)).alias("_B"))
    stats = between.join(within, "_c")
    tot = stats.agg(F.sum("_B").alias("B"), F.sum("_W").alias("W"), F.sum("_n").alias("n")).first()
    n = tot["n"]
    ch = (tot["B"] / (k - 1)) / (tot["W"] / (n - k)) if tot["W"] else 1.0
    a = stats.select(F.col("_c").alias("_c1"), F.col("_mu").alias("_m1"), F.col("_s").alias("_s1"))
    b = stats.select(F.col("_c").alias("_c2"), F.col("_mu").alias("_m2"), F.col("_s").alias("_s2"))
    pairs = a.join(F.broadcast(b), F.col("_c1") != F.col("_c2"))  # k x k cluster pairs
    md = F.zip_with(F.col("_m1"), F.col("_m2"), lambda x, y: x - y)
    pairs = pairs.withColumn("_r", (F.col("_s1") + F.col("_s2")) / F.sqrt(_dot(md, md)))
    db = pairs.groupBy("_c1").agg(F.max("_r").alias("_rmax")).agg(F.avg("_rmax").alias("db")).first()["db"]
    return spark.createDataFrame([(float(ch), float(db), int(k))],
                                 "calinski_harabasz double, davies_bouldin double, n_clusters long")


def anomaly_metrics(df: DataFrame, label: str | None, prediction: str, group_cols=()) -> DataFrame:
    """Anomaly count and ratio (prediction -1 = anomaly); with 0/1 truth
    also accuracy and F1 of the mapped predictions."""
    is_anom = F.col(prediction) == -1
    aggs = [F.count_if(is_anom).alias("n_anomalies"), F.avg(is_anom.cast("double")).alias("anomaly_ratio")]
    if label:
        mapped = F.when(is_anom, 1).otherwise(0)
        y = F.col(label).cast("int")
        aggs += [F.avg((mapped == y).cast("double")).alias("accuracy"),
                 F.sum(F.when((mapped == 1) & (y == 1), 1).otherwise(0)).alias("_tp"),
                 F.sum(F.when((mapped == 1) & (y != 1), 1).otherwise(0)).alias("_fp"),
                 F.sum(F.when((mapped != 1) & (y == 1), 1).otherwise(0)).alias("_fn")]
    a = df.groupBy(*group_cols).agg(*aggs)
    if label:
        tp, fp, fn = F.col("_tp").cast("double"), F.col("_fp").cast("double"), F.col("_fn").cast("double")
        a = a.withColumn("f1", _safe_div(2 * tp, 2 * tp + fp + fn)).drop("_tp", "_fp", "_fn")
    return a


def mean_score(df: DataFrame, score: str, group_cols=()) -> DataFrame:
    """Mean decision score."""
    return df.groupBy(*group_cols).agg(F.avg(score).alias("mean_score"))


def to_long(wide: DataFrame, group_cols=()) -> DataFrame:
    """Metric row(s) -> (group..., metric, value)."""
    vals = [c for c in wide.columns if c not in group_cols]
    return wide.select(*group_cols, *[F.col(c).cast("double").alias(c) for c in vals]).unpivot(
        list(group_cols), vals, "metric", "value")


def cv_mean(long: DataFrame, fold_col: str = "fold") -> DataFrame:
    """Mean of each metric over folds."""
    return long.groupBy("metric").agg(F.avg("value").alias("value"), F.countDistinct(fold_col).alias("folds"))


def orient_score(metric: str, value, task: str):
    """Negate lower-is-better metrics; clip at 0 for four tasks."""
    v = F.lit(value) if not isinstance(value, F.Column) else value
    if metric in LOWER_IS_BETTER:
        v = -v
    if task in CLIPPED_TASKS:
        v = F.greatest(F.lit(0.0), v)
    return v


def explained_variance(eigenvalues, total: float) -> dict[str, float]:
    """Variance along the kept components, summed, and its share of all variance."""
    kept = float(sum(eigenvalues))
    return {"explained_variance": kept, "explained_variance_ratio": kept / total if total else 0.0}


def evaluate(pred: DataFrame, task: str, label: str | None, prediction: str, score: str | None = None,
             group_cols=(), probs: str | None = None, classes=()) -> DataFrame:
    """Long metric table for a task: (group..., metric, value).  ``score`` is the
    probability of class 1; with ``probs``, an array over ``classes``, come the AUC one
    against the rest, the log loss and the Brier score of all classes."""
    g = list(group_cols)
    if task == "classification":
        wide = classification_metrics(pred, label, prediction, g)
        for f in (roc_auc_ovr, log_loss_classes, brier_classes) if probs else ():
            more = f(pred, label, probs, classes, g)
            wide = wide.join(more, g, "left") if g else with_bounded(wide, more)
        if score:
            auc = roc_auc(pred, label, score, g)
            wide = wide.join(auc, g, "left") if g else with_bounded(wide, auc)
    elif task in ("regression", "time_series", "ranking"):
        wide = regression_metrics(pred, label, prediction, g)
        med = median_absolute_error(pred, label, prediction, g)
        wide = wide.join(med, g) if g else with_bounded(wide, med)
    elif task == "anomaly_detection":
        wide = anomaly_metrics(pred, label, prediction, g)
    else:
        raise ValueError(f"unsupported task {task}")
    return to_long(wide, g)
