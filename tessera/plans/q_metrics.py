"""Metric queries (M01-M22) over prediction tables derived by rule from the
driver tables -- no training -- so SQL can check them independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.split import kfold
from tessera.plans.q_split import _fold_sql, _h
from tessera.plans.registry import register
from tessera.plans.q_aggregates import lineitem_row_id
from tessera.session import table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _round_all(df, keep=()):
    return df.select(*[F.col(c) if c in keep else F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns])


_PRED = "CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END"


def class_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    pred = F.when(q < 17, F.lit("A")).when(q < 34, F.lit("N")).otherwise(F.lit("R"))
    return li.select(lineitem_row_id().alias("row_id"),
                     F.col("l_returnflag").alias("label"), pred.alias("prediction"),
                     F.when(F.col("l_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("l_linestatus")).alias("linestatus"),
                     F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_r"),
                     (F.col("l_discount") * 10).alias("score"))


def _class_sql(src, group=None, px=""):
    """CTEs computing the classification metrics of (y, p) rows in ``src``;
    the last CTE is ``{px}r``.  ``px`` prefixes every CTE name."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    on = f" AND t.{group} = pr.{group}" if group else ""
    gsel = f"coalesce(t.{group}, pr.{group}) AS {group}, " if group else ""
    return f"""
{px}cm AS (SELECT {g}y, p, count(*) AS n FROM {src} s GROUP BY ALL),
{px}t AS (SELECT {g}y AS cls, sum(n) AS support, sum(CASE WHEN y = p THEN n ELSE 0 END) AS tp FROM {px}cm GROUP BY ALL),
{px}pr AS (SELECT {g}p AS cls, sum(n) AS predicted FROM {px}cm GROUP BY ALL),
{px}c AS (SELECT {gsel}coalesce(t.cls, pr.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
             coalesce(predicted, 0) AS predicted FROM {px}t t FULL OUTER JOIN {px}pr pr ON t.cls = pr.cls{on}),
{px}m AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS prec,
             CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rec FROM {px}c),
{px}f AS (SELECT *, CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM {px}m),
{px}a AS (SELECT {g}CAST(sum(support) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS c, sum(support * prec) AS wp,
             sum(support * rec) AS wr, sum(support * f1) AS wf, avg(CASE WHEN support > 0 THEN rec END) AS bal,
             CAST(sum(predicted * support) AS DOUBLE) AS pt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp,
             CAST(sum(support * support) AS DOUBLE) AS tt FROM {px}f {gb}),
{px}r AS (SELECT {g}c / n AS accuracy, bal AS balanced_accuracy, wp / n AS precision, wr / n AS recall, wf / n AS f1,
             CASE WHEN pt / (n * n) = 1 THEN 0.0 ELSE (c / n - pt / (n * n)) / (1 - pt / (n * n)) END AS kappa,
             CASE WHEN sqrt((n * n - pp) * (n * n - tt)) = 0 THEN 0.0
                  ELSE (c * n - pt) / sqrt((n * n - pp) * (n * n - tt)) END AS mcc FROM {px}a)"""


_CLS_SRC = f"(SELECT l_returnflag AS y, {_PRED} AS p FROM lineitem)"
_CLS_COLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "kappa", "mcc"]


@register("M01_classification_metrics", "WITH " + _class_sql(_CLS_SRC) + "\nSELECT " +
          ", ".join(f"round({c}, 6) AS {c}" for c in _CLS_COLS) + " FROM r")
def m01(spark, sf):
    return _round_all(M.classification_metrics(class_preds(spark, sf), "label", "prediction"))


_BIN = "(SELECT CAST(l_discount * 10 AS DOUBLE) AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"


@register("M05_roc_auc", f"""
WITH c AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {_BIN} b GROUP BY s),
k AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM k""")
def m05(spark, sf):
    return _round_all(M.roc_auc(class_preds(spark, sf), "is_r", "score"))


@register("M06_roc_curve", f"""
WITH c AS (SELECT s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {_BIN} b GROUP BY s),
k AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM c)
SELECT round(s, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM k""")
def m06(spark, sf):
    return _round_all(M.roc_curve(class_preds(spark, sf), "is_r", "score"))


@register("M07_log_loss", f"""
SELECT round(-avg(y * ln(least(greatest(s, {M.EPS64!r}), 1 - {M.EPS64!r}))
                  + (1 - y) * ln(1 - least(greatest(s, {M.EPS64!r}), 1 - {M.EPS64!r}))), 6) AS log_loss FROM {_BIN} b""")
def m07(spark, sf):
    return _round_all(M.log_loss(class_preds(spark, sf), "is_r", "score"))


@register("M08_brier", f"SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM {_BIN} b")
def m08(spark, sf):
    return _round_all(M.brier(class_preds(spark, sf), "is_r", "score"))


CLASSES = ("A", "N", "R")
_PROBS = """(SELECT l_returnflag AS y, a / (a + n + r) AS pa, n / (a + n + r) AS pn, r / (a + n + r) AS pr FROM
  (SELECT l_returnflag, 0.1 + CAST(l_discount AS DOUBLE) AS a, 0.1 + CAST(l_tax AS DOUBLE) AS n, 0.1 + CAST(l_quantity AS DOUBLE) / 50 AS r FROM lineitem) w)"""


def class_probs(spark, sf):
    """Three classes with an array of probabilities."""
    w = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), (0.1 + F.col("l_discount").cast("double")).alias("a"),
                                            (0.1 + F.col("l_tax").cast("double")).alias("n"), (0.1 + F.col("l_quantity").cast("double") / 50).alias("r"))
    total = F.col("a") + F.col("n") + F.col("r")
    return w.select("label", F.array(*[F.col(c) / total for c in "anr"]).alias("probs"))


@register("M05_roc_auc_ovr", f"""
WITH s AS (SELECT unnest(['A', 'N', 'R']) AS cls, y, unnest([pa, pn, pr]) AS s FROM {_PROBS} b),
c AS (SELECT cls, s, count(*) FILTER (WHERE y = cls) AS pos, count(*) FILTER (WHERE y <> cls) AS neg FROM s GROUP BY cls, s),
k AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c),
u AS (SELECT cls, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM k GROUP BY cls)
SELECT round(avg(auc), 6) AS roc_auc FROM u""")
def m05_ovr(spark, sf):
    return _round_all(M.roc_auc_ovr(class_probs(spark, sf), "label", "probs", CLASSES))


@register("M07_log_loss_classes", f"""
SELECT round(-avg(ln(CASE y WHEN 'A' THEN pa WHEN 'N' THEN pn WHEN 'R' THEN pr END / (pa + pn + pr))), 6) AS log_loss FROM {_PROBS} b""")
def m07_classes(spark, sf):
    return _round_all(M.log_loss_classes(class_probs(spark, sf), "label", "probs", CLASSES))


@register("M08_brier_classes", f"""
SELECT round(avg(((pa - (y = 'A')::INT) ^ 2 + (pn - (y = 'N')::INT) ^ 2 + (pr - (y = 'R')::INT) ^ 2) / 3), 6) AS brier FROM {_PROBS} b""")
def m08_classes(spark, sf):
    return _round_all(M.brier_classes(class_probs(spark, sf), "label", "probs", CLASSES))


@register("M19_explained_variance", """
WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
s AS (SELECT i, var_samp(CAST(v AS DOUBLE)) AS s FROM x GROUP BY i)
SELECT round(sum(s), 6) AS explained_variance, 1.0 AS explained_variance_ratio FROM s""")
def m19(spark, sf):
    """All components together explain all variance."""
    from tessera.plans.ensembles import gram_components
    e = table(spark, sf, "embeddings")
    found = gram_components(e, "embedding", centred=True)
    row = M.explained_variance(found.values, found.total)
    return _round_all(spark.createDataFrame([tuple(row.values())], "explained_variance double, explained_variance_ratio double"))


@register("M09_multilabel_metrics", """
WITH d AS (SELECT l.quality, l.toxic, CASE WHEN d.n_chars > 500 THEN 1 ELSE 0 END AS pq,
                  CASE WHEN d.source = 'src0' THEN 1 ELSE 0 END AS pt FROM labels l JOIN documents d USING (doc_id)),
a AS (SELECT sum((quality = 1 AND pq = 1)::INT + (toxic = 1 AND pt = 1)::INT) AS tp,
             sum((quality <> 1 AND pq = 1)::INT + (toxic <> 1 AND pt = 1)::INT) AS fp,
             sum((quality = 1 AND pq <> 1)::INT + (toxic = 1 AND pt <> 1)::INT) AS fn,
             avg(CASE WHEN quality = pq AND toxic = pt THEN 1.0 ELSE 0.0 END) AS subset_accuracy,
             avg(((quality <> pq)::INT + (toxic <> pt)::INT) / 2.0) AS hamming_loss FROM d)
SELECT round(subset_accuracy, 6) AS subset_accuracy, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_micro,
       round(tp / (tp + fp), 6) AS precision_micro, round(tp / (tp + fn), 6) AS recall_micro,
       round(hamming_loss, 6) AS hamming_loss FROM a""")
def m09(spark, sf):
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("pq"),
        F.when(F.col("source") == "src0", 1).otherwise(0).alias("pt"))
    return _round_all(M.multilabel_metrics(lab.join(doc, "doc_id"), ["quality", "toxic"], ["pq", "pt"]))


def reg_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(lineitem_row_id().alias("row_id"),
                     (F.col("l_extendedprice") / 1000.0).alias("y"), (F.col("l_quantity") * 1.5).alias("p"))


_REG = "(SELECT l_extendedprice / 1000.0 AS y, l_quantity * 1.5 AS p FROM lineitem)"


@register("M10_regression_metrics", f"""
SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae,
       round(avg((y - p) * (y - p)), 6) AS mse,
       round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
       round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance,
       round(avg(abs(y - p) / greatest(abs(y), {M.EPS64!r})), 6) AS mape,
       round(CASE WHEN min(y) < 0 THEN 0.0 ELSE avg((ln(1 + y) - ln(1 + greatest(p, 0))) ^ 2) END, 6) AS msle
FROM {_REG} r""")
def m10(spark, sf):
    return _round_all(M.regression_metrics(reg_preds(spark, sf), "y", "p"))


@register("M11_median_absolute_error", f"SELECT round(quantile_cont(abs(y - p), 0.5), 6) AS median_ae FROM {_REG} r")
def m11(spark, sf):
    return _round_all(M.median_absolute_error(reg_preds(spark, sf), "y", "p"))


def _dcg_sql(name, src, score):
    return f"""
{name}_t AS (SELECT q, {score} AS s, count(*) AS m, sum(rel) AS g FROM {src} GROUP BY q, {score}),
{name}_c AS (SELECT *, sum(m) OVER (PARTITION BY q ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
             FROM {name}_t),
{name} AS (SELECT q, sum(g / m * list_sum(list_transform(range(CAST(cum - m + 1 AS BIGINT), CAST(cum + 1 AS BIGINT)), lambda x: 1.0 / log2(x + 1)))) AS v
           FROM {name}_c GROUP BY q)"""


@register("M14_ndcg", """
WITH d AS (SELECT o_custkey AS q, o_totalprice / 100000.0 AS rel,
                  CAST(6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS DOUBLE) AS sc FROM orders),""" +
          _dcg_sql("dcg", "d", "sc") + "," + _dcg_sql("idcg", "d", "rel") + """
SELECT round(avg(CASE WHEN idcg.v = 0 THEN 0.0 ELSE dcg.v / idcg.v END), 6) AS ndcg FROM dcg JOIN idcg USING (q)""")
def m14(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey", (F.col("o_totalprice") / 100000.0).alias("rel"),
        (6 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("double").alias("sc"))
    return _round_all(M.ndcg(o, "rel", "sc", query_cols=["o_custkey"]))


_EMB_SQL = """p AS (SELECT vec_id, label AS c, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS (SELECT vec_id, c, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM p),
mu AS (SELECT c, i, avg(v) AS m FROM e GROUP BY c, i),
cen AS (SELECT c, list(m ORDER BY i) AS mu FROM mu GROUP BY c),
sz AS (SELECT c, count(*) AS n, avg(list_dot_product(x, x)) AS sq FROM p GROUP BY c),
cs AS (SELECT * FROM cen JOIN sz USING (c))"""


@register("M15_silhouette_sqeuclidean", f"""
WITH {_EMB_SQL},
d AS (SELECT p.vec_id, p.c AS own, cs.c, cs.n,
             list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, cs.mu) + cs.sq AS d FROM p, cs),
per AS (SELECT vec_id, max(CASE WHEN c = own THEN d * n / (n - 1) END) AS a, max(CASE WHEN c = own THEN n END) AS na,
               min(CASE WHEN c <> own THEN d END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN na <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette_sqeuclidean FROM per""")
def m15(spark, sf):
    e = table(spark, sf, "embeddings")
    return _round_all(M.silhouette_sqeuclidean(e, "embedding", "label", "vec_id"))


@register("M16_cluster_separation", f"""
WITH {_EMB_SQL},
g AS (SELECT i, sum(m * n) / sum(n) AS gm FROM mu JOIN sz USING (c) GROUP BY i),
bc AS (SELECT c, sum((m - gm) * (m - gm)) AS ss FROM mu JOIN g USING (i) GROUP BY c),
bw AS (SELECT sum(n * ss) AS B FROM bc JOIN sz USING (c)),
w AS (SELECT p.c, sum(list_distance(p.x, cen.mu) ^ 2) AS W, avg(list_distance(p.x, cen.mu)) AS s
      FROM p JOIN cen USING (c) GROUP BY p.c),
tot AS (SELECT sum(W) AS W, (SELECT count(*) FROM p) AS n, (SELECT count(*) FROM cen) AS k FROM w),
pr AS (SELECT a.c, max((wa.s + wb.s) / list_distance(a.mu, b.mu)) AS r
       FROM cen a JOIN cen b ON a.c <> b.c JOIN w wa ON wa.c = a.c JOIN w wb ON wb.c = b.c GROUP BY a.c)
SELECT round((bw.B / (tot.k - 1)) / (tot.W / (tot.n - tot.k)), 6) AS calinski_harabasz,
       round((SELECT avg(r) FROM pr), 6) AS davies_bouldin, CAST(tot.k AS BIGINT) AS n_clusters FROM bw, tot""")
def m16(spark, sf):
    r = M.cluster_separation(table(spark, sf, "embeddings"), "embedding", "label")
    return r.select(_r6("calinski_harabasz"), _r6("davies_bouldin"), "n_clusters")


@register("M17_anomaly_metrics", """
WITH d AS (SELECT CASE WHEN l_orderkey % 997 = 0 THEN 1 ELSE 0 END AS y,
                  CASE WHEN l_quantity > 48 THEN -1 ELSE 1 END AS p FROM lineitem),
m AS (SELECT *, CASE WHEN p = -1 THEN 1 ELSE 0 END AS pm FROM d)
SELECT CAST(count(*) FILTER (WHERE p = -1) AS BIGINT) AS n_anomalies, round(avg((p = -1)::INT), 6) AS anomaly_ratio,
       round(avg((pm = y)::INT), 6) AS accuracy,
       round(CASE WHEN 2 * sum(pm * y) + sum(pm * (1 - y)) + sum((1 - pm) * y) = 0 THEN 0.0 ELSE
             2.0 * sum(pm * y) / (2 * sum(pm * y) + sum(pm * (1 - y)) + sum((1 - pm) * y)) END, 6) AS f1 FROM m""")
def m17(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.when(F.col("l_orderkey") % 997 == 0, 1).otherwise(0).alias("y"),
        F.when(F.col("l_quantity") > 48, -1).otherwise(1).alias("p"))
    r = M.anomaly_metrics(li, "y", "p")
    return r.select(F.col("n_anomalies").cast("long"), _r6("anomaly_ratio"), _r6("accuracy"), _r6("f1"))


@register("M18_mean_score", "SELECT round(avg(l_extendedprice / 1000.0 - 30), 6) AS mean_score FROM lineitem")
def m18(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", F.col("l_extendedprice") / 1000.0 - 30)
    return _round_all(M.mean_score(li, "s"))


@register("M20_cv_mean", f"""
WITH s AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, l_returnflag AS y, {_PRED} AS p FROM lineitem),
rk AS (SELECT *, row_number() OVER (ORDER BY {_h('row_id', salt='kfold')}, row_id) - 1 AS r0, count(*) OVER () AS nn FROM s),
fo AS (SELECT y, p, {_fold_sql('r0', 'nn', 5)} AS fold FROM rk),
{_class_sql('fo', 'fold')}
SELECT metric, round(avg(value), 5) AS value, CAST(count(DISTINCT fold) AS BIGINT) AS folds FROM (
  UNPIVOT r ON {", ".join(_CLS_COLS)} INTO NAME metric VALUE value) u GROUP BY metric""")
def m20(spark, sf):
    d = kfold(class_preds(spark, sf), 5, "row_id", shuffle=True, seed=42)
    per_fold = M.to_long(M.classification_metrics(d, "label", "prediction", ["fold"]), ["fold"])
    r = M.cv_mean(per_fold, "fold")
    # A mean of per-fold means: the two engines sum the five folds in a
    # different order, so the comparison is made at 5 decimals on both sides.
    return r.select("metric", F.round("value", 5).alias("value"), F.col("folds").cast("long"))


@register("M21_score_orientation", f"""
WITH m AS (SELECT sqrt(avg((y - p) * (y - p))) AS rmse, avg(abs(y - p)) AS mae,
                  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM {_REG} r)
SELECT metric, round(CASE WHEN metric IN ('rmse', 'mae') THEN -value ELSE value END, 6) AS score
FROM (UNPIVOT m ON rmse, mae, r2 INTO NAME metric VALUE value) u""")
def m21(spark, sf):
    long = M.to_long(M.regression_metrics(reg_preds(spark, sf), "y", "p").select("rmse", "mae", "r2"))
    score = F.when(F.col("metric").isin(*M.LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    return long.select("metric", F.round(score, 6).alias("score"))


@register("M22_pred_vs_actual", f"""
SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, round(l_extendedprice / 1000.0, 6) AS y,
       round(l_quantity * 1.5, 6) AS p, round(l_extendedprice / 1000.0 - l_quantity * 1.5, 6) AS residual FROM lineitem""")
def m22(spark, sf):
    r = reg_preds(spark, sf)
    return r.select("row_id", _r6("y"), _r6("p"), F.round(F.col("y") - F.col("p"), 6).alias("residual"))
