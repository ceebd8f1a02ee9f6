"""Neighbour and model queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import neighbors as NB
from tessera.operators.features import FeaturePipeline
from tessera.operators.split import random_split
from tessera.plans.models import make_estimator
from tessera.plans.registry import register
from tessera.plans.q_aggregates import lineitem_row_id
from tessera.session import cut_lineage, table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def embeddings_knn(spark, sf, k=5):
    e = table(spark, sf, "embeddings")
    return NB.knn(e, e, k=k, qid="vec_id", rid="vec_id", qvec="embedding", rvec="embedding", exclude_self=True)


_KNN_SQL = """p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.x, b.x) AS distance
      FROM p a JOIN p b ON a.vec_id <> b.vec_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
       WHERE rank <= 5)"""


@register("E07_knn_join", f"""
WITH {_KNN_SQL}
SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM nn""")
def e07(spark, sf):
    return embeddings_knn(spark, sf).select("query_id", "neighbor_id", "rank", _r6("distance"))


@register("L09_knn_classifier", f"""
WITH {_KNN_SQL},
v AS (SELECT query_id, p.label, count(*) AS votes FROM nn JOIN p ON p.vec_id = nn.neighbor_id GROUP BY ALL)
SELECT query_id, CAST(arg_min(label, (-votes, label)) AS INTEGER) AS prediction FROM v GROUP BY query_id""")
def l09(spark, sf):
    nn = embeddings_knn(spark, sf)
    pred = NB.knn_classify(nn, table(spark, sf, "embeddings"), "vec_id", "label")
    return pred.select("query_id", F.col("prediction").cast("int"))


@register("L25_knn_regressor", f"""
WITH {_KNN_SQL}
SELECT query_id, round(avg(p.x[1]), 6) AS prediction FROM nn JOIN p ON p.vec_id = nn.neighbor_id GROUP BY query_id""")
def l25(spark, sf):
    nn = embeddings_knn(spark, sf)
    t = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("y"))
    return NB.knn_regress(nn, t, "vec_id", "y").select("query_id", _r6("prediction"))


@register("L37_local_outlier_factor", f"""
WITH {_KNN_SQL},
kd AS (SELECT query_id AS neighbor_id, distance AS kdist FROM nn WHERE rank = 5),
r AS (SELECT nn.query_id, greatest(kd.kdist, nn.distance) AS reach FROM nn JOIN kd USING (neighbor_id)),
lrd AS (SELECT query_id, 1.0 / (avg(reach) + 1e-10) AS lrd FROM r GROUP BY query_id),
l AS (SELECT nn.query_id, avg(lrd.lrd) AS m FROM nn JOIN lrd ON lrd.query_id = nn.neighbor_id GROUP BY nn.query_id)
SELECT l.query_id, round(lrd.lrd, 6) AS lrd, round(l.m / lrd.lrd, 6) AS lof FROM l JOIN lrd USING (query_id)""")
def l37(spark, sf):
    lof = NB.local_outlier_factor(embeddings_knn(spark, sf), 5)
    return lof.select("query_id", _r6("lrd"), _r6("lof"))


def part_points(spark, sf):
    p = table(spark, sf, "part")
    mm = p.agg(F.min("p_retailprice").alias("a"), F.max("p_retailprice").alias("b")).first()
    return p.select("p_partkey", ((F.col("p_size") - 1) / 49.0).alias("x"),
                    ((F.col("p_retailprice") - F.lit(mm["a"])) / F.lit(mm["b"] - mm["a"])).alias("y"))


_PTS_SQL = """pts AS (SELECT p_partkey, (p_size - 1) / 49.0 AS x,
  (p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) AS y
  FROM part)"""


@register("E08_radius_neighbors", f"""
WITH {_PTS_SQL}
SELECT a.p_partkey, CAST(count(*) AS BIGINT) AS n_neighbors FROM pts a JOIN pts b
  ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02 GROUP BY a.p_partkey""")
def e08(spark, sf):
    c = NB.radius_counts(part_points(spark, sf), "p_partkey", ["x", "y"], 0.02)
    return c.select(F.col("id").alias("p_partkey"), F.col("n_neighbors").cast("long"))


@register("L32_dbscan", f"""
WITH RECURSIVE {_PTS_SQL},
e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM pts a JOIN pts b
      ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02),
core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5),
ce AS (SELECT e.a, e.b FROM e JOIN core u ON e.a = u.id JOIN core v ON e.b = v.id),
r AS (SELECT id, id AS root FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON r.id = ce.a),
lab AS (SELECT id, min(root) AS label FROM r GROUP BY id),
border AS (SELECT e.a AS id, min(lab.label) AS label FROM e JOIN lab ON e.b = lab.id GROUP BY e.a)
SELECT p.p_partkey AS id, CAST(coalesce(lab.label, border.label, -1) AS BIGINT) AS cluster
FROM pts p LEFT JOIN lab ON p.p_partkey = lab.id LEFT JOIN border ON p.p_partkey = border.id""")
def l32(spark, sf):
    return NB.dbscan(part_points(spark, sf), "p_partkey", ["x", "y"], eps=0.02, min_samples=5)


def customer_points(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") / 11000.0).alias("x"), (F.col("c_nationkey") / 25.0).alias("y"),
                    ((F.col("c_custkey") * 37 % 101) / 101.0).alias("z"))


_PTS3_SQL = """pts AS (SELECT c_custkey, c_acctbal / 11000.0 AS x, c_nationkey / 25.0 AS y, (c_custkey * 37 % 101) / 101.0 AS z FROM customer)"""
_NEAR3 = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.06"


@register("E08_radius_three_columns", f"""
WITH {_PTS3_SQL}
SELECT a.c_custkey, CAST(count(*) AS BIGINT) AS n_neighbors FROM pts a JOIN pts b ON {_NEAR3} GROUP BY a.c_custkey""")
def e08_three(spark, sf):
    c = NB.radius_counts(customer_points(spark, sf), "c_custkey", ["x", "y", "z"], 0.06)
    return c.select(F.col("id").alias("c_custkey"), "n_neighbors")


@register("L32_dbscan_three_columns", f"""
WITH RECURSIVE {_PTS3_SQL},
e AS (SELECT a.c_custkey AS a, b.c_custkey AS b FROM pts a JOIN pts b ON {_NEAR3}),
core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4),
ce AS (SELECT e.a, e.b FROM e JOIN core u ON e.a = u.id JOIN core v ON e.b = v.id),
r AS (SELECT id, id AS root FROM core UNION SELECT ce.b, r.root FROM r JOIN ce ON r.id = ce.a),
lab AS (SELECT id, min(root) AS label FROM r GROUP BY id),
border AS (SELECT e.a AS id, min(lab.label) AS label FROM e JOIN lab ON e.b = lab.id GROUP BY e.a)
SELECT p.c_custkey AS id, CAST(coalesce(lab.label, border.label, -1) AS BIGINT) AS cluster
FROM pts p LEFT JOIN lab ON p.c_custkey = lab.id LEFT JOIN border ON p.c_custkey = border.id""")
def l32_three(spark, sf):
    return NB.dbscan(customer_points(spark, sf), "c_custkey", ["x", "y", "z"], eps=0.06, min_samples=4)


# ---------------------------------------------------------------- classifiers

def doc_quality_frame(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id").withColumn("quality", F.col("quality").cast("string"))


def _prepared(spark, sf):
    d = random_split(doc_quality_frame(spark, sf), "doc_id", 0.8, seed=42)
    fitted = FeaturePipeline(target="quality", id_col="doc_id").fit(d.where("is_train").drop("is_train"))
    return fitted.transform(d), fitted


def _fit_predict(spark, sf, name, params=None):
    data, _ = _prepared(spark, sf)
    est = make_estimator("classification", name, params)
    model = est.fit(data.where("is_train"))
    return model.transform(data.where(~F.col("is_train"))).select("doc_id", "label", "prediction")


for _id, _name, _params in [
    ("L01_logistic_regression", "logistic_regression", None),
    ("L02_random_forest", "random_forest", {"n_estimators": 20}),
    ("L03_decision_tree", "decision_tree", None),
    ("L04_gradient_boosting", "xgboost", {"n_estimators": 10}),
    ("L05_extra_trees", "extra_trees", {"n_estimators": 20}),
    ("L07_linear_svc", "linear_svc", None),
    ("L08_sgd_elastic_net", "sgd", {"reg_param": 0.01, "l1_ratio": 0.5}),
    ("L10_gaussian_nb", "naive_bayes", None),
]:
    def _q(spark, sf, _name=_name, _params=_params):
        return _fit_predict(spark, sf, _name, _params)
    _q.__doc__ = f"{_name}: fit on the 80% split of labels x documents, predict the rest."
    register(_id)(_q)


@register("L13_mlp")
def l13(spark, sf):
    data, fitted = _prepared(spark, sf)
    n_in = len(fitted.feature_names())
    est = make_estimator("classification", "mlp", {"layers": [n_in, 8, 2], "max_iter": 50})
    return est.fit(data.where("is_train")).transform(data.where(~F.col("is_train"))).select("doc_id", "label", "prediction")


# ----------------------------------------------------------------- regressors

def lineitem_reg(spark, sf):
    li = table(spark, sf, "lineitem")
    va = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features")
    d = va.transform(li.select(lineitem_row_id().alias("row_id"),
                               "l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label")))
    return random_split(d, "row_id", 0.8, seed=42)


@register("L17_linear_regression", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept FROM lineitem""")
def l17(spark, sf):
    li = table(spark, sf, "lineitem")
    d = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        li.select("l_quantity", F.col("l_extendedprice").alias("label")))
    m = make_estimator("regression", "linear_regression").fit(d)
    return spark.createDataFrame([(round(float(m.coefficients[0]), 6), round(float(m.intercept), 6))],
                                 "slope double, intercept double")


for _id, _name, _params in [
    ("L18_regularised_linear", "elastic_net", {"alpha": 0.1, "l1_ratio": 0.5}),
    ("L19_huber", "huber", None),
    ("L20_tweedie", "tweedie", {"power": 1.5}),
    ("L22_random_forest_regressor", "random_forest", {"n_estimators": 20}),
    ("L23_gbt_regressor", "xgboost", {"n_estimators": 10}),
]:
    def _r(spark, sf, _name=_name, _params=_params):
        d = lineitem_reg(spark, sf)
        # written once: a fit reads its rows several times
        m = make_estimator("regression", _name, _params).fit(cut_lineage(d.where("is_train")))
        return m.transform(d.where(~F.col("is_train"))).select("row_id", "label", "prediction")
    _r.__doc__ = f"{_name} on lineitem: l_extendedprice from quantity, discount, tax."
    register(_id)(_r)


# ----------------------------------------------------------------- clustering

def embedding_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


for _id, _name in [("L30_kmeans", "kmeans"), ("L31_bisecting_kmeans", "agglomerative")]:
    def _c(spark, sf, _name=_name):
        d = embedding_vectors(spark, sf)
        m = make_estimator("clustering", _name, {"n_clusters": 10}).fit(d)
        return m.transform(d).select("vec_id", "label", "prediction")
    register(_id)(_c)


@register("L33_gaussian_mixture")
def l33(spark, sf):
    """Gaussian mixture on an 8-component PCA projection: full 64x64
    covariances from ~50 rows per component are not positive definite."""
    from pyspark.ml.feature import PCA
    d = embedding_vectors(spark, sf)
    proj = PCA(k=8, inputCol="features", outputCol="pca").fit(d).transform(d)
    m = make_estimator("clustering", "gaussian_mixture", {"n_clusters": 10}, features="pca").fit(proj)
    return m.transform(proj).select("vec_id", "label", "prediction")


@register("L39_pca")
def l39(spark, sf):
    """PCA(5) on embeddings: explained variance per component (descending)."""
    from pyspark.ml.feature import PCA
    d = embedding_vectors(spark, sf)
    m = PCA(k=5, inputCol="features", outputCol="pca").fit(d)
    ev = [float(x) for x in m.explainedVariance]
    proj = m.transform(d).select("vec_id", vector_to_array("pca").alias("components"))
    return proj.withColumn("explained_variance", F.array(*[F.lit(x) for x in ev]))


# ------------------------------------------------------------ compositions
from tessera.plans import ensembles as EN  # noqa: E402


def _split_prepared(spark, sf):
    data, fitted = _prepared(spark, sf)
    return data.where("is_train").drop("is_train"), data.where("NOT is_train").drop("is_train"), fitted


def _dt(seed, depth=3):
    return make_estimator("classification", "decision_tree", {"max_depth": depth}, seed=seed)


@register("L06_adaboost")
def l06(spark, sf):
    """SAMME with depth-1 trees, 5 rounds."""
    tr, te, _ = _split_prepared(spark, sf)
    model = EN.fit_adaboost(lambda r: _dt(42 + r, 1), tr, n_rounds=5, n_classes=2)
    return EN.adaboost_predict(model, te).select("doc_id", "label", "prediction")


@register("L11_bernoulli_nb")
def l11(spark, sf):
    from pyspark.ml.feature import Binarizer
    tr, te, _ = _split_prepared(spark, sf)
    b = Binarizer(threshold=0.0, inputCol="features", outputCol="bin")
    m = make_estimator("classification", "bernoulli_nb", features="bin").fit(b.transform(tr))
    return m.transform(b.transform(te)).select("doc_id", "label", "prediction")


@register("L12_ridge_classifier")
def l12(spark, sf):
    """Ridge regression on a +-1 target; the sign is the class."""
    tr, te, _ = _split_prepared(spark, sf)
    pm = tr.withColumn("pm", F.when(F.col("label") > 0, 1.0).otherwise(-1.0))
    m = make_estimator("classification", "ridge_classifier", label="pm").fit(pm)
    return m.transform(te).select("doc_id", "label", F.when(F.col("prediction") > 0, 1.0).otherwise(0.0).alias("prediction"))


@register("L14_bagging")
def l14(spark, sf):
    tr, te, _ = _split_prepared(spark, sf)
    members = EN.fit_bagging(lambda s: _dt(s), tr, "doc_id", n_estimators=3)
    return EN.bagging_predict(members, te).select("doc_id", "label", "prediction")


@register("L15_voting")
def l15(spark, sf):
    """Hard and soft votes of logistic regression, a tree and naive Bayes."""
    tr, te, _ = _split_prepared(spark, sf)
    members = [make_estimator("classification", "logistic_regression").fit(tr), _dt(42).fit(tr),
               make_estimator("classification", "naive_bayes").fit(tr)]
    out, names = EN.predict_members(members, te, keep_prob=True)
    out = EN.vote(out, names, name="hard")
    out = EN.soft_vote(out, [f"{n}_prob" for n in names], name="soft")
    return out.select("doc_id", "label", "hard", "soft")


@register("L16_stacking")
def l16(spark, sf):
    tr, te, _ = _split_prepared(spark, sf)
    makes = [lambda s: make_estimator("classification", "logistic_regression"), lambda s: _dt(s)]
    model = EN.fit_stacking(makes, lambda: make_estimator("classification", "logistic_regression"), tr, "doc_id")
    return EN.stacking_predict(model, te).select("doc_id", "label", "prediction")


@register("L21_ransac")
def l21(spark, sf):
    li = table(spark, sf, "lineitem").select(lineitem_row_id().alias("row_id"), "l_quantity", "l_discount",
                                             (F.col("l_extendedprice") / 1000.0).alias("y"))
    final, va, n_in = EN.fit_ransac(li, ["l_quantity", "l_discount"], "y", "row_id", n_candidates=8)
    return final.transform(va.transform(li)).select("row_id", "y", "prediction").withColumn(
        "best_inliers", F.lit(n_in))


@register("L26_bagging_regressor")
def l26(spark, sf):
    d = lineitem_reg(spark, sf)
    members = EN.fit_bagging(lambda s: make_estimator("regression", "decision_tree", {"max_depth": 5}, seed=s),
                             d.where("is_train").drop("is_train"), "row_id", n_estimators=3)
    return EN.bagging_predict(members, d.where("NOT is_train"), task="regression").select("row_id", "label", "prediction")


@register("L27_time_series_model")
def l27(spark, sf):
    """Gradient boosting on the time-series feature table (series id one-hot)."""
    from tessera.operators.timeseries import ts_features
    from tessera.plans.q_windows import daily_event_totals
    f = ts_features(daily_event_totals(spark, sf), "day", "total", id_col="day", series_cols=["event_type"])
    feats = ["dayofweek", "dayofmonth", "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "rolling_mean_1", "rolling_std_1"]
    d = VectorAssembler(inputCols=feats, outputCol="features").transform(f.withColumn("label", F.col("total")))
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    m = make_estimator("time_series", "xgboost_ts", {"n_estimators": 10}).fit(d.where(F.col("day") < cut))
    return m.transform(d.where(F.col("day") >= cut)).select("event_type", "day", "label", "prediction")


@register("L28_ranking")
def l28(spark, sf):
    """Pointwise ranking: a regressor on order attributes, NDCG per customer."""
    from tessera.operators.metrics import ndcg
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.col("o_totalprice") / 100000.0).alias("label"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("done"),
        F.month("o_orderdate").cast("double").alias("month"))
    d = VectorAssembler(inputCols=["prio", "done", "month"], outputCol="features").transform(o)
    d = d.withColumn("is_train", hash_below_col("o_orderkey", 0.8))
    m = make_estimator("ranking", "random_forest", {"n_estimators": 10}).fit(d.where("is_train"))
    return ndcg(m.transform(d.where("NOT is_train")), "label", "prediction", query_cols=["o_custkey"])


def hash_below_col(id_col, frac):
    from tessera.functions.hashing import hash_below, hash_hex
    return hash_below(hash_hex(id_col, seed=42, salt="split"), frac)


@register("L29_multi_label")
def l29(spark, sf):
    """Binary relevance over (quality, toxic); predictions assembled to an array."""
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    d = lab.join(doc, "doc_id")
    fitted = FeaturePipeline(id_col="doc_id").fit(d.drop("quality", "toxic"))
    x = fitted.transform(d)
    x = x.withColumn("is_train", hash_below_col("doc_id", 0.8))
    out = x.where("NOT is_train")
    for t in ("quality", "toxic"):
        m = make_estimator("classification", "logistic_regression", label=t).fit(
            x.where("is_train").withColumn(t, F.col(t).cast("double")))
        out = m.transform(out).withColumnRenamed("prediction", f"pred_{t}").drop("rawPrediction", "probability")
    return out.select("doc_id", "quality", "toxic", F.array("pred_quality", "pred_toxic").alias("predictions"))


@register("L34_birch")
def l34(spark, sf):
    r = EN.birch_like(part_points(spark, sf), ["x", "y"], k=5, cell=0.05)
    return r.select("p_partkey", "prediction")


@register("L35_spectral")
def l35(spark, sf):
    """kNN affinity graph (exact E07 join) -> power iteration clustering."""
    from pyspark.ml.clustering import PowerIterationClustering
    nn = cut_lineage(embeddings_knn(spark, sf, k=5))  # the clustering reads its edges more than once
    g = nn.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"),
                  F.exp(-F.col("distance") * F.col("distance")).alias("weight"))
    pic = PowerIterationClustering(k=10, maxIter=20, weightCol="weight", srcCol="src", dstCol="dst")
    return pic.assignClusters(g)


def planted_outliers(spark, sf):
    li = table(spark, sf, "lineitem")
    boost = F.when(F.col("l_orderkey") % 997 == 0, 20.0).otherwise(1.0)
    return li.select(lineitem_row_id().alias("row_id"), (F.col("l_quantity") * boost).alias("q"),
                     (F.col("l_extendedprice") / 1000.0 * boost).alias("p"), "l_discount",
                     F.when(F.col("l_orderkey") % 997 == 0, 1).otherwise(0).alias("truth"))


@register("L36_isolation_forest")
def l36(spark, sf):
    from tessera.operators.metrics import anomaly_metrics
    d = planted_outliers(spark, sf)
    scored = EN.isolation_forest(d, ["q", "p", "l_discount"], "row_id", n_trees=50, contamination=0.01)
    return anomaly_metrics(scored.join(d.select("row_id", "truth"), "row_id"), "truth", "prediction")


@register("L38_elliptic_envelope")
def l38(spark, sf):
    from tessera.operators.metrics import anomaly_metrics
    d = planted_outliers(spark, sf)
    r = EN.elliptic_envelope(d, ["q", "p", "l_discount"], contamination=0.01, id_col="row_id")
    return anomaly_metrics(r, "truth", "prediction")


@register("L36_scored_rows")
def l36_rows(spark, sf):
    """The score and verdict of every row."""
    return EN.isolation_forest(planted_outliers(spark, sf), ["q", "p", "l_discount"], "row_id", n_trees=50, contamination=0.01)


@register("L38_scored_rows")
def l38_rows(spark, sf):
    r = EN.elliptic_envelope(planted_outliers(spark, sf), ["q", "p", "l_discount"], contamination=0.01, id_col="row_id")
    return r.select("row_id", "mahalanobis", "prediction")


@register("L40_truncated_svd")
def l40(spark, sf):
    s = EN.truncated_svd(table(spark, sf, "embeddings"), "embedding", k=5)
    return spark.createDataFrame([(i + 1, float(v) ** 0.5) for i, v in enumerate(s.values)], "component int, singular_value double")


@register("L40_projected_rows", """
SELECT vec_id, 64 AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS squared_length FROM embeddings""")
def l40_rows(spark, sf):
    """Every row along all directions: a rotation keeps its length."""
    e = table(spark, sf, "embeddings")
    found = EN.truncated_svd(e, "embedding", k=None)
    d = found.project(e, "embedding", "z")
    return d.select("vec_id", F.size("z").alias("n"), F.round(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v), 6).alias("squared_length"))


@register("L40_trace", """
SELECT round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS squared_singular_values FROM embeddings""")
def l40_trace(spark, sf):
    found = EN.truncated_svd(table(spark, sf, "embeddings"), "embedding", k=None)
    return spark.createDataFrame([(round(float(sum(found.values)), 4),)], "squared_singular_values double")


@register("L24_adaboost_r2")
def l24(spark, sf):
    d = lineitem_reg(spark, sf)
    model = EN.fit_adaboost_r2(lambda r: make_estimator("regression", "decision_tree", {"max_depth": 3}, seed=42 + r),
                               d.where("is_train").drop("is_train"), n_rounds=4)
    return EN.adaboost_r2_predict(model, d.where("NOT is_train")).select("row_id", "label", "prediction")
