"""Study, search and attribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.split import SPLIT_COL, kfold, random_split
from tessera.plans import search as SE
from tessera.plans import studies as N
from tessera.plans.models import make_estimator
from tessera.plans.q_metrics import _CLS_COLS, _PRED, _class_sql, class_preds
from tessera.plans.q_models import _prepared, doc_quality_frame
from tessera.plans.q_split import _h
from tessera.plans.registry import register
from tessera.plans.q_aggregates import lineitem_row_id
from tessera.session import cut_lineage, table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _rf(seed):
    return make_estimator("classification", "random_forest", {"n_estimators": 10}, seed=seed)


def _data(spark, sf):
    d, fitted = _prepared(spark, sf)
    return cut_lineage(d.drop(SPLIT_COL)), fitted  # read by every fit


@register("N01_seed_stability")
def n01(spark, sf):
    d, _ = _data(spark, sf)
    return N.seed_stability(_rf, d, "classification", "doc_id", n_iterations=10)


@register("N02_split_stability")
def n02(spark, sf):
    d, _ = _data(spark, sf)
    return N.split_stability(_rf, d, "classification", "doc_id", n_splits=10)


@register("N03_param_stability")
def n03(spark, sf):
    d, _ = _data(spark, sf)
    base = make_estimator("classification", "decision_tree", {"max_depth": 4})
    return N.param_stability(base, d, "classification", "doc_id", "maxDepth", [2, 3, 4, 5, 6])


def _fit_on_train(spark, sf):
    raw = random_split(doc_quality_frame(spark, sf), "doc_id", 0.8, seed=42)
    from tessera.operators.features import FeaturePipeline
    fitted = FeaturePipeline(target="quality", id_col="doc_id").fit(raw.where(SPLIT_COL).drop(SPLIT_COL))
    model = _rf(42).fit(fitted.transform(raw.where(SPLIT_COL).drop(SPLIT_COL)))
    return raw.where(~F.col(SPLIT_COL)).drop(SPLIT_COL), fitted, model


@register("N04_noise_injection")
def n04(spark, sf):
    test, fitted, model = _fit_on_train(spark, sf)
    cats = {c: v for c, v in fitted.low_card.items()}
    return N.noise_injection(fitted, model, test, "classification", "doc_id", ["n_chars"], cats, 0.05, 3)


_SLICE = "coalesce(CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_linestatus END, '__null__')"


def _unpivot_metrics(src, extra=""):
    return f"(UNPIVOT {src} ON {', '.join(_CLS_COLS)} INTO NAME metric VALUE value)"


@register("N05_slice_metrics", f"""
WITH s AS (SELECT {_SLICE} AS slice, l_returnflag AS y, {_PRED} AS p FROM lineitem),
sup AS (SELECT slice, count(*) AS support FROM s GROUP BY slice HAVING count(*) >= 5),
s2 AS (SELECT s.* FROM s JOIN sup USING (slice)),
{_class_sql('s2', 'slice', 'g_')},
{_class_sql('s', None, 'o_')},
u AS (SELECT slice, metric, value FROM {_unpivot_metrics('g_r')}
      UNION ALL SELECT 'OVERALL', metric, value FROM {_unpivot_metrics('o_r')}),
sp AS (SELECT slice, support FROM sup UNION ALL SELECT 'OVERALL', count(*) FROM s)
SELECT slice, metric, round(value, 6) AS value, CAST(support AS BIGINT) AS support FROM u JOIN sp USING (slice)""")
def n05(spark, sf):
    p = class_preds(spark, sf)
    r = N.slice_metrics(p, "linestatus", label="label", prediction="prediction")
    return r.select(F.col("slice"), "metric", _r6("value"), F.col("support").cast("long"))


_CAL = f"""cal AS (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  CAST(l_discount * 10 AS DOUBLE) AS s FROM lineitem),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY {_h('row_id', salt='skfold')}, row_id) - 1) % 5 AS INTEGER)
        AS fold FROM cal)"""


@register("N07_calibration_brier", f"""
WITH {_CAL} SELECT fold, round(avg((s - y) * (s - y)), 6) AS brier FROM f GROUP BY fold""")
def n07(spark, sf):
    brier, _ = N.calibration(class_preds(spark, sf), "row_id", "is_r", "score")
    return brier.select(F.col("fold").cast("int"), _r6("brier"))


@register("N07_reliability_bins", f"""
WITH {_CAL}
SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, round(avg(s), 6) AS mean_predicted,
       round(avg(CAST(y AS DOUBLE)), 6) AS observed_rate, CAST(count(*) AS BIGINT) AS count FROM f GROUP BY 1""")
def n07r(spark, sf):
    _, rel = N.calibration(class_preds(spark, sf), "row_id", "is_r", "score")
    return rel.select("bin", _r6("mean_predicted"), _r6("observed_rate"), F.col("count").cast("long"))


@register("N06_missing_robustness")
def n06(spark, sf):
    test, fitted, model = _fit_on_train(spark, sf)
    return N.missing_robustness(fitted, model, test, "classification", "doc_id", ["n_chars"])


@register("N08_general_check")
def n08(spark, sf):
    d, _ = _data(spark, sf)
    runs = N.seed_stability(_rf, d, "classification", "doc_id").unionByName(
        N.split_stability(_rf, d, "classification", "doc_id"))
    return N.summary(runs)


@register("N09_text_typos")
def n09(spark, sf):
    """Typos over whole documents: a text model's metrics on clean and noisy texts."""
    texts = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    d = random_split(labels.join(texts, "doc_id"), "doc_id", 0.8, seed=42)
    est = make_estimator("classification", "logistic_regression", seed=42)
    model = N.fit_text_model(est, "quality", "text", d.where(SPLIT_COL))
    return N.text_robustness(model, d.where(~F.col(SPLIT_COL)), "classification", "doc_id", ["text"])


@register("N07_calibration_refit")
def n07_refit(spark, sf):
    """A model fitted for each fold, scored on the rows it has not seen."""
    d, _ = _data(spark, sf)
    return N.calibration_by_fold(_rf, d, "doc_id", n_splits=3)


@register("N10_kfold_test")
def n10(spark, sf):
    """Generic test, k-fold strategy: fit per fold, metrics per fold, mean."""
    d, _ = _data(spark, sf)
    long = N.stability_test(_rf, d, "classification", "doc_id", "kfold", n_iterations=3)
    return M.cv_mean(long.withColumnRenamed("iteration", "fold"), "fold")


@register("N10_perturbed_monte_carlo")
def n10_perturbed(spark, sf):
    d, _ = _data(spark, sf)
    return N.stability_test(_rf, d, "classification", "doc_id", "monte_carlo", n_iterations=3, perturbation=0.1)


@register("N11_study_summary")
def n11(spark, sf):
    d, _ = _data(spark, sf)
    return N.summary(N.seed_stability(_rf, d, "classification", "doc_id", 10))


@register("O03_random_param_maps")
def o03(spark, sf):
    """Random maps, each fitted on the training split and scored on the rest."""
    est = make_estimator("classification", "logistic_regression")
    maps = SE.random_param_maps(est, {"regParam": ("log", 1e-4, 1.0), "elasticNetParam": ("float", 0.0, 1.0)}, 5)
    d = cut_lineage(random_split(_data(spark, sf)[0], "doc_id", 0.8, seed=42))
    train, test = d.where(SPLIT_COL), d.where(~F.col(SPLIT_COL))
    ev = SE.evaluator_for("classification", "accuracy")
    rows = [(i, float(m[est.getParam("regParam")]), float(m[est.getParam("elasticNetParam")]),
             float(ev.evaluate(est.copy(m).fit(train).transform(test)))) for i, m in enumerate(maps)]
    return spark.createDataFrame(rows, "trial int, regParam double, elasticNetParam double, score double")


@register("O04_model_selection")
def o04(spark, sf):
    d, _ = _data(spark, sf)
    f = kfold(d, 3, "doc_id").withColumn("fold", F.col("fold").cast("int"))
    cands = {"logistic_regression": (make_estimator("classification", "logistic_regression"),
                                     {"regParam": ("log", 1e-3, 1.0)}),
             "decision_tree": (make_estimator("classification", "decision_tree"), {"maxDepth": ("int", 2, 6)})}
    res = SE.search(f, "classification", cands, "accuracy", fold_col="fold", n_trials=2)
    return res.trials


@register("O05_successive_halving")
def o05(spark, sf):
    d, _ = _data(spark, sf)
    est = make_estimator("classification", "decision_tree")
    maps = [{est.getParam("maxDepth"): k} for k in (1, 2, 3, 4, 5, 6)]
    return SE.successive_halving(d, "classification", est, maps, "accuracy", "doc_id")


@register("O13_feature_importance")
def o13(spark, sf):
    d, fitted = _data(spark, sf)
    model = _rf(42).fit(d)
    return SE.importance(model, fitted.feature_names(), k=20)


@register("O14_linear_attribution", """
WITH c AS (SELECT regr_slope(l_extendedprice / 1000.0, l_quantity) AS w, avg(l_quantity) AS m FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(c.w * (l_quantity - c.m))), 6) AS mean_abs_contribution
FROM lineitem, c""")
def o14(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    li = table(spark, sf, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000.0).alias("label"))
    m = make_estimator("regression", "linear_regression").fit(
        VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(li))
    a = SE.linear_attribution(li, ["l_quantity"], m.coefficients.toArray().tolist())
    return a.select("feature", _r6("mean_abs_contribution"))
