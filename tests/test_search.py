import warnings

import pytest
from pyspark.ml.linalg import Vectors

from tessera.plans import search as S
from tessera.plans.models import make_estimator

NAMES = ["logistic_regression", "mlp", "random_forest", "custom_voting", "stacking_ensemble"]


def test_candidate_filter():
    assert S.keep_candidates(NAMES) == NAMES
    assert S.keep_candidates(NAMES, "single") == NAMES[:3]
    assert S.keep_candidates(NAMES, "ensemble_only") == NAMES[3:]
    assert S.keep_candidates(NAMES, "both", ensembles=False) == NAMES[:3]
    assert S.keep_candidates(NAMES, "single", deep_learning=False) == ["logistic_regression", "random_forest"]
    assert S.keep_candidates(NAMES, "single", deep_learning=False, manual=["mlp", "custom_voting"]) == NAMES[:4]
    with pytest.raises(ValueError):
        S.keep_candidates(NAMES, "other")


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(i, float(i % 3), Vectors.dense([i % 3 + (i * 7 % 10) / 30, (i % 3) ** 2 + (i * 3 % 10) / 30])) for i in range(90)]
    return spark.createDataFrame(rows, ["id", "label", "features"])


def test_preset_gives_trials_and_folds(spark, blobs):
    data = S.with_preset_folds(blobs, "test", "id", "label")
    assert data.select("fold").distinct().count() == 2
    cands = {"decision_tree": (make_estimator("classification", "decision_tree"), {"maxDepth": ("int", 1, 4)}),
             "mlp": (None, {})}
    res = S.search(data, "classification", cands, "accuracy", preset="test", deep_learning=False,
                   manual={"decision_tree": {"maxDepth": 5}})
    trials = res.trials.orderBy("trial").collect()
    assert [t["params"]["maxDepth"] for t in trials][0] == "5" and len(trials) == 2  # by hand first, then the preset's one
    assert res.best_model.transform(data).count() == 90


@pytest.mark.parametrize("name", ["xgboost", "linear_svc"])
def test_three_classes(blobs, name):
    est = make_estimator("classification", name, {"n_estimators": 3, "max_depth": 2}, n_classes=3)
    out = est.fit(blobs).transform(blobs)
    right = out.where("prediction = label").count()
    assert out.count() == 90 and right > 45


def test_depth_is_clamped_with_a_warning():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        est = make_estimator("classification", "decision_tree", {"max_depth": 99})
    assert est.getMaxDepth() == 30 and any("max_depth" in str(w.message) for w in seen)


def test_boosting_names_have_their_own_settings():
    from tessera.plans.models import make_estimator
    of = lambda name, params=None, task="classification": make_estimator(task, name, params)
    rate = {n: of(n).getStepSize() for n in ("xgboost", "lightgbm", "catboost", "hist_gradient_boosting")}
    assert rate == {"xgboost": 0.3, "lightgbm": 0.1, "catboost": 0.03, "hist_gradient_boosting": 0.1}
    assert (of("xgboost").getMaxDepth(), of("lightgbm").getMaxDepth(), of("lightgbm", {"num_leaves": 200}).getMaxDepth()) == (6, 5, 8)
    lgb = of("lightgbm", {"bagging_fraction": 0.5, "feature_fraction": 0.4, "n_estimators": 7})
    assert (lgb.getSubsamplingRate(), lgb.getFeatureSubsetStrategy(), lgb.getMaxIter()) == (0.5, "0.4", 7)
    cat = of("catboost", {"iterations": 9, "depth": 3, "learning_rate": 0.2}, "regression")
    assert (cat.getMaxIter(), cat.getMaxDepth(), cat.getStepSize()) == (9, 3, 0.2)


def test_inverse_regularisation_counts_rows():
    from tessera.plans.models import make_estimator
    assert make_estimator("classification", "logistic_regression", {"C": 2.0, "n_rows": 50}).getRegParam() == 0.01
    with pytest.raises(ValueError, match="n_rows"):
        make_estimator("classification", "logistic_regression", {"C": 2.0})
    with pytest.raises(ValueError, match="birch_like"):
        make_estimator("clustering", "birch")


def test_permutation_importance_finds_the_column_that_matters(spark):
    from pyspark.ml.feature import VectorAssembler
    rows = [(i, float(i * 37 % 50), float(i * 11 % 7), 3.0 * (i * 37 % 50)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    va = VectorAssembler(inputCols=["a", "b"], outputCol="features")
    model = make_estimator("regression", "linear_regression").fit(va.transform(df))
    got = {r["feature"]: r["importance"] for r in S.permutation_importance(model, df, ["a", "b"], "id", "regression", "rmse", va).collect()}
    assert got["a"] > 10 and abs(got["b"]) < 1e-6


def test_grid_has_every_combination():
    est = make_estimator("classification", "logistic_regression")
    maps = S.grid_param_maps(est, {"regParam": [0.0, 0.1], "maxIter": [5, 10, 20]})
    assert len({(m[est.getParam("regParam")], m[est.getParam("maxIter")]) for m in maps}) == 6


def test_auto_strategy_by_task_and_size():
    from tessera.operators.split import auto_strategy
    assert [auto_strategy(10, "time_series"), auto_strategy(999, "classification"), auto_strategy(1000, "regression")] == ["time_series", "kfold", "holdout"]
