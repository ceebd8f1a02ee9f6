"""Estimator factory (L01-L41): one place that turns (task, model name,
params) into a Spark ML estimator, used by search, studies and final fits.

Models without a distributed counterpart are re-aimed (see README): the
several gradient-boosting libraries are one ``GBT*`` family, each name with its own
settings and parameter names (``BOOSTING``); extra trees are random forests without
bootstrap, kernel SVMs are not built.
"""

from __future__ import annotations

import math
import warnings

from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import regression as R

MAX_DEPTH = 30  # Spark's tree depth limit; deeper requests are clamped

# Classification model names accepted, grouped by the family that serves them.
CLASSIFIERS = {
    "logistic_regression": "lr", "sgd": "lr",
    "random_forest": "rf", "extra_trees": "et", "decision_tree": "dt",
    "xgboost": "gbt", "lightgbm": "gbt", "catboost": "gbt", "hist_gradient_boosting": "gbt",
    "linear_svc": "svc", "svm": "svc", "passive_aggressive": "svc",
    "naive_bayes": "gnb", "bernoulli_nb": "bnb", "ridge_classifier": "ridge", "mlp": "mlp",
}
# Regression model names accepted.
REGRESSORS = {
    "linear_regression": "ols", "ridge": "ridge", "lasso": "lasso", "elastic_net": "enet", "lasso_lars": "lasso",
    "sgd_regressor": "ridge", "huber": "huber", "tweedie": "tweedie",
    "random_forest": "rf", "extra_trees": "et", "decision_tree": "dt",
    "xgboost": "gbt", "lightgbm": "gbt", "catboost": "gbt", "hist_gradient_boosting": "gbt",
}
# Clustering model names accepted.
CLUSTERERS = {"kmeans": "kmeans", "agglomerative": "bisecting", "gaussian_mixture": "gmm"}
# What the boosting names mean by default (learning rate, depth or leaves, bins), and
# what they call a setting.  The number of trees is ours for all (30), as each is a pass.
BOOSTING = {
    "xgboost": dict(learning_rate=0.3, max_depth=6, bins=256, trees="n_estimators", rate="learning_rate", rows="subsample", columns="colsample_bytree"),
    "lightgbm": dict(learning_rate=0.1, num_leaves=31, bins=255, trees="n_estimators", rate="learning_rate", rows="bagging_fraction", columns="feature_fraction"),
    "catboost": dict(learning_rate=0.03, max_depth=6, bins=254, trees="iterations", rate="learning_rate", rows="subsample", columns="rsm", depth="depth"),
    "hist_gradient_boosting": dict(learning_rate=0.1, num_leaves=31, bins=255, trees="max_iter", rate="learning_rate", leaves="max_leaf_nodes"),
}


def _depth(params, default=5):
    asked = int(params.get("max_depth", default) or default)
    if asked > MAX_DEPTH:
        warnings.warn(f"max_depth {asked} is beyond Spark's limit; {MAX_DEPTH} is used", stacklevel=3)
    return min(asked, MAX_DEPTH)


def boosting_params(name: str, params: dict) -> dict:
    """The ``GBT*`` settings of a boosting name: its own parameter names are understood
    beside the common ones, and a number of leaves is the depth that holds as many."""
    preset = BOOSTING[name.replace("_ts", "")]

    def asked(role: str, common: str, default):
        return params.get(preset.get(role, common), params.get(common, default))

    leaves = asked("leaves", "num_leaves", preset.get("num_leaves"))
    depth = asked("depth", "max_depth", None)
    if depth is None:
        depth = preset["max_depth"] if leaves is None else math.ceil(math.log2(max(2, int(leaves))))
    columns = float(asked("columns", "colsample_bytree", 1.0))
    return dict(maxIter=int(asked("trees", "n_estimators", 30)), stepSize=float(asked("rate", "learning_rate", preset["learning_rate"])),
                maxDepth=_depth({"max_depth": depth}), maxBins=int(params.get("max_bin", preset["bins"])),
                subsamplingRate=float(asked("rows", "subsample", 1.0)),
                featureSubsetStrategy="all" if columns >= 1 else repr(columns))


def regularisation(params: dict, default: float) -> float:
    """``reg_param`` as it is, or 1 / (C n) for an inverse strength ``C`` over ``n_rows`` rows:
    Spark divides the loss by the number of rows, a penalty with C does not."""
    if "C" in params:
        if not params.get("n_rows"):
            raise ValueError("C needs n_rows, the number of training rows")
        return 1.0 / (float(params["C"]) * int(params["n_rows"]))
    return float(params.get("reg_param", default))


def make_estimator(task: str, name: str, params: dict | None = None, features: str = "features",
                   label: str = "label", seed: int = 42, weight_col: str | None = None, n_classes: int = 2):
    """The estimator of a model name.  With more than two classes, families that
    Spark fits for two only (boosting, linear SVM) become one-vs-rest."""
    if task == "classification" and n_classes > 2 and CLASSIFIERS.get(name) in ("gbt", "svc"):
        one = make_estimator(task, name, params, features, label, seed, weight_col)
        return C.OneVsRest(classifier=one, featuresCol=features, labelCol=label, parallelism=2)
    p = dict(params or {})
    if task == "classification":
        fam = CLASSIFIERS.get(name)
        if fam == "lr":
            kw = dict(regParam=regularisation(p, 0.0), elasticNetParam=float(p.get("l1_ratio", 0.0)),
                      maxIter=int(p.get("max_iter", 100)))
            est = C.LogisticRegression(featuresCol=features, labelCol=label, **kw)
        elif fam in ("rf", "et"):
            est = C.RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed,
                                           numTrees=int(p.get("n_estimators", 50)), maxDepth=_depth(p, 8),
                                           bootstrap=(fam == "rf"),
                                           featureSubsetStrategy="sqrt" if fam == "et" else "auto",
                                           maxBins=16 if fam == "et" else 32)
        elif fam == "dt":
            est = C.DecisionTreeClassifier(featuresCol=features, labelCol=label, seed=seed, maxDepth=_depth(p, 6))
        elif fam == "gbt":
            est = C.GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **boosting_params(name, p))
        elif fam == "svc":
            est = C.LinearSVC(featuresCol=features, labelCol=label, regParam=regularisation(p, 0.01),
                              maxIter=int(p.get("max_iter", 100)))
        elif fam == "gnb":
            est = C.NaiveBayes(featuresCol=features, labelCol=label, modelType="gaussian")
        elif fam == "bnb":
            est = C.NaiveBayes(featuresCol=features, labelCol=label, modelType="bernoulli",
                               smoothing=float(p.get("alpha", 1.0)))
        elif fam == "mlp":
            est = C.MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, seed=seed,
                                                   layers=p["layers"], maxIter=int(p.get("max_iter", 100)))
        elif fam == "ridge":
            est = R.LinearRegression(featuresCol=features, labelCol=label, regParam=float(p.get("alpha", 1.0)),
                                     elasticNetParam=0.0)
        else:
            raise ValueError(f"unknown classifier {name}")
    elif task in ("regression", "time_series", "ranking"):
        fam = REGRESSORS.get(name.replace("_ts", ""))
        if fam in ("ols", "ridge", "lasso", "enet"):
            reg = {"ols": 0.0}.get(fam, float(p.get("alpha", 0.1)))
            en = {"ols": 0.0, "ridge": 0.0, "lasso": 1.0}.get(fam, float(p.get("l1_ratio", 0.5)))
            est = R.LinearRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=en,
                                     solver="normal" if fam in ("ols", "ridge") else "auto")
        elif fam == "huber":
            est = R.LinearRegression(featuresCol=features, labelCol=label, loss="huber",
                                     epsilon=float(p.get("epsilon", 1.35)), regParam=float(p.get("alpha", 0.0)))
        elif fam == "tweedie":
            power = float(p.get("power", 1.5))
            if 0 < power < 1:
                raise ValueError("tweedie power in (0, 1) is not a valid distribution")
            est = R.GeneralizedLinearRegression(featuresCol=features, labelCol=label, family="tweedie",
                                                variancePower=power, linkPower=float(p.get("link_power", 0.0)))
        elif fam in ("rf", "et"):
            est = R.RandomForestRegressor(featuresCol=features, labelCol=label, seed=seed,
                                          numTrees=int(p.get("n_estimators", 50)), maxDepth=_depth(p, 8),
                                          bootstrap=(fam == "rf"), featureSubsetStrategy="all" if fam == "et" else "auto",
                                          maxBins=16 if fam == "et" else 32)
        elif fam == "dt":
            est = R.DecisionTreeRegressor(featuresCol=features, labelCol=label, seed=seed, maxDepth=_depth(p, 6))
        elif fam == "gbt":
            est = R.GBTRegressor(featuresCol=features, labelCol=label, seed=seed, **boosting_params(name, p))
        else:
            raise ValueError(f"unknown regressor {name}")
    elif task == "clustering":
        fam = CLUSTERERS.get(name)
        k = int(p.get("n_clusters", 3))
        if fam == "kmeans":
            est = K.KMeans(featuresCol=features, k=k, seed=seed)
        elif fam == "bisecting":
            est = K.BisectingKMeans(featuresCol=features, k=k, seed=seed)
        elif fam == "gmm":
            est = K.GaussianMixture(featuresCol=features, k=k, seed=seed)
        elif name == "birch":
            raise ValueError("birch is no single estimator: use tessera.plans.ensembles.birch_like")
        else:
            raise ValueError(f"unknown clusterer {name}")
    else:
        raise ValueError(f"unknown task {task}")
    if weight_col and hasattr(est, "setWeightCol"):
        est.setWeightCol(weight_col)
    return est
