"""Model search and selection (O01-O07), importance and attribution.

Folds come from the deterministic fold column (G07-G09), so cross-validation
is repeatable whatever the partitioning; ``CrossValidator(foldCol=...)`` with
``parallelism`` fits candidates concurrently on the cluster.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml.evaluation import (BinaryClassificationEvaluator, MulticlassClassificationEvaluator,
                                   RegressionEvaluator)
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Search presets (trials per model, folds).
PRESETS = {"test": (1, 2), "fast": (15, 3), "medium": (40, 5), "high": (100, 5), "custom": (20, 5)}
# Names of model compositions and of neural models.
ENSEMBLES = ("custom_voting", "custom_stacking", "custom_bagging", "voting_ensemble", "stacking_ensemble")
NEURAL = ("mlp",)


def keep_candidates(names, mode: str = "both", deep_learning: bool = True, ensembles: bool = True, manual=()) -> list[str]:
    """The candidates that a search may try.  ``mode`` is ``single`` (no
    compositions), ``ensemble_only`` or ``both`` (compositions if ``ensembles``);
    names picked by hand always stay."""
    if mode not in ("single", "ensemble_only", "both"):
        raise ValueError(f"unknown ensemble mode {mode}")
    composed = {"single": (False,), "ensemble_only": (True,), "both": (False, True) if ensembles else (False,)}[mode]
    allowed = lambda n: (n in ENSEMBLES) in composed and (deep_learning or n not in NEURAL)
    return [n for n in names if n in set(manual) or allowed(n)]


def with_preset_folds(df: DataFrame, preset: str, id_col: str, label: str | None = None, seed: int = 42) -> DataFrame:
    """The preset's number of (stratified) folds as column ``fold``."""
    from tessera.operators.split import stratified_kfold
    return stratified_kfold(df, PRESETS[preset][1], id_col, label, seed)


def random_param_maps(estimator, space: dict, n: int, seed: int = 42):
    """N parameter maps from bounded spaces: ("log", lo, hi),
    ("int", lo, hi), ("float", lo, hi) or a list of choices."""
    rng = random.Random(seed)
    maps = []
    for _ in range(n):
        m = {}
        for name, spec in space.items():
            p = estimator.getParam(name)
            if isinstance(spec, list):
                m[p] = rng.choice(spec)
            elif spec[0] == "log":
                m[p] = math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2])))
            elif spec[0] == "int":
                m[p] = rng.randint(spec[1], spec[2])
            else:
                m[p] = rng.uniform(spec[1], spec[2])
        maps.append(m)
    return maps


def grid_param_maps(estimator, grid: dict):
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(estimator.getParam(name), list(values))
    return b.build()


def evaluator_for(task: str, metric: str):
    if task == "classification":
        if metric in ("roc_auc", "areaUnderROC"):
            return BinaryClassificationEvaluator(metricName="areaUnderROC")
        name = {"f1": "weightedFMeasure", "f1_weighted": "f1", "precision": "weightedPrecision",
                "recall": "weightedRecall"}.get(metric, metric)
        return MulticlassClassificationEvaluator(metricName=name)
    return RegressionEvaluator(metricName=metric)


@dataclass
class SearchResult:
    best_model: object
    trials: DataFrame


def search(data: DataFrame, task: str, candidates: dict, metric: str, fold_col: str = "fold",
           n_trials: int | None = None, seed: int = 42, manual: dict | None = None, parallelism: int = 2,
           preset: str = "custom", mode: str = "both", deep_learning: bool = True) -> SearchResult:
    """Per model, manual parameter maps first, then random maps;
    k-fold selection on ``fold_col``; the best (model, params) is refitted on
    all rows.  ``candidates``: name -> (estimator, space), filtered by
    ``keep_candidates`` (models with manual parameters stay).  The preset gives
    the trials unless ``n_trials`` does; a model without a space is one trial."""
    spark = data.sparkSession
    n_trials = PRESETS[preset][0] if n_trials is None else n_trials
    names = keep_candidates(candidates, mode, deep_learning, manual=manual or ())
    if not names:
        raise ValueError("no candidate is left to search")
    candidates = {n: candidates[n] for n in names}
    ev = evaluator_for(task, metric)
    larger = ev.isLargerBetter()
    n_folds = int(data.agg(F.max(fold_col)).first()[0]) + 1
    rows, best = [], None
    for name, (est, space) in candidates.items():
        maps = [dict((est.getParam(k), v) for k, v in (manual or {}).get(name, {}).items())] if manual and name in manual else []
        maps += random_param_maps(est, space, n_trials, seed) if space else [{}]
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=ev, foldCol=fold_col, numFolds=n_folds,
                            parallelism=parallelism, seed=seed)
        m = cv.fit(data)
        for i, (pm, score) in enumerate(zip(maps, m.avgMetrics)):
            rows.append((name, i + 1, {p.name: str(v) for p, v in pm.items()}, float(score)))
            key = score if larger else -score
            if best is None or key > best[0]:
                best = (key, est, pm)
    trials = spark.createDataFrame(rows, "model string, trial int, params map<string,string>, score double")
    final = best[1].copy(best[2]).fit(data)  # O07: refit on all rows
    return SearchResult(final, trials)


def successive_halving(data: DataFrame, task: str, est, maps, metric: str, id_col: str, rungs=(0.25, 0.5, 1.0),
                       keep: float = 1 / 3, seed: int = 42, test_size: float = 0.2) -> DataFrame:
    """Candidates scored on growing hash samples; the best third survive
    each rung."""
    from tessera.functions.hashing import hash_hex, hash_below
    from tessera.operators.split import random_split, SPLIT_COL
    ev = evaluator_for(task, metric)
    d = random_split(data, id_col, 1 - test_size, seed)
    test = d.where(~F.col(SPLIT_COL))
    alive = list(range(len(maps)))
    out = []
    for r, frac in enumerate(rungs):
        train = d.where(F.col(SPLIT_COL) & hash_below(hash_hex(id_col, seed=seed, salt="rung"), frac))
        scores = []
        for i in alive:
            s = ev.evaluate(est.copy(maps[i]).fit(train).transform(test))
            scores.append((i, s))
            out.append((r, frac, i, float(s)))
        scores.sort(key=lambda t: t[1], reverse=ev.isLargerBetter())
        alive = [i for i, _ in scores[:max(1, math.ceil(len(scores) * keep))]]
    return data.sparkSession.createDataFrame(out, "rung int, fraction double, candidate int, score double")


def importance(model, names, k: int = 20) -> DataFrame:
    """Top-k features by tree importance or absolute coefficient."""
    spark = __import__("pyspark.sql", fromlist=["SparkSession"]).SparkSession.getActiveSession()
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficients"):
        vals = [abs(x) for x in model.coefficients.toArray().tolist()]
    elif hasattr(model, "coefficientMatrix"):
        cm = model.coefficientMatrix.toArray()
        vals = [float(abs(cm[:, j]).mean()) for j in range(cm.shape[1])]
    else:
        raise ValueError("model has no importances")
    rows = sorted(zip(names, [float(v) for v in vals]), key=lambda t: (-t[1], t[0]))[:k]
    return spark.createDataFrame(rows, "feature string, importance double")


def linear_attribution(df: DataFrame, feature_cols, coefficients) -> DataFrame:
    """O14 (linear models, exact): mean |coef_j * (x_j - mean_j)| per feature."""
    means = df.agg(*[F.avg(c).alias(c) for c in feature_cols]).first()  # one row
    exprs = [F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(float(means[c] or 0.0))))).alias(c)
             for c, w in zip(feature_cols, coefficients)]
    return df.agg(*exprs).unpivot([], list(feature_cols), "feature", "mean_abs_contribution")


def permutation_importance(model, df: DataFrame, feature_cols, id_col: str, task: str, metric: str,
                           assembler, seed: int = 42) -> DataFrame:
    """O14 (any model): score drop when one column is shuffled.  The shuffle
    pairs each row with the row of the next hash rank (a join on rank), so
    it is distributed and repeatable."""
    from tessera.functions.hashing import hash_hex
    from tessera.operators.ordering import hash_rank
    ev = evaluator_for(task, metric)
    base = ev.evaluate(model.transform(assembler.transform(df)))
    n = df.count()
    rows = []
    for c in feature_cols:
        r = hash_rank(df.withColumn("_h", hash_hex(id_col, seed=seed, salt=f"perm:{c}")), "_h", [id_col], name="_r")
        donor = r.select((F.col("_r") % n + 1).alias("_r"), F.col(c).alias("_v"))
        shuffled = r.join(donor, "_r").withColumn(c, F.col("_v")).drop("_v", "_r", "_h")
        s = ev.evaluate(model.transform(assembler.transform(shuffled)))
        rows.append((c, float(base - s if ev.isLargerBetter() else s - base)))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")
