"""Robustness studies.

Every study returns a long table (study, iteration, param, metric, value).
Studies that only perturb the *scoring* data (noise, missing values, typos)
expand the evaluation rows once per scenario and score all scenarios with the
fitted model in a single job; metrics are then grouped by scenario.  Studies
that change the *fit* (seeds, splits, parameters) run one distributed fit per
scenario -- ``fitMultiple`` where Spark offers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_normal, hash_uniform
from tessera.operators import metrics as M
from tessera.operators.aggregates import summarize
from tessera.operators.joins import checked_broadcast
from tessera.operators.split import SPLIT_COL, exact_split, kfold, random_split, stratified_kfold, time_series_folds
from tessera.session import cut_lineage

LONG = ["study", "iteration", "param", "metric", "value"]


def _metrics(pred: DataFrame, task: str, group_cols, label="label", prediction="prediction", score=None):
    if task == "classification":
        wide = M.classification_metrics(pred, label, prediction, group_cols)
    else:
        wide = M.regression_metrics(pred, label, prediction, group_cols)
    return M.to_long(wide, group_cols)


def _tag(long: DataFrame, study: str, iteration=None, param=None) -> DataFrame:
    d = long
    if "iteration" not in d.columns:
        d = d.withColumn("iteration", F.lit(iteration).cast("int"))
    if "param" not in d.columns:
        d = d.withColumn("param", F.lit(None if param is None else str(param)).cast("string"))
    return d.select(F.lit(study).alias("study"), F.col("iteration").cast("int"), F.col("param").cast("string"),
                    "metric", "value")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def seed_stability(make, data: DataFrame, task: str, id_col: str, n_iterations: int = 10, seed: int = 42,
                   test_size: float = 0.2) -> DataFrame:
    """Fixed split, model seed + i."""
    d = random_split(data, id_col, 1 - test_size, seed)
    train, test = d.where(SPLIT_COL), d.where(~F.col(SPLIT_COL))
    parts = []
    for i in range(n_iterations):
        model = make(seed + i).fit(train)
        parts.append(_tag(_metrics(model.transform(test), task, []), "seed", i))
    return _union(parts)


def split_stability(make, data: DataFrame, task: str, id_col: str, n_splits: int = 10, seed: int = 42,
                    test_size: float = 0.2) -> DataFrame:
    """Split seed + i, model seed fixed; the memberships equal those of
    ``monte_carlo_splits`` without expanding the data for every fit."""
    parts = []
    for i in range(n_splits):
        it = random_split(data, id_col, 1 - test_size, seed + i)
        model = make(seed).fit(it.where(SPLIT_COL))
        parts.append(_tag(_metrics(model.transform(it.where(~F.col(SPLIT_COL))), task, []), "split", i))
    return _union(parts)


def param_stability(estimator, data: DataFrame, task: str, id_col: str, param: str, values, seed: int = 42,
                    test_size: float = 0.2) -> DataFrame:
    """One fit per parameter value; a value that fails to fit is a row that says why
    (metric ``error: ...``, no value)."""
    d = random_split(data, id_col, 1 - test_size, seed)
    train, test = d.where(SPLIT_COL), d.where(~F.col(SPLIT_COL))
    p = estimator.getParam(param)

    def one(value):
        return _metrics(estimator.copy({p: value}).fit(train).transform(test), task, [])
    return _union([_or_error(data, "hyperparameter", i, v, lambda v=v: one(v)) for i, v in enumerate(values)])


def _or_error(data: DataFrame, study: str, iteration: int, param, run) -> DataFrame:
    """The metrics of ``run``, or one row with the reason why there are none."""
    try:
        return _tag(run(), study, iteration, param)
    except Exception as e:  # any failure of a fit belongs to its row
        reason = f"error: {str(e).strip().splitlines()[0][:200] if str(e).strip() else type(e).__name__}"
        empty = data.sparkSession.createDataFrame([(reason, None)], "metric string, value double")
        return _tag(empty, study, iteration, param)


STRATEGIES = ("monte_carlo", "kfold", "stratified_kfold", "time_series_split")


def folds(data: DataFrame, task: str, id_col: str, strategy: str = "monte_carlo", n: int = 10, test_size: float = 0.2,
          seed: int = 42, order_col: str | None = None, label: str = "label"):
    """(train, test) of each iteration of a split strategy.

    ``monte_carlo`` draws anew with seed + i, by class where every class has two rows;
    ``stratified_kfold`` is ``kfold`` off classification; ``time_series_split`` needs
    ``order_col`` and trains on all that lies before each block."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy == "monte_carlo":
        by = None
        if task == "classification":
            least = data.groupBy(label).count().agg(F.min("count")).first()[0]
            by = label if least is not None and least > 1 else None
        for i in range(n):
            d = cut_lineage(exact_split(data, id_col, 1 - test_size, seed + i, by))
            yield d.where(SPLIT_COL).drop(SPLIT_COL), d.where(~F.col(SPLIT_COL)).drop(SPLIT_COL)
        return
    if strategy == "time_series_split":
        if order_col is None:
            raise ValueError("time_series_split needs order_col")
        d = cut_lineage(time_series_folds(data, n, order_col, id_col))
        for i in range(n):
            one = d.where(F.col("fold") == i).drop("fold")
            yield one.where("role = 'train'").drop("role"), one.where("role = 'test'").drop("role")
        return
    stratified = strategy == "stratified_kfold" and task == "classification"
    d = cut_lineage(stratified_kfold(data, n, id_col, label, seed) if stratified else kfold(data, n, id_col, True, seed))
    for i in range(n):
        yield d.where(F.col("fold") != i).drop("fold"), d.where(F.col("fold") == i).drop("fold")


def perturbed(data: DataFrame, id_col: str, features: str, sigma: float, seed: int) -> DataFrame:
    """``data`` with N(0, sigma) added to every entry of its feature vector, drawn from
    the row's id and the entry's place."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def noise(x, i):
        return x + F.lit(sigma) * hash_normal(id_col, i, seed=seed, salt="perturb")
    return data.withColumn(features, array_to_vector(F.transform(vector_to_array(features), noise)))


def stability_test(make, data: DataFrame, task: str, id_col: str, strategy: str = "monte_carlo", n_iterations: int = 10,
                   test_size: float = 0.2, perturbation: float = 0.0, seed: int = 42, order_col: str | None = None,
                   label: str = "label", features: str = "features", transform=None) -> DataFrame:
    """Fit and score by any split strategy, the test rows' features perturbed if
    asked.  ``transform`` (P-02) maps the data before it is split.  An iteration that
    fails is a row that says why."""
    d = data.transform(transform) if transform else data

    def one(train, test):
        model = make(seed).fit(train)
        shaken = perturbed(test, id_col, features, perturbation, seed) if perturbation > 0 else test
        return _metrics(model.transform(shaken), task, [], label)
    return _union([_or_error(data, strategy, i, perturbation, lambda a=train, b=test: one(a, b))
                   for i, (train, test) in enumerate(folds(d, task, id_col, strategy, n_iterations, test_size, seed, order_col, label))])


def calibration_by_fold(make, data: DataFrame, id_col: str, n_splits: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """A fit for each stratified fold and the Brier score of its held-out rows (of
    class 1 with two classes, else the mean over classes): (split, brier_score, error).
    A model without probabilities gives one row that says so."""
    from pyspark.ml.functions import vector_to_array
    spark = data.sparkSession
    classes = sorted(r[0] for r in data.select(label).distinct().collect() if r[0] is not None)  # the classes of one target
    rows = []
    for i, (train, test) in enumerate(folds(data, "classification", id_col, "stratified_kfold", n_splits, seed=seed, label=label)):
        try:
            pred = make(seed).fit(train).transform(test)
            if "probability" not in pred.columns:
                rows = [(None, None, "the model gives no probabilities")]
                break
            pred = pred.withColumn("_p", vector_to_array("probability"))
            if len(classes) == 2:
                score = M.brier(pred.withColumn("_p", F.col("_p")[1]).withColumn("_y", (F.col(label) == F.lit(classes[1])).cast("int")), "_y", "_p")
            else:
                score = M.brier_classes(pred, label, "_p", classes)
            rows.append((i, score.first()["brier"], None))
        except Exception as e:  # a fold that cannot be fitted is a row with the reason
            rows.append((i, None, str(e).strip().splitlines()[0][:200]))
    return spark.createDataFrame(rows, "split int, brier_score double, error string")


def noise_injection(fitted_features, model, raw_test: DataFrame, task: str, id_col: str, numeric_cols,
                    categorical: dict | None = None, noise_level: float = 0.05, n_iterations: int = 5,
                    seed: int = 42) -> DataFrame:
    """Numeric += N(0, level * std) (sample std of the test columns),
    categorical replaced with probability ``level`` by a uniformly drawn
    known category; iteration -1 is the clean baseline.  One scoring job."""
    stds = raw_test.agg(*[F.stddev_samp(c).alias(c) for c in numeric_cols]).first()  # one row
    d = raw_test.withColumn("iteration", F.explode(F.sequence(F.lit(-1), F.lit(n_iterations - 1))))
    noisy = F.col("iteration") >= 0
    exprs = {}
    for c in numeric_cols:
        z = hash_normal(id_col, "iteration", seed=seed, salt=f"noise:{c}")
        exprs[c] = F.when(noisy, F.col(c) + z * F.lit(noise_level * float(stds[c] or 0.0))).otherwise(F.col(c))
    for c, cats in (categorical or {}).items():
        cats = list(cats)
        hit = hash_uniform(id_col, "iteration", seed=seed, salt=f"cat:{c}") < F.lit(noise_level)
        pick = F.element_at(F.array(*[F.lit(x) for x in cats]),
                            (F.floor(hash_uniform(id_col, "iteration", seed=seed, salt=f"pick:{c}") * len(cats)) + 1)
                            .cast("int"))
        exprs[c] = F.when(noisy & hit, pick).otherwise(F.col(c))
    d = d.withColumns(exprs)
    pred = model.transform(fitted_features.transform(d))
    return _tag(_metrics(pred, task, ["iteration"]), "noise", param=noise_level)


def slice_metrics(pred: DataFrame, slice_col: str, task: str = "classification", label: str = "label",
                  prediction: str = "prediction", min_support: int = 5) -> DataFrame:
    """Metrics overall and per slice value (null is its own slice);
    slices with fewer than ``min_support`` rows are skipped."""
    s = F.coalesce(F.col(slice_col).cast("string"), F.lit("__null__"))
    d = pred.withColumn("slice", s)
    sup = d.groupBy("slice").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= min_support)
    per = _metrics(d.join(checked_broadcast(sup.select("slice")), "slice"), task, ["slice"], label, prediction)
    overall = _metrics(pred, task, [], label, prediction).withColumn("slice", F.lit("OVERALL"))
    out = per.unionByName(overall)
    sup_all = sup.unionByName(pred.agg(F.count(F.lit(1)).alias("support")).withColumn("slice", F.lit("OVERALL")))
    return out.join(sup_all, "slice")


def missing_robustness(fitted_features, model, raw_test: DataFrame, task: str, id_col: str, numeric_cols,
                       fractions=(0.05, 0.10, 0.20), seed: int = 42) -> DataFrame:
    """Numeric cells nulled with probability f (hash of id, column, f);
    the fitted imputer absorbs them.  All fractions scored in one job."""
    d = raw_test.withColumn("frac", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    exprs = {c: F.when(hash_uniform(id_col, "frac", seed=seed, salt=f"miss:{c}") < F.col("frac"), F.lit(None))
             .otherwise(F.col(c)) for c in numeric_cols}
    pred = model.transform(fitted_features.transform(d.withColumns(exprs)))
    long = _metrics(pred, task, ["frac"])
    return _tag(long.withColumn("param", F.col("frac").cast("string")).drop("frac"), "missing", 0)


def calibration(pred: DataFrame, id_col: str, label: str, prob: str, n_splits: int = 5, seed: int = 42,
                bins: int = 10):
    """Stratified folds, Brier score per fold; plus reliability bins
    (mean predicted vs observed rate per probability bin)."""
    f = stratified_kfold(pred, n_splits, id_col, label, seed)
    brier = M.brier(f, label, prob, ["fold"])
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1)).cast("int")
    rel = f.groupBy(b.alias("bin")).agg(F.avg(prob).alias("mean_predicted"),
                                        F.avg(F.col(label).cast("double")).alias("observed_rate"),
                                        F.count(F.lit(1)).alias("count"))
    return brier, rel


def typo_text(col: str, id_col: str, p: float = 0.1, seed: int = 42):
    """Each letter, with probability p, is dropped or replaced by a
    random a-z letter (even odds) -- per-character hash draws, native
    expressions over the whole text."""
    chars = F.split(F.coalesce(F.col(col), F.lit("")), "")
    idv, draws = F.col(id_col), 1 << 30

    def u(i, salt):
        return F.xxhash64(idv, i, F.lit(seed), F.lit(salt)).bitwiseAND(F.lit(draws - 1))

    def step(c, i):
        # a lambda's body is interpreted and shares nothing: one draw for a character that stays
        hit = (u(i, "hit") < F.lit(p * draws)) & c.rlike(r"^\p{L}$")
        letter = F.char(F.lit(97) + F.floor(u(i, "letter").cast("double") / float(draws) * 26).cast("int"))
        return F.when(hit, F.when(u(i, "act") < F.lit(draws // 2), F.lit("")).otherwise(letter)).otherwise(c)
    return F.array_join(F.transform(chars, step), "")


def text_model(estimator, target: str, text_col: str, buckets: int = 1 << 16):
    """An unfitted pipeline for N09: hashed word weights of a text, then ``estimator``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer, StringIndexer
    return Pipeline(stages=[
        SQLTransformer(statement=f"SELECT *, coalesce(`{text_col}`, '') AS _text FROM __THIS__"),
        StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=buckets),
        IDF(inputCol="_counts", outputCol="features"), estimator])


def fit_text_model(estimator, target: str, text_col: str, train: DataFrame, buckets: int = 1 << 16):
    """``text_model`` fitted to ``train``, whose words are counted once: the weights and
    the estimator's passes read the written counts."""
    from pyspark.ml import Pipeline, PipelineModel
    stages = text_model(estimator, target, text_col, buckets).getStages()
    counter = Pipeline(stages=stages[:4]).fit(train)
    counts = cut_lineage(counter.transform(train).select("label", "_counts"))
    return PipelineModel(counter.stages + Pipeline(stages=stages[4:]).fit(counts).stages)


def text_robustness(model, raw_test: DataFrame, task: str, id_col: str, text_cols, p: float = 0.1,
                    n_iterations: int = 3, seed: int = 42) -> DataFrame:
    """Metrics of a fitted text model on clean texts (iteration -1) and on
    texts with typos, drawn anew for each iteration.  One scoring job."""
    d = raw_test.withColumn("iteration", F.explode(F.sequence(F.lit(-1), F.lit(n_iterations - 1))))
    draw = F.lit(seed) + F.col("iteration")
    d = d.withColumns({c: F.when((F.col("iteration") < 0) | F.col(c).isNull(), F.col(c)).otherwise(typo_text(c, id_col, p, draw))
                       for c in text_cols})
    return _tag(_metrics(model.transform(d), task, ["iteration"]), "typos", param=p)


def summary(study: DataFrame) -> DataFrame:
    """D03 per (study, metric)."""
    return summarize(study, "metric", "value", ["study"])
