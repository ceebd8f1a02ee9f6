import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tessera.operators.metrics import brier
from tessera.plans import studies as N
from tessera.plans.models import make_estimator


def _tree(seed):
    return make_estimator("classification", "decision_tree", {"max_depth": 2}, seed=seed)


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, float(i % 2), float(i % 2) * 4 + (i * 37 % 11) / 10, float(i * 13 % 17)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


@pytest.mark.parametrize("strategy", N.STRATEGIES)
def test_strategies_split_as_named(data, strategy):
    every = {r["id"] for r in data.collect()}
    tests = []
    for train, test in N.folds(data, "classification", "id", strategy, n=3, order_col="id"):
        a, b = ({r["id"] for r in d.collect()} for d in (train, test))
        assert a and b and not a & b
        if strategy == "time_series_split":
            assert max(a) < min(b)
        else:
            assert a | b == every
        if strategy in ("monte_carlo", "stratified_kfold"):
            assert abs(sum(i % 2 for i in b) - len(b) / 2) <= 1
        tests.append(frozenset(b))
    assert len(set(tests)) == 3
    if "kfold" in strategy:
        assert frozenset.union(*tests) == every and sum(map(len, tests)) == 90


def test_stability_scores_every_iteration(data):
    got = N.stability_test(_tree, data, "classification", "id", "kfold", n_iterations=3)
    acc = {r["iteration"]: r["value"] for r in got.where("metric = 'accuracy'").collect()}
    assert acc == {0: 1.0, 1: 1.0, 2: 1.0}
    shaken = N.stability_test(_tree, data, "classification", "id", "monte_carlo", n_iterations=2, perturbation=50.0)
    assert all(r["value"] < 1 for r in shaken.where("metric = 'accuracy'").collect())
    doubled = N.stability_test(_tree, data, "classification", "id", "monte_carlo", n_iterations=1, transform=lambda d: d.where("id < 60"))
    assert doubled.where("metric like 'error%'").count() == 0


def test_failures_are_rows(data):
    class Broken:
        def fit(self, train):
            raise RuntimeError("no fit today")
    got = N.stability_test(lambda seed: Broken(), data, "classification", "id", "kfold", n_iterations=2).collect()
    assert [(r["iteration"], r["metric"], r["value"]) for r in got] == [(0, "error: no fit today", None), (1, "error: no fit today", None)]
    got = N.param_stability(_tree(1), data, "classification", "id", "maxDepth", [2, -1]).collect()
    assert {r["param"] for r in got} == {"2", "-1"}
    assert [r["value"] for r in got if r["param"] == "-1"] == [None] and any("error" in r["metric"] for r in got)


def test_calibration_refits_for_each_fold(data):
    got = {r["split"]: r["brier_score"] for r in N.calibration_by_fold(_tree, data, "id", n_splits=3).collect()}
    for i, (train, test) in enumerate(N.folds(data, "classification", "id", "stratified_kfold", 3)):
        pred = _tree(42).fit(train).transform(test).withColumn("p", vector_to_array("probability")[1])
        assert got[i] == pytest.approx(brier(pred, "label", "p").first()["brier"])

    class Bare:
        def fit(self, train):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))
    assert [(r["split"], r["brier_score"]) for r in N.calibration_by_fold(lambda seed: Bare(), data, "id").collect()] == [(None, None)]


def test_a_text_model_counts_words_once(spark):
    """Each row is read for the labels and for the counts, not by every pass of the fit."""
    from tessera.plans.models import make_estimator
    rows = [(i, "good" if i % 2 else "bad", f"{'fine' if i % 2 else 'poor'} text number {i % 7}" if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, quality string, text string").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b
    est = make_estimator("classification", "logistic_regression", seed=42)
    model = N.fit_text_model(est, "quality", "text", df.mapInArrow(counted, df.schema))
    assert read.value <= 2 * len(rows)
    plain = N.text_model(est, "quality", "text").fit(df)
    of = lambda m: [(r["doc_id"], r["prediction"]) for r in m.transform(df).orderBy("doc_id").collect()]
    assert of(model) == of(plain)


def test_typos_draw_once_for_a_letter_that_stays(spark):
    rows = [(i, "Some words, \u00e9\u4e2d 12 and more of them " * 5) for i in range(20)] + [(None, "no id"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    draw = lambda i, salt: F.pmod(F.xxhash64("doc_id", i, F.lit(3), F.lit(salt)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    hit = lambda c, i: (draw(i, "hit") < F.lit(0.3)) & c.rlike(r"^\p{L}$")
    step = lambda c, i: (F.when(hit(c, i) & (draw(i, "act") < 0.5), F.lit(""))
                         .when(hit(c, i), F.char(F.lit(97) + F.floor(draw(i, "letter") * 26).cast("int"))).otherwise(c))
    expected = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), ""), step), "")
    both = df.select(N.typo_text("text", "doc_id", 0.3, 3).alias("a"), expected.alias("b"))
    assert all(r["a"] == r["b"] for r in both.collect())
    plan = df.select(N.typo_text("text", "doc_id", 0.3, 3).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", hit, ") == 1
