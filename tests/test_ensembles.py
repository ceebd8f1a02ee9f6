import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import ensembles as EN


def test_vote_ties_smallest_and_weights(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (1.0, 1.0, 0.0)], "a double, b double, c double")
    out = [r["prediction"] for r in EN.vote(df, ["a", "b", "c"]).orderBy("a", "b").collect()]
    assert out == [0.0, 1.0]
    w = [r["prediction"] for r in EN.vote(df, ["a", "b", "c"], [1.0, 1.0, 3.0]).orderBy("b").collect()]
    assert w == [2.0, 0.0]


def test_weighted_median(spark):
    df = spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double")
    got = df.select(EN.weighted_median(["a", "b", "c"], [1.0, 1.0, 5.0]).alias("m")).first()["m"]
    assert got == 2.0
    got = df.select(EN.weighted_median(["a", "b", "c"], [1.0, 1.0, 1.0]).alias("m")).first()["m"]
    assert got == 2.0


def test_soft_vote(spark):
    df = spark.createDataFrame([([0.9, 0.1], [0.2, 0.8], [0.3, 0.7])], "p1 array<double>, p2 array<double>, p3 array<double>")
    assert EN.soft_vote(df, ["p1", "p2", "p3"]).first()["prediction"] == 1.0


def test_isolation_forest_and_envelope_find_planted_outliers(spark):
    rows = [(i, float(i % 17), float((i * 7) % 13)) for i in range(600)]
    rows += [(1000 + i, 200.0 + i, -150.0 - i) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    iso = EN.isolation_forest(df, ["x", "y"], "id", n_trees=30, contamination=0.01)
    flagged = {r["id"] for r in iso.where("prediction = -1").collect()}
    assert {1000 + i for i in range(6)} <= flagged
    env = EN.elliptic_envelope(df, ["x", "y"], contamination=0.01)
    flagged = {r["id"] for r in env.where("prediction = -1").collect()}
    assert {1000 + i for i in range(6)} <= flagged


def test_ransac_ignores_outliers(spark):
    rows = [(i, float(i), 2.0 * i + 1.0) for i in range(200)]
    rows += [(500 + i, float(i), 1000.0) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    final, _, n_in = EN.fit_ransac(df, ["x"], "y", "id", n_candidates=6, threshold=0.5)
    assert final.coefficients[0] == pytest.approx(2.0, rel=1e-6)
    assert n_in >= 195


def test_envelope_stands_a_fifth_of_outliers(spark):
    """A tight cloud of outliers that drags a plain mean and covariance along."""
    rng = np.random.default_rng(4)
    good = rng.normal(0, 1, (800, 2)) @ np.array([[2.0, 1.2], [0.0, 0.7]])
    bad = rng.normal(0, 0.1, (200, 2)) + [12.0, -9.0]
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([good, bad]))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    out = EN.elliptic_envelope(df, ["x", "y"], contamination=0.2, id_col="id")
    flagged = {r["id"] for r in out.where("prediction = -1").collect()}
    assert len(flagged & set(range(800, 1000))) >= 198 and len(flagged) <= 210
    iso = EN.isolation_forest(df, ["x", "y"], "id", n_trees=40, contamination=0.2)
    assert iso.count() == 1000 and set(iso.columns) == {"id", "score", "prediction"}
    assert iso.where("prediction = -1").count() <= 200


def test_moments_of_many_conditions_equal_numpy(spark):
    """Means over the values that are there, covariances over the rows that have both; the
    aggregate has a few columns, however many conditions there are."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (400, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 1.0, 3.0], [0.5, 0.0, 1.0]]) + [1e6, -5.0, 0.0]
    gone = rng.random((400, 3)) < 0.2
    rows = [(i, *[None if g else float(v) for v, g in zip(r, at, strict=True)]) for i, (r, at) in enumerate(zip(x, gone, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(7)
    conditions = [(F.col("id") % k == 0, np.arange(400) % k == 0) for k in range(1, 12)] + [(F.col("id") < 0, np.zeros(400, bool)), (F.lit(None).cast("boolean"), np.zeros(400, bool))]
    frames = []
    collect = type(df).collect
    type(df).collect = lambda self: frames.append(self) or collect(self)
    try:
        found = EN._means(df, ["a", "b", "c"], [c for c, _ in conditions])
    finally:
        type(df).collect = collect
    assert all(len(f.columns) < 12 for f in frames)
    for (mean, cov), (_, keep) in zip(found, conditions, strict=True):
        for i in range(3):
            one = x[keep & ~gone[:, i], i]
            assert mean[i] == pytest.approx(one.mean() if len(one) else 0.0, rel=1e-12)
            for j in range(3):
                both = x[keep & ~gone[:, i] & ~gone[:, j]]
                expected = np.mean((both[:, i] - both[:, i].mean()) * (both[:, j] - both[:, j].mean())) if len(both) else 0.0
                assert cov[i, j] == pytest.approx(expected, rel=1e-7, abs=1e-9)


def test_components_equal_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (200, 6)) * [5, 4, 3, 2, 1, 0.5] + 1.5
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(4)
    svd = EN.truncated_svd(df, "v", 3)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.sqrt(svd.values), s[:3])
    got = {r["id"]: r["z"] for r in svd.project(df.where("v is not null"), "v", "z").collect()}
    assert np.allclose(np.abs([got[i] for i in range(200)]), np.abs(x @ vt[:3].T))
    pca = EN.gram_components(df, "v", 2, centred=True)
    cov = np.cov(x.T)
    assert np.allclose(pca.values, np.sort(np.linalg.eigvalsh(cov))[::-1][:2]) and pca.total == pytest.approx(np.trace(cov))
    from tessera.operators.metrics import explained_variance
    assert explained_variance(pca.values, pca.total)["explained_variance_ratio"] == pytest.approx(sum(pca.values) / np.trace(cov))


def test_three_class_metrics(spark):
    from tessera.operators import metrics as M
    rng = np.random.default_rng(6)
    p = rng.dirichlet([1, 1, 1], 60).round(2) + 0.01
    p /= p.sum(axis=1, keepdims=True)
    y = rng.integers(0, 3, 60)
    df = spark.createDataFrame([("abc"[c], [float(v) for v in r]) for c, r in zip(y, p)], "y string, p array<double>")
    classes = ["a", "b", "c"]
    ll = M.log_loss_classes(df, "y", "p", classes).first()[0]
    assert ll == pytest.approx(-np.log(p[np.arange(60), y]).mean())
    assert M.brier_classes(df, "y", "p", classes).first()[0] == pytest.approx(np.mean([((p[:, k] - (y == k)) ** 2).mean() for k in range(3)]))
    auc = []
    for k in range(3):
        a, b = p[y == k, k], p[y != k, k]
        auc.append(((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b)))
    assert M.roc_auc_ovr(df, "y", "p", classes).first()[0] == pytest.approx(np.mean(auc))
    long = {r["metric"]: r["value"] for r in M.evaluate(df.withColumn("prediction", F.lit("a")), "classification", "y", "prediction", probs="p", classes=classes).collect()}
    assert long["log_loss"] == pytest.approx(ll) and long["roc_auc"] == pytest.approx(np.mean(auc))


def test_fits_read_written_rows(spark, monkeypatch):
    """Bagging and AdaBoost.R2 make the training rows and draws once; a weight is drawn once a row."""
    from pyspark.sql import functions as F
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from tessera.operators.split import poisson_weights
    from tessera.plans import ensembles as EN
    d = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(200).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("label")))
    cuts, cut = [], EN.cut_lineage
    monkeypatch.setattr(EN, "cut_lineage", lambda x: cuts.append(cut(x)) or cuts[-1])
    make = lambda s: DecisionTreeRegressor(maxDepth=2, seed=s)
    assert len(EN.fit_bagging(make, d, "id", 3)) == 3
    assert len(cuts) == 1 and {"_bw0", "_bw1", "_bw2"} <= set(cuts[0].columns)
    want = {r["id"]: r["weight"] for r in poisson_weights(d, "id", 1.0, 43).collect()}
    assert {r["id"]: r["_bw1"] for r in cuts[0].collect()} == want
    EN.fit_adaboost_r2(make, d, n_rounds=2)
    assert len(cuts) == 2 and cuts[1].count() == 200
    plan = poisson_weights(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
