import itertools
import math

import pytest

from tessera.functions.pvalues import chi2_sf, ks_2samp_exact_p, kolmogorov_sf
from tessera.operators.drift import drift, drift_statistics


def test_minimal_numeric_drift(spark):
    ref = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 5]], "a int")
    cur = spark.createDataFrame([(i,) for i in [10, 20, 30, 40, 50]], "a int")
    r = drift(ref, cur).collect()[0]
    assert r["statistic"] == 1.0
    assert r["p_value"] == pytest.approx(2 / 252, rel=1e-9)
    assert r["drift_detected"] is True
    assert r["reference_mean"] == 3.0 and r["current_mean"] == 30.0


def test_mixed_drift_chi_square(spark):
    ref = spark.createDataFrame(list(zip([1, 2, 3, 4, 5], list("aabbb"))), "num int, cat string")
    cur = spark.createDataFrame(list(zip([10, 20, 30, 40, 50], list("acccc"))), "num int, cat string")
    rows = {r["column"]: r for r in drift(ref, cur).collect()}
    c = rows["cat"]
    assert c["feature_type"] == "categorical" and c["categories_compared"] == 3
    assert c["statistic"] == pytest.approx(7.333333333, rel=1e-8)
    assert c["p_value"] == pytest.approx(math.exp(-7.333333333333333 / 2), rel=1e-8)
    assert rows["num"]["test"] == "ks_2samp"


def test_yates_two_categories(spark):
    ref = spark.createDataFrame([("x",)] * 10 + [("y",)] * 5, "c string")
    cur = spark.createDataFrame([("x",)] * 4 + [("y",)] * 9, "c string")
    s = drift_statistics(ref, cur).collect()[0]["statistic"]
    # Yates: |O - E| reduced by 0.5 in every cell
    n1, n2, tot = 15, 13, 28
    obs = [[10, 5], [4, 9]]
    colsum = [14, 14]
    chi = 0.0
    for i, rs in enumerate([n1, n2]):
        for j in range(2):
            e = rs * colsum[j] / tot
            chi += (abs(obs[i][j] - e) - 0.5) ** 2 / e
    assert s == pytest.approx(chi, rel=1e-12)


def test_nulls_are_a_category(spark):
    ref = spark.createDataFrame([("a",), (None,)], "c string")
    cur = spark.createDataFrame([("a",), ("a",)], "c string")
    r = drift_statistics(ref, cur).collect()[0]
    assert r["categories_compared"] == 2


def test_pvalue_helpers():
    assert ks_2samp_exact_p(1.0, 5, 5) == pytest.approx(2 / 252)
    assert kolmogorov_sf(0.0) == 1.0
    assert kolmogorov_sf(1.36) == pytest.approx(0.0494, abs=5e-4)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi2_sf(7.333333333333333, 2) == pytest.approx(math.exp(-7.333333333333333 / 2), rel=1e-12)


def test_exact_p_keeps_small_values():
    """Counted from the paths that leave the band: no cancellation."""
    assert ks_2samp_exact_p(1.0, 40, 40) == pytest.approx(2 / math.comb(80, 40), rel=1e-9)
    assert ks_2samp_exact_p(1.0, 100, 60) == pytest.approx(2 / math.comb(160, 60), rel=1e-9)
    assert ks_2samp_exact_p(0.0, 5, 7) == 1.0


def test_exact_p_equals_all_paths():
    for m, n in ((1, 1), (3, 2), (4, 4), (5, 3), (6, 4)):
        paths = list(itertools.combinations(range(m + n), m))
        reach = []
        for p in paths:
            i = j = 0
            worst = 0
            for k in range(m + n):
                i, j = (i + 1, j) if k in p else (i, j + 1)
                worst = max(worst, abs(i * n - j * m))
            reach.append(worst)
        for w in range(m * n + 1):
            assert ks_2samp_exact_p(w / (m * n), m, n) == pytest.approx(sum(x >= w for x in reach) / len(paths), rel=1e-9)


def test_kolmogorov_limits():
    assert kolmogorov_sf(0.01) == 1.0
    assert kolmogorov_sf(0.3) == pytest.approx(0.9999906941986655, rel=1e-9)
    # both series meet at 1
    assert kolmogorov_sf(1 - 1e-12) == pytest.approx(kolmogorov_sf(1.0), rel=1e-9)
    assert kolmogorov_sf(3.0) == pytest.approx(2 * math.exp(-18), rel=1e-9)
