import datetime as dt
import math
import random

import pytest
from pyspark.ml.functions import vector_to_array

from tessera.operators.features import FeaturePipeline, FittedFeatures
from tessera.session import shared_dir
from tessera.streaming import telemetry as ST

SCHEMA = "ts timestamp_ntz, value double, kind string"


def _rows(rng, n, days, kinds):
    return [(dt.datetime(2024, 1, 1 + rng.randrange(days), rng.randrange(24)), rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(2, 3)]),
             rng.choice(kinds)) for _ in range(n)]


def _brute(base, cur, bins):
    values = [v for _, v, _ in base if v is not None and v == v]
    low, high = min(values), max(values)
    width = (high - low) / bins or 1.0
    at = lambda v: max(-1, min(bins, math.floor((v - low) / width)))
    out = {}
    for day in {t.date() for t, _, _ in cur}:
        rows = [r for r in cur if r[0].date() == day]
        a, b = ([at(v) for _, v, _ in x if v is not None and v == v] for x in (base, rows))
        if b:
            out[day, "value", "ks"] = max(abs(sum(x <= k for x in a) / len(a) - sum(x <= k for x in b) / len(b)) for k in range(-1, bins + 1))
        names = [r[2] if r[2] is not None else "__nan__" for r in base], [r[2] if r[2] is not None else "__nan__" for r in rows]
        cats = sorted({*names[0], *names[1]})
        r1, r2 = len(names[0]), len(names[1])
        total = 0.0
        for c in cats:
            o1, o2 = names[0].count(c), names[1].count(c)
            for o, r in ((o1, r1), (o2, r2)):
                e = r * (o1 + o2) / (r1 + r2)
                d = e - o
                adj = o + (d > 0) * min(0.5, abs(d)) - (d < 0) * min(0.5, abs(d)) if len(cats) == 2 else o
                total += (adj - e) ** 2 / e
        out[day, "kind", "chi2"] = total if len(cats) > 1 else 0.0
    return out


@pytest.mark.parametrize("kinds", [["a", "b", "c", None], ["a", "b"], ["a"]])
def test_drift_of_a_stream_equals_brute_force(spark, kinds):
    rng = random.Random(len(kinds))
    base = _rows(rng, 200, 3, kinds)
    cur = _rows(rng, 120, 8, kinds[:1]) + _rows(rng, 60, 4, [*kinds, "new"] if len(kinds) > 2 else kinds)
    monitor = ST.DriftMonitor(spark.createDataFrame(base, SCHEMA), "ts", ["value"], ["kind"], bins=7)
    s = ST.stream_scratch(spark, "drift-test")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(s["source"])
    # two runs of the stream: the second adds to the windows of the first
    for part in (cur[:100], cur[100:]):
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(s["source"])
        monitor.run(stream(), s["sink"], s["checkpoint"])
    got = {(r.window_start.date(), r.column, r.test): r.statistic for r in monitor.report(monitor.state(s["sink"])).collect()}
    expected = _brute(base, cur, 7)
    assert got.keys() == expected.keys()
    assert got == pytest.approx(expected, abs=1e-9)
    whole = {(r.window_start.date(), r.column, r.test): r.statistic for r in monitor.report(monitor.counts(spark.createDataFrame(cur, SCHEMA))).collect()}
    assert whole == pytest.approx(got)


def test_features_are_the_same_after_save_and_load(spark):
    rows = [(k, f"word{k % 3} other{k % 5}", float(k), "ab"[k % 2], f"v{k}", "yn"[k % 2]) for k in range(40)] + [(99, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, size double, low string, high string, y string")
    fitted = FeaturePipeline(target="y", text_cols=["text"], id_col="id", ngram_range=(1, 1)).fit(df)
    path = shared_dir(spark, "fitted")
    fitted.save(path)
    back = FittedFeatures.load(spark, path)
    assert back.feature_names() == fitted.feature_names()
    rows_of = lambda f: sorted((r[0], r[1], -1 if r[2] is None else r[2]) for r in f.transform(df).select("id", vector_to_array("features"), "label").collect())

    assert rows_of(back) == rows_of(fitted)
