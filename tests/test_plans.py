"""Plan checks: filters reach the scan, columns are pruned, the global-order
primitives never gather rows into a single partition, bounded sides are
broadcast."""

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.operators.drift import drift_statistics
from tessera.operators.ordering import hash_rank, prefix_sums
from tessera.sources.telemetry import recent


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_filter_pushed_down(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    p = _plan(recent(e, "ts", 7, "2024-01-31").select("event_id"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in p


def test_hash_rank_has_no_single_partition(spark, sf):
    d = spark.read.parquet(f"{sf}/labels.parquet").withColumn("h", hash_hex("doc_id"))
    p = _plan(hash_rank(d, "h", ["doc_id"], ["quality"]))
    assert "SinglePartition" not in p


def _single_partition_inputs(plan: str) -> list[str]:
    lines = [x.strip() for x in plan.splitlines()]
    return [lines[i + 1] for i, x in enumerate(lines) if "Exchange SinglePartition" in x]


def test_prefix_sums_gathers_only_bucket_totals(spark):
    """Without partition columns the only single-partition step is the
    cumulation of per-bucket totals (<= buckets rows), never the rows."""
    d = spark.range(0, 5000).select(F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    inputs = _single_partition_inputs(_plan(prefix_sums(d, "v", ["n"])))
    assert inputs, "expected the bucket-total cumulation"
    for line in inputs:
        assert "HashAggregate(keys=[_bk" in line


def test_drift_uses_bounded_broadcasts(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ref = e.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).select("value", "event_type")
    cur = e.where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).select("value", "event_type")
    p = _plan(drift_statistics(ref, cur))
    assert "BroadcastHashJoin" in p
    schemas = [x.split("ReadSchema: ")[1] for x in p.split(", ") if "ReadSchema: " in x]
    assert schemas and all("user_id" not in s and "props" not in s for s in schemas)
    assert any("PushedFilters: [IsNotNull(ts), LessThan(ts," in x for x in p.split("\n"))


def test_general_check_runs_ten_iterations_of_each_study(spark, monkeypatch):
    """Fits are left out: only the number of fits is looked at."""
    from tessera.plans import q_studies as Q
    from tessera.plans import studies as N
    fits = []
    monkeypatch.setattr(Q, "_data", lambda *_: (spark.createDataFrame([(i, 0.0) for i in range(20)], "doc_id long, label double"), None))
    monkeypatch.setattr(N, "_metrics", lambda pred, *_, **__: spark.createDataFrame([("accuracy", 1.0)], "metric string, value double"))

    class Model:
        def fit(self, df):
            fits.append(1)
            return self

        def transform(self, df):
            return df
    monkeypatch.setattr(Q, "_rf", lambda seed: Model())
    Q.n08(spark, None)
    assert len(fits) == 20


def test_typos_are_scored_by_a_text_model(spark, sf):
    import __spark_entry__ as entry
    rows = entry.queries()["N09_text_typos"](spark, sf).collect()
    accuracy = {r["iteration"]: r["value"] for r in rows if r["metric"] == "accuracy"}
    assert sorted(accuracy) == [-1, 0, 1, 2] and all(0 <= v <= 1 for v in accuracy.values())
    assert {r["param"] for r in rows} == {"0.1"}


def test_early_stop_equals_a_plain_scan(spark):
    import random

    from tessera.operators.runs import early_stop_trace
    rng = random.Random(1)
    rows = []
    for model in ("a", "b", None):
        best = 0.0
        for t in range(1, 120):
            best += rng.choice([0, 0, 0, 0.00005, 0.0003])
            rows.append((model, t, rng.choice([None, float("nan"), best, best - rng.random(), -1.0])))
    rows += [("up", t, t * 0.00007) for t in range(1, 60)]  # every score is a record
    got = {(r.model, r.trial): (r.best_so_far, r.without_improvement, r.stopped)
           for r in early_stop_trace(spark.createDataFrame(rows, "model string, trial long, score double").repartition(4), ["model"], "trial", "score", rounds=7).collect()}
    for model in {r[0] for r in rows}:
        best, waits, stopped = None, 0, False
        for _, t, s in (r for r in rows if r[0] == model):
            stopped = stopped or waits >= 7
            if s is not None and s == s and (best is None or s > best + 1e-4):
                best, waits = s, 0
            else:
                waits += 1
            assert got[model, t] == (best, waits, stopped), (model, t)
