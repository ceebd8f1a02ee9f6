"""Run table, leaderboard and job-view queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import runs as RU
from tessera.plans.q_windows import _RUNS_SQL, runs_from_events
from tessera.plans.registry import register
from tessera.session import shared_dir


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


@register("O08_log_runs", f"""
SELECT run_id, experiment, model, round(score, 6) AS score, start_time, status FROM {_RUNS_SQL} r""")
def o08(spark, sf):
    path = shared_dir(spark, "runs")
    RU.log_runs(runs_from_events(spark, sf).select("run_id", "experiment", "model", "score", "start_time", "status"),
                path)
    back = spark.read.parquet(path)
    return back.select("run_id", "experiment", "model", _r6("score"), "start_time", "status")


@register("O09_all_runs", f"""
SELECT run_id, experiment, 'exp_' || experiment AS experiment_name, model FROM {_RUNS_SQL} r""")
def o09(spark, sf):
    runs = runs_from_events(spark, sf)
    exps = runs.select("experiment").distinct().withColumn("experiment_name", F.concat(F.lit("exp_"), "experiment"))
    return runs.join(exps, "experiment", "left").select("run_id", "experiment", "experiment_name", "model")


@register("O10_run_details", """
WITH k AS (SELECT user_id, event_type, round(sum(value), 6) AS v FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || CAST(v AS VARCHAR), ';' ORDER BY event_type) AS details
FROM k GROUP BY user_id""")
def o10(spark, sf):
    from tessera.session import table
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 6).alias("v"))
    d = RU.run_details(e, "user_id", "event_type", "v")
    canon = F.array_join(F.array_sort(F.transform(F.map_entries("entries"),
                                                  lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ";")
    return d.select("user_id", canon.alias("details"))


@register("O11_leaderboard", f"""
SELECT model, round(max(score), 6) AS best_score, arg_max(run_id, (score, -run_id)) AS best_run,
       round(avg(score), 6) AS mean_score, CAST(count(*) AS BIGINT) AS trials,
       round(sum(duration), 6) AS total_duration FROM {_RUNS_SQL} r GROUP BY model""")
def o11(spark, sf):
    lb = RU.leaderboard(runs_from_events(spark, sf), ["model"], "score", "run_id", "duration")
    return lb.select("model", _r6("best_score"), "best_run", _r6("mean_score"), F.col("trials").cast("long"),
                     _r6("total_duration"))


@register("O12_job_filter", f"""
SELECT run_id, model || '_' || CAST(user_id AS VARCHAR) AS name, status, start_time FROM {_RUNS_SQL} r
WHERE status IN ('completed', 'failed') AND contains(lower(model || '_' || CAST(user_id AS VARCHAR)), 'click')
ORDER BY start_time DESC""")
def o12(spark, sf):
    r = runs_from_events(spark, sf).withColumn("name", F.concat("model", F.lit("_"), F.col("user_id").cast("string")))
    return RU.filter_jobs(r, "status", "name", "start_time", ["completed", "failed"], "CLICK").select(
        "run_id", "name", "status", "start_time")


_STATUSES = ["completed", "running", "failed", "queued"]


@register("O15_status_counts", f"""
SELECT CAST(count(*) AS BIGINT) AS total, """ + ", ".join(
    f"CAST(count(*) FILTER (WHERE status = '{s}') AS BIGINT) AS {s}" for s in _STATUSES) + f" FROM {_RUNS_SQL} r")
def o15(spark, sf):
    c = RU.status_counts(runs_from_events(spark, sf), "status", _STATUSES)
    return c.select(*[F.col(x).cast("long") for x in ["total", *_STATUSES]])


@register("O16_progress", f"""
SELECT experiment, round(least(1.0, count(*) / (20.0 * 5)), 6) AS progress FROM {_RUNS_SQL} r GROUP BY 1""")
def o16(spark, sf):
    r = runs_from_events(spark, sf).groupBy("experiment").agg(F.count(F.lit(1)).alias("done"))
    return r.select("experiment", F.round(RU.progress(F.col("done"), 20, 5), 6).alias("progress"))
