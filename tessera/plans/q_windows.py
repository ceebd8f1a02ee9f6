"""Window queries: time-series features and trial sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import runs as RU
from tessera.operators.timeseries import ts_features
from tessera.plans.registry import register
from tessera.session import table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def daily_event_totals(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.to_date("ts").cast("timestamp_ntz").alias("day")).agg(
        F.sum("value").alias("total"))


def runs_from_events(spark, sf):
    """Run table by rule: experiment = user_id % 5, model = event_type,
    score = value, status by event_id % 4, duration = value * 37 s."""
    e = table(spark, sf, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in ("completed", "running", "failed", "queued")]),
                          (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("run_id"), (F.col("user_id") % 5).cast("string").alias("experiment"),
                    F.col("event_type").alias("model"), F.col("value").alias("score"),
                    F.col("ts").alias("start_time"), (F.col("value") * 37.0).alias("duration"),
                    status.alias("status"), "user_id")


_RUNS_SQL = """(SELECT event_id AS run_id, CAST(user_id % 5 AS VARCHAR) AS experiment, event_type AS model,
  value AS score, ts AS start_time, value * 37.0 AS duration,
  ['completed', 'running', 'failed', 'queued'][event_id % 4 + 1] AS status, user_id FROM events)"""

_TS_COLS = ["hour", "dayofweek", "quarter", "month", "year", "dayofyear", "dayofmonth", "weekofyear"]


@register("J04_ts_features", """
WITH d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, sum(value) AS total FROM events GROUP BY ALL),
f AS (SELECT event_type, day, round(total, 6) AS total,
        CAST(hour(day) AS INTEGER) AS hour, CAST(isodow(day) - 1 AS INTEGER) AS dayofweek,
        CAST(quarter(day) AS INTEGER) AS quarter, CAST(month(day) AS INTEGER) AS month, CAST(year(day) AS INTEGER) AS year,
        CAST(dayofyear(day) AS INTEGER) AS dayofyear, CAST(day(day) AS INTEGER) AS dayofmonth,
        CAST(weekofyear(day) AS INTEGER) AS weekofyear,
        round(lag(total, 1) OVER w, 6) AS lag_1, round(lag(total, 2) OVER w, 6) AS lag_2,
        round(lag(total, 3) OVER w, 6) AS lag_3, round(lag(total, 4) OVER w, 6) AS lag_4,
        round(lag(total, 5) OVER w, 6) AS lag_5,
        round(CASE WHEN count(total) OVER w3 = 3 THEN avg(total) OVER w3 END, 6) AS rolling_mean_1,
        round(CASE WHEN count(total) OVER w3 = 3 THEN stddev_samp(total) OVER w3 END, 6) AS rolling_std_1
      FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day),
                    w3 AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT * FROM f WHERE lag_5 IS NOT NULL AND rolling_mean_1 IS NOT NULL AND rolling_std_1 IS NOT NULL""")
def j04(spark, sf):
    f = ts_features(daily_event_totals(spark, sf), "day", "total", id_col="day", horizon=1,
                    series_cols=["event_type"])
    num = ["total", "lag_1", "lag_2", "lag_3", "lag_4", "lag_5", "rolling_mean_1", "rolling_std_1"]
    return f.select("event_type", "day", *[F.col(c).cast("int") for c in _TS_COLS], *[_r6(c) for c in num])


@register("J01_lags_rolling", """
WITH d AS (SELECT date_trunc('month', o_orderdate) AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT month, round(total, 6) AS total,
       round(lag(total, 2) OVER w, 6) AS lag_2, round(lag(total, 3) OVER w, 6) AS lag_3,
       round(lag(total, 4) OVER w, 6) AS lag_4, round(lag(total, 5) OVER w, 6) AS lag_5,
       round(lag(total, 6) OVER w, 6) AS lag_6,
       round(CASE WHEN count(total) OVER w3 = 3 THEN avg(total) OVER w3 END, 6) AS rolling_mean_2,
       round(CASE WHEN count(total) OVER w3 = 3 THEN stddev_samp(total) OVER w3 END, 6) AS rolling_std_2
FROM d WINDOW w AS (ORDER BY month), w3 AS (ORDER BY month ROWS BETWEEN 4 PRECEDING AND 2 PRECEDING)""")
def j01(spark, sf):
    o = table(spark, sf, "orders")
    m = o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.sum("o_totalprice").alias("total"))
    f = ts_features(m, "month", "total", id_col="month", horizon=2, with_calendar=False, drop_incomplete=False,
                    block=12)
    cols = ["total", "lag_2", "lag_3", "lag_4", "lag_5", "lag_6", "rolling_mean_2", "rolling_std_2"]
    return f.select("month", *[_r6(c) for c in cols])


def numbered_runs(spark, sf):
    r = runs_from_events(spark, sf)
    return RU.number_trials(r, ["experiment", "model"], ["start_time", "run_id"])


@register("J05_trial_number", f"""
SELECT run_id, experiment, model,
       CAST(row_number() OVER (PARTITION BY experiment, model ORDER BY start_time, run_id) AS BIGINT) AS trial
FROM {_RUNS_SQL} r""")
def j05(spark, sf):
    return numbered_runs(spark, sf).select("run_id", "experiment", "model", F.col("trial").cast("long"))


@register("J06_running_best", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY experiment, model ORDER BY start_time, run_id) AS trial
           FROM {_RUNS_SQL} r),
b AS (SELECT *, max(score) OVER (PARTITION BY experiment, model ORDER BY trial
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM t),
i AS (SELECT *, best_before IS NULL OR score > best_before AS improved FROM b),
l AS (SELECT *, max(CASE WHEN improved THEN trial END) OVER (PARTITION BY experiment, model ORDER BY trial
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM i)
SELECT run_id, experiment, model, CAST(trial AS BIGINT) AS trial, round(best_before, 6) AS best_before, improved,
       CAST(trial - last_imp AS BIGINT) AS trials_without_improvement,
       round(greatest(best_before, score), 6) AS best_so_far FROM l""")
def j06(spark, sf):
    rb = RU.running_best(numbered_runs(spark, sf), ["experiment", "model"], "trial", "score")
    return rb.select("run_id", "experiment", "model", F.col("trial").cast("long"), _r6("best_before"), "improved",
                     "trials_without_improvement", _r6("best_so_far"))


@register("J06_early_stop_trace", f"""
WITH RECURSIVE t AS (SELECT experiment, model, score, CAST(row_number() OVER (PARTITION BY experiment, model ORDER BY start_time, run_id) AS BIGINT) AS trial
           FROM {_RUNS_SQL} r),
c AS (SELECT experiment, model, min(trial) AS trial, arg_min(score, trial) AS score FROM t WHERE score IS NOT NULL GROUP BY ALL
      UNION ALL
      SELECT c.experiment, c.model, min(t.trial), arg_min(t.score, t.trial) FROM c JOIN t
      ON t.experiment = c.experiment AND t.model = c.model AND t.trial > c.trial AND t.score > c.score + 0.0001 GROUP BY c.experiment, c.model),
l AS (SELECT t.experiment, t.model, t.trial, t.score, max(c.score) OVER w AS best_so_far, coalesce(max(c.trial) OVER w, 0) AS last
      FROM t LEFT JOIN c ON t.experiment = c.experiment AND t.model = c.model AND t.trial = c.trial
      WINDOW w AS (PARTITION BY t.experiment, t.model ORDER BY t.trial))
SELECT experiment, model, trial, round(score, 6) AS score, round(best_so_far, 6) AS best_so_far, trial - last AS without_improvement,
       coalesce(max(trial - last) OVER (PARTITION BY experiment, model ORDER BY trial ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 10 AS stopped
FROM l""")
def j06e(spark, sf):
    """Exact 1e-4 improvement rule with a 10-round stop."""
    r = RU.early_stop_trace(numbered_runs(spark, sf), ["experiment", "model"], "trial", "score")
    return r.select("experiment", "model", F.col("trial").cast("long"), _r6("score"), _r6("best_so_far"), "without_improvement", "stopped")


@register("J07_best_per_model", f"""
SELECT model, run_id, round(score, 6) AS score, experiment FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, run_id) AS rk FROM {_RUNS_SQL} r) WHERE rk = 1""")
def j07(spark, sf):
    b = RU.best_per_group(runs_from_events(spark, sf), ["model"], "score", "run_id", ["experiment"])
    return b.select("model", "run_id", _r6("score"), "experiment")


@register("J08_score_rank", f"""
WITH b AS (SELECT experiment, max(score) AS best FROM {_RUNS_SQL} r GROUP BY 1)
SELECT experiment, round(best, 6) AS best, CAST(dense_rank() OVER (ORDER BY best DESC) AS INTEGER) AS rank FROM b""")
def j08(spark, sf):
    b = runs_from_events(spark, sf).groupBy("experiment").agg(F.max("score").alias("best"))
    return RU.rank_scores(b, "best").select("experiment", _r6("best"), F.col("rank").cast("int"))


@register("J09_progress_series", f"""
SELECT model, experiment, CAST(row_number() OVER w AS BIGINT) AS trial, round(score, 6) AS score,
       round(max(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_max
FROM {_RUNS_SQL} r WINDOW w AS (PARTITION BY experiment, model ORDER BY start_time, run_id)""")
def j09(spark, sf):
    from tessera.operators.ordering import running_agg
    n = numbered_runs(spark, sf)
    s = running_agg(n, ["experiment", "model"], "trial", "score", "max", name="running_max")
    return s.select("model", "experiment", F.col("trial").cast("long"), _r6("score"), _r6("running_max"))


@register("J10_latest_version", """
SELECT event_type AS model, arg_max(event_id, (event_id % 13) * 1000000000 + event_id) AS event_id,
       CAST(max(event_id % 13) AS BIGINT) AS latest_version FROM events GROUP BY 1""")
def j10(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("model"),
                                          (F.col("event_id") % 13).cast("string").alias("version"), "event_id")
    return RU.latest_version(e, ["model"], "version", "event_id")
