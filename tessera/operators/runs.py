"""Trial / run tables: numbering, running best, early stop, leaderboards and
job views (J05-J10, O08-O16)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import range_rank, running_agg
from tessera.session import cut_lineage

RUN_SCHEMA = ("run_id bigint, experiment string, model string, trial int, score double, "
              "start_time timestamp_ntz, duration double, status string, params map<string,string>, "
              "metrics map<string,double>")


def number_trials(runs: DataFrame, model_cols, order_cols, name: str = "trial") -> DataFrame:
    """1-based trial number per model by start time (unique tie-break last)."""
    return range_rank(runs, order_cols, model_cols, name=name)


def running_best(runs: DataFrame, model_cols, trial_col: str, score_col: str) -> DataFrame:
    """J06 (min improvement 0): best score before this trial, whether this
    trial improved on it, and trials since the last improvement."""
    d = running_agg(runs, model_cols, trial_col, score_col, "max", name="best_before", inclusive=False)
    improved = F.col("best_before").isNull() | (F.col(score_col) > F.col("best_before"))
    d = d.withColumn("improved", improved)
    d = d.withColumn("_imp_rank", F.when(F.col("improved"), F.col(trial_col)))
    d = running_agg(d, model_cols, trial_col, "_imp_rank", "max", name="_last_imp")
    d = d.withColumn("trials_without_improvement", (F.col(trial_col) - F.col("_last_imp")).cast("long"))
    return d.withColumn("best_so_far", F.greatest(F.col("best_before"), F.col(score_col))).drop("_imp_rank", "_last_imp")


def _taken(keys: int, min_improvement: float):
    """Records (keys..., trial, score) sorted by keys and trial to those that move the
    best: a scan that carries one number from batch to batch."""
    def run(batches):
        now, best = None, None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            keep = []
            for k, row in enumerate(zip(*cols, strict=True)):
                if best is None or row[:keys] != now:
                    now, best = row[:keys], row[-1]
                    keep.append(k)
                elif row[-1] > best + min_improvement:
                    best = row[-1]
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64()))
    return run


def early_stop_trace(runs: DataFrame, model_cols, trial_col: str, score_col: str,
                     min_improvement: float = 1e-4, rounds: int = 10) -> DataFrame:
    """J06 exact rule: best moves only when score > best + min_improvement;
    trials after ``rounds`` non-improving trials are flagged as stopped.

    A score that is no record of its model cannot move the best (a record that was
    passed over lies within min_improvement of it), so ``running_agg`` first cuts each
    series to its records.  Only these are scanned, in order and with one carried
    number, whatever their count; all else are running maxima along the trials."""
    model_cols = list(model_cols)
    score = F.col(score_col).cast("double")
    d = runs.select(*model_cols, trial_col, score_col).withColumn("_s", F.when(~F.isnan(score) & (score > float("-inf")), score))
    d = cut_lineage(running_agg(d, model_cols, trial_col, "_s", "max", name="_before", inclusive=False))
    records = d.where("_s > _before or (_before is null and _s is not null)").select(*model_cols, trial_col, "_s")
    ordered = (records.repartition(*model_cols) if model_cols else records.coalesce(1)).sortWithinPartitions(*model_cols, trial_col)
    taken = ordered.mapInArrow(_taken(len(model_cols), min_improvement), records.schema)
    taken = taken.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(model_cols)], F.col(trial_col).alias("_t"), F.col("_s").alias("_best"))
    same = F.col(trial_col) == F.col("_t")
    for i, c in enumerate(model_cols):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    d = cut_lineage(d.join(taken, same, "left").select(*model_cols, trial_col, score_col, "_best", "_t"))
    d = running_agg(d, model_cols, trial_col, "_best", "max", name="best_so_far")
    d = running_agg(d, model_cols, trial_col, "_t", "max", name="_last")
    d = d.withColumn("without_improvement", (F.col(trial_col) - F.coalesce("_last", F.lit(0))).cast("long"))
    d = running_agg(d, model_cols, trial_col, "without_improvement", "max", name="_waited", inclusive=False)
    return d.select(*model_cols, trial_col, score_col, "best_so_far", "without_improvement",
                    (F.coalesce("_waited", F.lit(0)) >= rounds).alias("stopped"))


def best_per_group(runs: DataFrame, group_cols, score_col: str, id_col: str, keep_cols) -> DataFrame:
    """The best run per group (highest score, smallest id on ties) via
    ``max_by`` -- an aggregate, so a hot group is reduced map-side."""
    key = F.struct(F.col(score_col), -F.col(id_col))
    aggs = [F.max_by(F.col(c), key).alias(c) for c in [id_col, score_col, *keep_cols]]
    return runs.groupBy(*group_cols).agg(*aggs)


def rank_scores(best: DataFrame, score_col: str, name: str = "rank") -> DataFrame:
    """Dense rank of (already aggregated, one row per experiment) scores."""
    from pyspark.sql import Window
    return best.withColumn(name, F.dense_rank().over(Window.orderBy(F.col(score_col).desc())))


def latest_version(versions: DataFrame, group_cols, version_col: str, value_col: str) -> DataFrame:
    """Latest by numeric (not string) version; equal versions -> the
    largest value, so the pick is deterministic."""
    key = F.struct(F.col(version_col).cast("long"), F.col(value_col))
    return versions.groupBy(*group_cols).agg(
        F.max_by(F.col(value_col), key).alias(value_col),
        F.max(F.col(version_col).cast("long")).alias("latest_version"))


def leaderboard(runs: DataFrame, model_cols, score_col: str, id_col: str, duration_col: str) -> DataFrame:
    """Per model best score and its run, mean score, trials and total duration."""
    key = F.struct(F.col(score_col), -F.col(id_col))
    return runs.groupBy(*model_cols).agg(
        F.max(score_col).alias("best_score"), F.max_by(F.col(id_col), key).alias("best_run"),
        F.avg(score_col).alias("mean_score"), F.count(F.lit(1)).alias("trials"),
        F.sum(duration_col).alias("total_duration"))


def run_details(long: DataFrame, run_col: str, key_col: str, value_col: str, name: str = "entries") -> DataFrame:
    """One map per run from (run, key, value) rows -- bounded by the
    number of parameters / metrics of one run."""
    return long.groupBy(run_col).agg(F.map_from_entries(F.collect_list(F.struct(key_col, value_col))).alias(name))


def filter_jobs(jobs: DataFrame, status_col: str, name_col: str, time_col: str, statuses=None,
                search: str | None = None) -> DataFrame:
    """Filter by status and a case-insensitive name search, newest first."""
    d = jobs
    if statuses:
        d = d.where(F.col(status_col).isin(list(statuses)))
    if search:
        d = d.where(F.lower(F.col(name_col)).contains(search.lower()))
    return d.orderBy(F.col(time_col).desc())


def status_counts(jobs: DataFrame, status_col: str, statuses) -> DataFrame:
    """One row with a count per status plus totals, one aggregate."""
    return jobs.agg(F.count(F.lit(1)).alias("total"),
                    *[F.count_if(F.col(status_col) == s).alias(s) for s in statuses])


def progress(done: int | F.Column, trials_per_model, n_models) -> F.Column:
    """Trials done / (trials per model x models), capped at 1."""
    d = done if isinstance(done, F.Column) else F.lit(done)
    return F.least(F.lit(1.0), d / (F.lit(trials_per_model) * F.lit(n_models)))


def log_runs(df: DataFrame, path: str) -> None:
    """Append run rows to the run table (partitioned by experiment)."""
    df.write.mode("append").partitionBy("experiment").parquet(path)


def all_runs(spark, path: str, experiments: DataFrame | None = None) -> DataFrame:
    """Every run; experiment ids mapped to names when a table is given."""
    runs = spark.read.parquet(path)
    if experiments is not None:
        runs = runs.join(F.broadcast(experiments), "experiment", "left")
    return runs
