"""Inference log table.

The log is an append-only Parquet table partitioned by day; batch scoring and
the streaming sink write the same layout.  Reading "the last N days" is a
partition-pruned filter against an explicit ``as_of`` (never ``now()``), so a
result repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_COLUMNS = ["event_id", "timestamp_utc", "model_version", "row_count", "request_json",
               "predictions_json", "date"]


def to_log(df: DataFrame, id_col: str, ts_col: str, version_col: str, request_cols,
           prediction_col: str) -> DataFrame:
    """Shape scored rows as log records: request and prediction as JSON text."""
    req = [c for c in request_cols]
    return df.select(
        F.col(id_col).cast("long").alias("event_id"),
        F.col(ts_col).cast("timestamp_ntz").alias("timestamp_utc"),
        F.col(version_col).cast("string").alias("model_version"),
        F.lit(1).cast("long").alias("row_count"),
        F.to_json(F.struct(*[F.col(c) for c in req])).alias("request_json"),
        F.to_json(F.array(F.col(prediction_col))).alias("predictions_json"),
        F.to_date(F.col(ts_col)).alias("date"))


def append_log(df: DataFrame, path: str) -> None:
    """Append records, one folder per day."""
    df.write.mode("append").partitionBy("date").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def window_start(days: int, as_of: str) -> Column:
    if not 1 <= int(days) <= 30:
        raise ValueError("days must be within 1..30")
    return F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(int(days)))


def recent(df: DataFrame, ts_col: str, days: int = 7, as_of: str = "2024-01-31",
           date_col: str | None = None) -> DataFrame:
    """Rows with ts >= as_of - days.  With a day partition column
    the same bound prunes folders first."""
    start = window_start(days, as_of)
    cond = F.col(ts_col) >= start
    if date_col:
        cond = (F.col(date_col) >= F.to_date(start)) & cond
    return df.where(cond)
