"""Helpers shared by the operators: written tables, bounded broadcasts, positions."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, shared_dir, table

__all__ = ["BROADCAST_ROWS", "bounded", "by_size", "dense_position", "documents", "ensure_checkpoint_dir",
           "importable", "materialise", "shared_dir", "small_batches", "table"]

#: A side is broadcast only after a count shows at most this many rows.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4_000_000


def importable(spark: SparkSession) -> None:
    """Let this context's Python workers import the package from the folder the
    driver imported it from (on a cluster it is installed or shipped as usual)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def small_batches(spark: SparkSession) -> None:
    """From now on this session hands Python workers batches of about ``BATCH_BYTES`` (a
    longer row alone), unless it has a limit of its own; else up to 10000 texts are held
    at once by the executor and by the worker, beside the buffers they grew in.  Short
    rows still come by the thousands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` reduced to (doc_id, text)."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The written table cuts the lineage: a lost executor costs a re-read, not a
    re-run, and values that depend on the task (partition numbers) are fixed.
    """
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if its counted ``rows`` are within ``limit``;
    beyond it the planner joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def dense_position(df: DataFrame, group: list[str], order: list[str], out: str, tag: str) -> DataFrame:
    """Add ``out``: the gapless 0-based position of a row in its ``group`` by ``order``.

    Rows are dealt by range over (group, order) and written with the number of
    their part; a part's counts by group shift the row numbers found inside it.
    A group of any size is thus numbered by many tasks.  Nulls form a group.
    Rows that tie in ``order`` get distinct positions in any order.
    """
    part, n, base = "__part", "__n", "__base"
    ranged = df.repartitionByRange(*[F.col(c) for c in group + order]).withColumn(part, F.spark_partition_id())
    fixed = materialise(ranged, tag)
    counts = fixed.groupBy(*group, part).agg(F.count(F.lit(1)).alias(n))
    # at most one row for each part within a group
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(c) for c in group]
    shifts = counts.select(*[k.alias(f"__g{i}") for i, k in enumerate(keys)], F.col(part).alias("__p"),
                           F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    local = Window.partitionBy(*group, part).orderBy(*order)
    numbered = fixed.withColumn(out, F.row_number().over(local).cast("long") - 1)
    on = F.col(part) == F.col("__p")
    for i, k in enumerate(keys):
        on = on & k.eqNullSafe(F.col(f"__g{i}"))
    return (numbered.join(shifts, on).withColumn(out, F.col(out) + F.col(base))
            .select(*df.columns, out))


def by_size(batch: pa.RecordBatch, column: int = 1, rows: int = 500, most_bytes: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch with about ``most_bytes`` of the text ``column`` at most
    (a longer text alone), so that few texts are Python strings at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    a = 0
    while a < len(sizes):
        upto = np.cumsum(sizes[a: a + rows])
        n = max(1, int(np.searchsorted(upto, most_bytes, side="right")))
        yield batch.slice(a, n)
        a += n
