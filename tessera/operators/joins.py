"""Joins and set operations.

Dimension-table joins broadcast the small side only after checking its row
count against a bound; otherwise the planner (with AQE) chooses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 1_000_000


def union_by_name(frames) -> DataFrame:
    """Concatenate by column name, missing columns -> null."""
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def complement(df: DataFrame, subset: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``subset`` (left anti join)."""
    return df.join(subset.select(id_col).distinct(), id_col, "left_anti")


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``small`` only when its row count is proven under ``limit``."""
    n = small.count()
    return F.broadcast(small) if n <= limit else small


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None, how: str = "left") -> DataFrame:
    """Map ids to names from a dimension table."""
    dim_key = dim_key or key
    d = checked_broadcast(dim)
    if dim_key != key:
        d = d.withColumnRenamed(dim_key, key)
    return df.join(d, key, how)


def align(df: DataFrame, survivors: DataFrame, id_col: str) -> DataFrame:
    """Keep rows whose id survived an upstream drop (left semi join) --
    replaces positional truncation."""
    return df.join(survivors.select(id_col), id_col, "left_semi")


def attach_truth(pred: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """Join predictions to ground truth by id."""
    return pred.join(truth, id_col, "inner")
