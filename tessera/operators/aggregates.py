"""Aggregation, order statistics and top-k (D01-D08) plus exact quantiles.

Exact quantiles avoid Spark's ``percentile`` (which keeps a value -> count
map for the whole column in one buffer): values are counted per distinct
value, ranks come from bucketed prefix sums, and the interpolation target
ranks form a tiny table joined by group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import null_safe_join, prefix_sums
from tessera.session import cut_lineage


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts per class with the minimum class count and whether a stratified
    split is possible (every class has more than one row)."""
    counts = value_counts(df, label, "class_count")
    mins = counts.agg(F.min("class_count").alias("min_class_count"),
                      F.count(F.lit(1)).alias("n_classes"))
    m = mins.first()  # one row
    return counts.withColumns({
        "min_class_count": F.lit(m["min_class_count"]).cast("long"),
        "n_classes": F.lit(m["n_classes"]).cast("long"),
        "can_stratify": F.lit(bool(m["min_class_count"] and m["min_class_count"] > 1)),
    })


def exact_quantiles(df: DataFrame, col: str, probs, group_cols=(), name: str = "value") -> DataFrame:
    """Linearly interpolated quantiles (numpy/pandas default) per group:
    rows (group..., p, value).  Nulls and NaN are ignored."""
    groups = list(group_cols)
    v = F.col(col).cast("double")
    vc = (df.select(*groups, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
          .groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n")))
    vc = cut_lineage(vc)  # value counts feed four consumers
    cum = prefix_sums(vc, "_v", ["_n"], partition_cols=groups)
    tot = vc.groupBy(*groups).agg(F.sum("_n").alias("_N"))
    probs_arr = F.array(*[F.lit(float(p)) for p in probs])
    t = tot.select(*groups, "_N", F.explode(probs_arr).alias("p"))
    pos = (F.col("_N") - 1) * F.col("p")
    t = t.withColumns({"_lo": F.floor(pos).cast("long") + 1, "_hi": F.ceil(pos).cast("long") + 1,
                       "_frac": pos - F.floor(pos)})
    ranks = t.select(*groups, "p", "_frac", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("_lo").alias("r")),
        F.struct(F.lit(1).alias("which"), F.col("_hi").alias("r")))).alias("_t")).select(
        *groups, "p", "_frac", "_t.which", "_t.r")
    key = groups if groups else None
    cond = (F.col("r") > F.col("_n_cum") - F.col("_n")) & (F.col("r") <= F.col("_n_cum"))
    if key:
        j = null_safe_join(cum, ranks, key).where(cond)
    else:
        j = cum.withColumn("_k", F.lit(0)).join(
            F.broadcast(ranks.withColumn("_k", F.lit(0))), on="_k", how="inner").where(cond)
    lohi = j.groupBy(*groups, "p").agg(
        F.max(F.when(F.col("which") == 0, F.col("_v"))).alias("_vlo"),
        F.max(F.when(F.col("which") == 1, F.col("_v"))).alias("_vhi"),
        F.max("_frac").alias("_frac"))
    return lohi.select(*groups, "p", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias(name))


def exact_median(df: DataFrame, col: str, group_cols=(), name: str = "median") -> DataFrame:
    return exact_quantiles(df, col, [0.5], group_cols, name).drop("p")


def mode(df: DataFrame, col: str, group_cols=(), name: str = "mode") -> DataFrame:
    """Most frequent non-null value; ties -> smallest value."""
    groups = list(group_cols)
    c = df.where(F.col(col).isNotNull()).groupBy(*groups, col).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*groups).agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(name))


def column_stats(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, mode, q25, q75 in one row."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    qrow = q.groupBy().pivot("p", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qrow = qrow.toDF("q25", "median", "q75")
    mean = df.agg(F.avg(col).alias("mean"))
    mo = mode(df, col)
    k = F.lit(0)
    return (mean.withColumn("_k", k).join(qrow.withColumn("_k", k), "_k")
            .join(mo.withColumn("_k", k), "_k").drop("_k"))


def summarize(study: DataFrame, metric_col: str = "metric", value_col: str = "value",
              group_cols=()) -> DataFrame:
    """Per metric mean, sample std, min, max, range, cv (0 when the
    mean is 0) and stability score 1 / (1 + std)."""
    g = [*group_cols, metric_col]
    s = study.where(F.col(value_col).isNotNull()).groupBy(*g).agg(
        F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("std"),
        F.min(value_col).alias("min"), F.max(value_col).alias("max"))
    return s.withColumns({
        "range": F.col("max") - F.col("min"),
        "cv": F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.col("mean")),
        "stability_score": F.lit(1.0) / (F.lit(1.0) + F.col("std")),
    })


def support(df: DataFrame, cols) -> DataFrame:
    """Share of rows with a positive value per 0/1 feature, one pass."""
    exprs = [F.avg(F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, 1.0).otherwise(0.0)).alias(c)
             for c in cols]
    row = df.agg(*exprs)
    return row.unpivot([], list(cols), "item", "support")


def top_k(df: DataFrame, k: int, order, tie_cols) -> DataFrame:
    """Top-k after a multi-key sort with a unique tie-break
    (TakeOrderedAndProject: no full sort)."""
    return df.orderBy(*order, *[F.col(t).asc() for t in tie_cols]).limit(k)


def confusion_matrix(df: DataFrame, label: str, prediction: str, pivot: bool = False) -> DataFrame:
    """One row per (label, prediction) with its count; pivot optional."""
    cm = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count"))
    if pivot:
        return cm.groupBy("label").pivot("prediction").agg(F.first("count"))
    return cm
