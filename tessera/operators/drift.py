"""Distribution drift between a reference and a current frame.

Both sides are unpivoted to (column, side, value) so that every column of a
kind is tested in one job.  Numeric columns get the two-sample KS statistic
(counts per distinct value and side, then exact prefix sums -- no row-level
sort, no single-partition window); other columns get a chi-square test of the
2 x k table of category counts (null counted as ``__nan__``), with Yates'
continuity correction when there is one degree of freedom.  Only the final
per-column numbers (bounded by the number of columns) reach the driver, where
the p-values are scalar math.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.pvalues import chi2_sf, ks_2samp_p
from tessera.operators.ordering import prefix_sums
from tessera.session import cut_lineage

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType, T.BooleanType)
NAN_LABEL = "__nan__"

REPORT_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("feature_type", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("statistic", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()),
    T.StructField("p_method", T.StringType()),
    T.StructField("reference_mean", T.DoubleType()),
    T.StructField("current_mean", T.DoubleType()),
    T.StructField("categories_compared", T.LongType()),
    T.StructField("drift_detected", T.BooleanType()),
])


def column_kinds(ref: DataFrame, cur: DataFrame, columns=None) -> tuple[list[str], list[str]]:
    """Common columns split by the reference side's type (numeric vs other)."""
    cur_cols = set(cur.columns)
    cols = [c for c in (columns or ref.columns) if c in cur_cols]
    types = dict((f.name, f.dataType) for f in ref.schema.fields)
    num = [c for c in cols if isinstance(types[c], NUMERIC)]
    cat = [c for c in cols if c not in num]
    return num, cat


def _long(df: DataFrame, cols: list[str], side: int, as_type: str) -> DataFrame:
    vals = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("v"))
                     for c in cols])
    return df.select(F.lit(side).alias("side"), F.inline(vals))


def sides_long(ref: DataFrame, cur: DataFrame, cols: list[str], as_type: str) -> DataFrame:
    return _long(ref, cols, 0, as_type).unionByName(_long(cur, cols, 1, as_type))


def numeric_value_counts(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(column, v, n1, n2): rows per distinct value and side, nulls and NaN dropped."""
    long = sides_long(ref, cur, cols, "double")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    return long.groupBy("column", "v").agg(
        F.count_if(F.col("side") == 0).alias("n1"), F.count_if(F.col("side") == 1).alias("n2"))


def ks_statistics(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """column, n_ref, n_cur, statistic (max |F_ref - F_cur|), reference_mean, current_mean."""
    # several consumers read the distinct-value table: materialise it once
    # (far smaller than the rows) instead of rescanning per consumer
    counts = cut_lineage(numeric_value_counts(ref, cur, cols))
    sizes = counts.groupBy("column").agg(
        F.sum("n1").alias("n_ref"), F.sum("n2").alias("n_cur"),
        (F.sum(F.col("v") * F.col("n1")) / F.sum("n1")).alias("reference_mean"),
        (F.sum(F.col("v") * F.col("n2")) / F.sum("n2")).alias("current_mean"))
    cum = prefix_sums(counts, "v", ["n1", "n2"], partition_cols=["column"])
    # sizes: one row per column
    cum = cum.join(F.broadcast(sizes.select("column", "n_ref", "n_cur")), "column")
    gap = F.abs(F.col("n1_cum") / F.col("n_ref") - F.col("n2_cum") / F.col("n_cur"))
    stat = cum.groupBy("column").agg(F.max(gap).alias("statistic"))
    out = sizes.join(stat, "column", "left")
    return out.select("column", "n_ref", "n_cur", "statistic", "reference_mean", "current_mean")


def category_counts(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """(column, category, n_ref, n_cur) over the union of categories (C05);
    null is the category ``__nan__``.  One grouped count, no outer join."""
    long = sides_long(ref, cur, cols, "string")
    long = long.withColumn("v", F.coalesce("v", F.lit(NAN_LABEL)))
    return long.groupBy("column", F.col("v").alias("category")).agg(
        F.count_if(F.col("side") == 0).alias("n_ref"), F.count_if(F.col("side") == 1).alias("n_cur"))


def chi2_statistics(ref: DataFrame, cur: DataFrame, cols: list[str]) -> DataFrame:
    """column, categories_compared, n_ref, n_cur, statistic (chi-square of the
    2 x k table; Yates when k = 2; 0 when a side is empty or k = 1)."""
    cc = category_counts(ref, cur, cols)
    tot = cc.groupBy("column").agg(
        F.sum("n_ref").alias("r1"), F.sum("n_cur").alias("r2"),
        F.count(F.lit(1)).alias("categories_compared"))
    d = cc.join(F.broadcast(tot), "column")
    n = F.col("r1") + F.col("r2")
    colsum = F.col("n_ref") + F.col("n_cur")
    yates = F.col("categories_compared") == 2

    def term(obs, rowsum):
        e = rowsum * colsum / n
        diff = e - obs
        adj = F.when(yates, obs + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))).otherwise(obs)
        return (adj - e) * (adj - e) / e

    d = d.withColumn("_t", term(F.col("n_ref"), F.col("r1")) + term(F.col("n_cur"), F.col("r2")))
    stat = d.groupBy("column").agg(F.sum("_t").alias("_chi2"))
    out = tot.join(stat, "column")
    degenerate = (F.col("r1") == 0) | (F.col("r2") == 0) | (F.col("categories_compared") < 2)
    return out.select(
        "column", "categories_compared", F.col("r1").alias("n_ref"), F.col("r2").alias("n_cur"),
        F.when(degenerate, F.lit(0.0)).otherwise(F.col("_chi2")).alias("statistic"))


def drift_statistics(ref: DataFrame, cur: DataFrame, columns=None) -> DataFrame:
    """The SQL-checkable part of the report: one row per common column."""
    num, cat = column_kinds(ref, cur, columns)
    parts = []
    if num:
        ks = ks_statistics(ref, cur, num)
        parts.append(ks.select(
            "column", F.lit("numeric").alias("feature_type"), F.lit("ks_2samp").alias("test"),
            "statistic", "reference_mean", "current_mean",
            F.lit(None).cast("long").alias("categories_compared"), "n_ref", "n_cur"))
    if cat:
        ch = chi2_statistics(ref, cur, cat)
        parts.append(ch.select(
            "column", F.lit("categorical").alias("feature_type"), F.lit("chi2_contingency").alias("test"),
            "statistic", F.lit(None).cast("double").alias("reference_mean"),
            F.lit(None).cast("double").alias("current_mean"), "categories_compared", "n_ref", "n_cur"))
    if not parts:
        raise ValueError("no common columns to compare")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drift(ref: DataFrame, cur: DataFrame, columns=None, threshold: float = 0.05,
          exact_limit: int = 10000) -> DataFrame:
    """Full drift report (C01): statistics from Spark, p-values and the flag
    from scalar math on the per-column rows."""
    spark: SparkSession = ref.sparkSession
    rows = drift_statistics(ref, cur, columns).collect()  # one row per column
    out = []
    for r in rows:
        if r["feature_type"] == "numeric":
            if not r["n_ref"] or not r["n_cur"]:
                p, method = None, "empty"
            else:
                p, method = ks_2samp_p(r["statistic"], int(r["n_ref"]), int(r["n_cur"]), exact_limit)
        else:
            k = int(r["categories_compared"])
            if not r["n_ref"] or not r["n_cur"] or k < 2:
                p, method = 1.0, "degenerate"
            else:
                p, method = chi2_sf(r["statistic"], k - 1), "chi2"
        out.append((r["column"], r["feature_type"], r["test"], r["statistic"], p, method,
                    r["reference_mean"], r["current_mean"], r["categories_compared"],
                    None if p is None else bool(p < threshold)))
    return spark.createDataFrame(out, REPORT_SCHEMA)


def drift_summary(report: DataFrame) -> DataFrame:
    """Drifting-feature count and a status label."""
    return report.agg(
        F.count(F.lit(1)).alias("features"),
        F.count_if(F.col("drift_detected")).alias("drifting_features")).withColumn(
        "status", F.when(F.col("drifting_features") > 0, F.lit("drift")).otherwise(F.lit("stable")))
