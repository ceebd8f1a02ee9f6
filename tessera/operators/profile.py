"""Schema, profiling, integrity and preparation operators.

Every per-column measure is computed for all columns in one pass: either one
wide ``agg`` (counts, min/max) or an unpivot to (column, value) followed by
grouped counts (exact distinct counts without one distinct aggregate per
column, which would multiply rows through an Expand).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)
DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Type names accepted in a schema override, and the Spark type each maps to.
TYPE_NAMES = {
    "object": "string", "string": "string", "int64": "bigint", "bigint": "bigint",
    "float64": "double", "double": "double", "bool": "boolean", "boolean": "boolean",
    "datetime64[ns]": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp_ntz": "timestamp_ntz",
    "date": "date",
}
DATETIME_TARGETS = {"timestamp_ntz", "date"}
# Text of a manual split column that means "train".
TRAIN_WORDS = ("train", "1", "true", "tr")


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, DATETIME):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def schema_rows(df: DataFrame) -> list[tuple[str, str, str]]:
    return [(f.name, f.dataType.simpleString(), kind_of(f.dataType)) for f in df.schema.fields]


def column_kinds(df: DataFrame) -> DataFrame:
    """B03 input: (column, data_type, kind) -- from the schema, one row per column."""
    return df.sparkSession.createDataFrame(schema_rows(df), "column string, data_type string, kind string")


def kind_counts(df: DataFrame) -> DataFrame:
    """Number of numeric / datetime / categorical / ... columns."""
    return column_kinds(df).groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


def _long_strings(df: DataFrame, cols) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    return df.select(F.inline(arr))


def null_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, rows, nulls) for every column in one wide aggregate."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot(["__rows"], cols, "column", "nulls").withColumnRenamed("__rows", "rows")


def missing_report(df: DataFrame, cols=None) -> DataFrame:
    """Missing percentage per column, only columns with missing values."""
    nc = null_counts(df, cols)
    return (nc.where(F.col("nulls") > 0)
            .select("column", (F.col("nulls") * 100.0 / F.col("rows")).alias("missing_pct"))
            .orderBy("missing_pct", "column"))


def schema_table(df: DataFrame, order_col: str) -> DataFrame:
    """Column, type and the first non-null value by ``order_col``."""
    cols = [c for c in df.columns]
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    firsts = df.agg(*[F.min_by(F.col(c).cast("string"),
                               F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in cols])
    long = firsts.unpivot([], cols, "column", "sample_value")
    tdf = df.sparkSession.createDataFrame(list(types.items()), "column string, data_type string")
    return tdf.join(long, "column")


def constant_columns(df: DataFrame, cols=None) -> DataFrame:
    """A column is constant when it has at most one distinct non-null
    value, i.e. min = max or all null -- one pass, exact."""
    cols = list(cols or df.columns)
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max")]
    row = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("column"),
                             (F.col(f"{c}__min").isNull() | (F.col(f"{c}__min") == F.col(f"{c}__max"))
                              ).alias("is_constant")) for c in cols])
    return row.select(F.inline(arr))


def distinct_counts(df: DataFrame, cols=None) -> DataFrame:
    """(column, distinct_count): exact, nulls ignored; unpivot + grouped
    distinct, so partial aggregation collapses repeats before the shuffle."""
    cols = list(cols or df.columns)
    long = _long_strings(df, cols).where(F.col("v").isNotNull()).distinct()
    counts = long.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    allc = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return allc.join(counts, "column", "left").fillna(0, ["distinct_count"])


def cardinality_split(df: DataFrame, cols, threshold: int = 15) -> DataFrame:
    """Low (<= threshold distinct values) or high cardinality."""
    dc = distinct_counts(df, cols)
    return dc.withColumn("cardinality", F.when(F.col("distinct_count") <= threshold, F.lit("low"))
                         .otherwise(F.lit("high")))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """B08."""
    return df.select(col).distinct()


def filter_members(df: DataFrame, col: str, values) -> DataFrame:
    """Membership filter."""
    return df.where(F.col(col).isin(list(values)))


def split_features(df: DataFrame, targets, date_col: str | None = None):
    """(features, targets) with the date column excluded from features."""
    targets = [targets] if isinstance(targets, str) else list(targets)
    present = [t for t in targets if t in df.columns]
    feats = [c for c in df.columns if c not in present and c != date_col]
    return df.select(*feats), df.select(*present)


def shared_numeric_columns(baseline: DataFrame, current: DataFrame) -> list[str]:
    """Numeric columns of the baseline also present in the current frame,
    skipping internal ``__`` columns."""
    cur = set(current.columns)
    return [f.name for f in baseline.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name in cur and "__" not in f.name]


def cast_failures(df: DataFrame, overrides) -> DataFrame:
    """(column, target_type, failures): non-null values the cast would null."""
    rows = []
    for o in overrides:
        c, t = o["column"], TYPE_NAMES.get(o.get("type", "string"), o.get("type", "string"))
        if o.get("include", True) and c in df.columns:
            rows.append((c, t))
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, target_type string, failures long")
    agg = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"f{i}")
                   for i, (c, t) in enumerate(rows)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("target_type"),
                             F.col(f"f{i}").cast("long").alias("failures")) for i, (c, t) in enumerate(rows)])
    return agg.select(F.inline(arr))


def apply_schema(df: DataFrame, overrides) -> DataFrame:
    """Drop excluded columns; cast the rest.  Datetime targets use
    ``try_cast`` (bad values -> null); any other cast that would fail on a
    non-null value leaves the column unchanged (decided by one aggregate over
    all override columns, a bounded result)."""
    drop = {o["column"] for o in overrides if not o.get("include", True)}
    keep = [o for o in overrides if o.get("include", True) and o["column"] in df.columns]
    fails = {r["column"]: r["failures"] for r in cast_failures(df, keep).collect()} if keep else {}
    exprs = []
    by_col = {o["column"]: TYPE_NAMES.get(o.get("type", "string"), o.get("type", "string")) for o in keep}
    for c in df.columns:
        if c in drop:
            continue
        t = by_col.get(c)
        if t is None:
            exprs.append(F.col(c))
        elif t in DATETIME_TARGETS:
            exprs.append(F.col(c).try_cast(t).alias(c))
        elif fails.get(c, 0) > 0:
            exprs.append(F.col(c))
        else:
            exprs.append(F.col(c).try_cast(t).alias(c))
    return df.select(*exprs)


def integrity_columns(df: DataFrame, cols=None) -> DataFrame:
    """B13 (per column): null count and rate, exact distinct count, single
    value flag, blank strings and the share of string values that parse as
    numbers (mixed types)."""
    cols = list(cols or df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    strs = [c for c in cols if isinstance(types[c], T.StringType)]
    nc = null_counts(df, cols)
    dc = distinct_counts(df, cols)
    out = nc.join(dc, "column")
    if strs:
        agg = df.agg(*[F.count_if(F.trim(F.col(c)) == "").alias(f"b_{c}") for c in strs],
                     *[F.count_if(F.col(c).try_cast("double").isNotNull()).alias(f"n_{c}") for c in strs])
        arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("blank_count"),
                                 F.col(f"n_{c}").alias("numeric_like")) for c in strs])
        extra = agg.select(F.inline(arr))
        out = out.join(extra, "column", "left")
    else:
        out = out.withColumns({"blank_count": F.lit(None).cast("long"), "numeric_like": F.lit(None).cast("long")})
    nonnull = F.col("rows") - F.col("nulls")
    return out.select(
        "column", F.col("rows").cast("long"), F.col("nulls").cast("long").alias("null_count"),
        (F.col("nulls") / F.col("rows")).alias("null_rate"),
        F.col("distinct_count").cast("long"), (F.col("distinct_count") <= 1).alias("single_value"),
        F.col("blank_count").cast("long"),
        F.when(nonnull > 0, F.col("numeric_like") / nonnull).alias("mixed_numeric_share"))


def integrity_table(df: DataFrame, label: str | None = None) -> DataFrame:
    """B13 (table level): rows, duplicate rows, and -- with a label -- the
    number of feature combinations seen with more than one label."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    dup = groups.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    if label:
        feats = [c for c in df.columns if c != label]
        conf = (df.groupBy(*feats).agg(F.count_distinct(label).alias("_k"))
                .agg(F.count_if(F.col("_k") > 1).alias("label_conflicts")))
    else:
        conf = df.sparkSession.range(1).select(F.lit(None).cast("long").alias("label_conflicts"))
    k = F.lit(0)
    return (dup.withColumn("_k", k).join(conf.withColumn("_k", k), "_k").drop("_k")
            .select(F.col("rows").cast("long"), F.col("duplicate_rows").cast("long"),
                    F.col("label_conflicts").cast("long")))


def histogram(ref: DataFrame, cur: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram on shared min/max for both sides:
    (side, bin, lower, upper, count)."""
    both = (ref.select(F.lit("reference").alias("side"), F.col(col).cast("double").alias("v"))
            .unionByName(cur.select(F.lit("current").alias("side"), F.col(col).cast("double").alias("v")))
            .where(F.col("v").isNotNull() & ~F.isnan("v")))
    mm = both.agg(F.min("v").alias("mn"), F.max("v").alias("mx")).first()  # two scalars
    if mm["mn"] is None:
        return both.sparkSession.createDataFrame(
            [], "side string, bin int, lower double, upper double, count long")
    mn, mx = float(mm["mn"]), float(mm["mx"])
    width = (mx - mn) / bins
    if mx == mn:
        b = F.lit(0)
    else:
        b = F.least(F.floor((F.col("v") - F.lit(mn)) / F.lit(mx - mn) * F.lit(bins)).cast("int"),
                    F.lit(bins - 1))
    h = both.groupBy("side", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("side", "bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("lower"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), "count")


def drop_null_rows(df: DataFrame, subset=None) -> DataFrame:
    """B15."""
    return df.dropna("any", subset=subset)


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """One wide count aggregate decides which columns to keep."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if row[c] > 0])
