"""Profiling and preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.registry import register
from tessera.session import table


def _r6(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


def orders_with_nulls(spark, sf):
    """Nulls by rule (the driver tables have none)."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


_NULLS_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


@register("B01_apply_schema", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, o_orderdate, o_orderpriority,
       TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE CAST(o_orderdate AS VARCHAR) END AS TIMESTAMP) AS raw_date
FROM orders""")
def b01(spark, sf):
    o = table(spark, sf, "orders")
    o = o.withColumn("raw_date", F.when(F.col("o_orderkey") % 7 == 0, F.lit("bad"))
                     .otherwise(F.col("o_orderdate").cast("string")))
    overrides = [
        {"column": "o_orderstatus", "include": False},
        {"column": "o_custkey", "type": "float64"},
        {"column": "o_orderpriority", "type": "int64"},      # fails -> unchanged
        {"column": "raw_date", "type": "datetime64[ns]"},   # bad -> null
    ]
    return P.apply_schema(o, overrides)


@register("B02_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def b02(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderkey").limit(20)


@register("B03_kind_counts", """
SELECT CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric'
            WHEN data_type LIKE 'TIMESTAMP%' THEN 'datetime' WHEN data_type = 'VARCHAR' THEN 'categorical'
            ELSE 'other' END AS kind, CAST(count(*) AS BIGINT) AS columns
FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def b03(spark, sf):
    return P.kind_counts(table(spark, sf, "lineitem")).select("kind", F.col("columns").cast("long"))


def _unpivot_sql(cols, expr_fmt, src):
    return "\nUNION ALL ".join(f"SELECT '{c}' AS \"column\", {expr_fmt.format(c=c)} FROM {src}" for c in cols)


_B04_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("B04_missing_report", "SELECT * FROM (" + _unpivot_sql(
    _B04_COLS, "round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 6) AS missing_pct",
    _NULLS_SQL + " t") + ") WHERE missing_pct > 0")
def b04(spark, sf):
    return P.missing_report(orders_with_nulls(spark, sf)).select("column", _r6("missing_pct"))


@register("B05_schema_table")
def b05(spark, sf):
    return P.schema_table(table(spark, sf, "orders"), "o_orderkey")


def _const_frame(spark, sf):
    return orders_with_nulls(spark, sf).withColumns(
        {"const_col": F.lit("x"), "null_col": F.lit(None).cast("double")})


_B06_COLS = _B04_COLS + ["const_col", "null_col"]
_B06_SRC = "(SELECT *, 'x' AS const_col, CAST(NULL AS DOUBLE) AS null_col FROM " + _NULLS_SQL + " t0) t"


@register("B06_constant_columns", _unpivot_sql(
    _B06_COLS, "(min({c}) IS NULL OR min({c}) = max({c})) AS is_constant", _B06_SRC))
def b06(spark, sf):
    return P.constant_columns(_const_frame(spark, sf))


_B07_COLS = ["p_name", "p_brand", "p_type", "p_size"]


@register("B07_cardinality_split", _unpivot_sql(
    _B07_COLS, "CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, "
               "CASE WHEN count(DISTINCT {c}) <= 15 THEN 'low' ELSE 'high' END AS cardinality", "part"))
def b07(spark, sf):
    return P.cardinality_split(table(spark, sf, "part"), _B07_COLS).select(
        "column", F.col("distinct_count").cast("long"), "cardinality")


@register("B08_distinct_values", "SELECT DISTINCT l_returnflag FROM lineitem")
def b08(spark, sf):
    return P.distinct_values(table(spark, sf, "lineitem"), "l_returnflag")


@register("B09_member_filter", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def b09(spark, sf):
    return P.filter_members(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register("B10_time_cutoff", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""")
def b10(spark, sf):
    from tessera.sources.telemetry import recent
    return recent(table(spark, sf, "events"), "ts", days=7, as_of="2024-01-31")


@register("B11_feature_target", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def b11(spark, sf):
    feats, _ = P.split_features(table(spark, sf, "orders"), "o_totalprice", date_col="o_orderdate")
    return feats


@register("B12_shared_numeric", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-07-01'""")
def b12(spark, sf):
    li = table(spark, sf, "lineitem")
    base = li.where(F.col("l_shipdate") < F.lit("1998-07-01").cast("timestamp_ntz"))
    cur = li.where(F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).withColumn(
        "__source", F.lit("telemetry"))
    return cur.select(*P.shared_numeric_columns(base, cur))


def _integrity_frame(spark, sf):
    o = orders_with_nulls(spark, sf)
    k = F.col("o_orderkey")
    return o.withColumns({
        "padded": F.when(k % 11 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")),
        "mixed": F.when(k % 3 == 0, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderstatus")),
    })


_B13_SRC = ("(SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderstatus END AS padded, "
            "CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS mixed "
            "FROM " + _NULLS_SQL + " t0) t")
_B13_STR = ["o_orderstatus", "o_orderpriority", "padded", "mixed"]
_B13_OTHER = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]


def _b13_sql():
    parts = []
    for c in _B13_OTHER + _B13_STR:
        is_str = c in _B13_STR
        blank = f"CAST(count(*) FILTER (WHERE trim({c}) = '') AS BIGINT)" if is_str else "CAST(NULL AS BIGINT)"
        mixed = (f"CASE WHEN count({c}) > 0 THEN round(count(TRY_CAST({c} AS DOUBLE)) / count({c}), 6) END"
                 if is_str else "CAST(NULL AS DOUBLE)")
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS rows, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, "
            f"round((count(*) - count({c})) / count(*), 6) AS null_rate, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS distinct_count, count(DISTINCT {c}) <= 1 AS single_value, "
            f"{blank} AS blank_count, {mixed} AS mixed_numeric_share FROM {_B13_SRC}")
    return "\nUNION ALL ".join(parts)


@register("B13_integrity_columns", _b13_sql())
def b13(spark, sf):
    r = P.integrity_columns(_integrity_frame(spark, sf))
    return r.select("column", "rows", "null_count", _r6("null_rate"), "distinct_count", "single_value",
                    "blank_count", _r6("mixed_numeric_share"))


@register("B13_integrity_table", """
WITH g AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT l_linestatus, l_quantity, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY ALL)
SELECT CAST((SELECT sum(n) FROM g) AS BIGINT) AS rows, CAST((SELECT sum(n - 1) FROM g) AS BIGINT) AS duplicate_rows,
       CAST((SELECT count(*) FILTER (WHERE k > 1) FROM c) AS BIGINT) AS label_conflicts""")
def b13t(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return P.integrity_table(li, label="l_returnflag")


@register("B14_histogram", """
WITH s AS (
  SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'reference' ELSE 'current' END AS side, value AS v
  FROM events WHERE value IS NOT NULL AND NOT isnan(value)
), m AS (SELECT min(v) AS mn, max(v) AS mx FROM s)
SELECT side, CAST(least(floor((v - mn) / (mx - mn) * 30), 29) AS INTEGER) AS bin,
       round(min(mn + least(floor((v - mn) / (mx - mn) * 30), 29) * ((mx - mn) / 30)), 6) AS lower,
       round(min(mn + (least(floor((v - mn) / (mx - mn) * 30), 29) + 1) * ((mx - mn) / 30)), 6) AS upper,
       CAST(count(*) AS BIGINT) AS count
FROM s, m GROUP BY 1, 2""")
def b14(spark, sf):
    from tessera.plans.q_drift import events_sides
    ref, cur = events_sides(spark, sf)
    h = P.histogram(ref, cur, "value", bins=30)
    return h.select("side", F.col("bin").cast("int"), _r6("lower"), _r6("upper"), F.col("count").cast("long"))


@register("B15_drop_null_rows", "SELECT * FROM " + _NULLS_SQL + " t WHERE o_totalprice IS NOT NULL "
          "AND o_orderpriority IS NOT NULL")
def b15(spark, sf):
    return P.drop_null_rows(orders_with_nulls(spark, sf))


@register("B16_drop_all_null_columns", "SELECT *, 'x' AS const_col FROM " + _NULLS_SQL + " t")
def b16(spark, sf):
    return P.drop_all_null_columns(_const_frame(spark, sf))
