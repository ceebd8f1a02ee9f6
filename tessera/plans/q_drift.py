"""Drift queries (C01-C07) on the driver tables.

Reference side = ``events`` before 2024-01-16, current = from that day;
``lineitem`` before / from 1998-07-01 (``l_linestatus`` has two categories:
the Yates case).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import drift as D
from tessera.plans.registry import register
from tessera.session import table

EV_CUT = "2024-01-16"
LI_CUT = "1998-07-01"


def events_sides(spark, sf):
    ev = table(spark, sf, "events")
    ref = ev.where(F.col("ts") < F.lit(EV_CUT).cast("timestamp_ntz"))
    cur = ev.where(F.col("ts") >= F.lit(EV_CUT).cast("timestamp_ntz"))
    return ref, cur


def lineitem_sides(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_shipdate", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    ref = li.where(F.col("l_shipdate") < F.lit(LI_CUT).cast("timestamp_ntz")).drop("l_shipdate")
    cur = li.where(F.col("l_shipdate") >= F.lit(LI_CUT).cast("timestamp_ntz")).drop("l_shipdate")
    return ref, cur


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def _stats_out(df):
    return df.select("column", "feature_type", "test", _r6("statistic"), _r6("reference_mean"),
                     _r6("current_mean"), F.col("categories_compared").cast("long"),
                     F.col("n_ref").cast("long"), F.col("n_cur").cast("long"))


_KS_SQL = """
WITH s AS (
  {long}
), c AS (
  SELECT col, v, count(*) FILTER (WHERE side = 0) AS n1, count(*) FILTER (WHERE side = 1) AS n2
  FROM s WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY col, v
), cum AS (
  SELECT col, v, n1, n2,
         sum(n1) OVER (PARTITION BY col ORDER BY v) AS c1, sum(n2) OVER (PARTITION BY col ORDER BY v) AS c2,
         sum(n1) OVER (PARTITION BY col) AS t1, sum(n2) OVER (PARTITION BY col) AS t2
  FROM c
)
SELECT col AS "column", 'numeric' AS feature_type, 'ks_2samp' AS test,
       round(max(abs(c1 / t1 - c2 / t2)), 6) AS statistic,
       round(sum(v * n1) / sum(n1), 6) AS reference_mean,
       round(sum(v * n2) / sum(n2), 6) AS current_mean,
       CAST(NULL AS BIGINT) AS categories_compared,
       CAST(max(t1) AS BIGINT) AS n_ref, CAST(max(t2) AS BIGINT) AS n_cur
FROM cum GROUP BY col
"""

_CHI_SQL = """
WITH s AS (
  {long}
), c AS (
  SELECT col, coalesce(v, '__nan__') AS cat, count(*) FILTER (WHERE side = 0) AS o1,
         count(*) FILTER (WHERE side = 1) AS o2
  FROM s GROUP BY col, coalesce(v, '__nan__')
), t AS (
  SELECT col, sum(o1) AS r1, sum(o2) AS r2, count(*) AS k FROM c GROUP BY col
), e AS (
  SELECT c.col, t.k, t.r1, t.r2, o1, o2,
         t.r1 * (o1 + o2) / (t.r1 + t.r2) AS e1, t.r2 * (o1 + o2) / (t.r1 + t.r2) AS e2
  FROM c JOIN t USING (col)
), y AS (
  SELECT col, k, r1, r2, e1, e2,
         CASE WHEN k = 2 THEN o1 + sign(e1 - o1) * least(0.5, abs(e1 - o1)) ELSE o1 END AS a1,
         CASE WHEN k = 2 THEN o2 + sign(e2 - o2) * least(0.5, abs(e2 - o2)) ELSE o2 END AS a2
  FROM e
)
SELECT col AS "column", 'categorical' AS feature_type, 'chi2_contingency' AS test,
       round(CASE WHEN max(r1) = 0 OR max(r2) = 0 OR max(k) < 2 THEN 0.0
                  ELSE sum((a1 - e1) * (a1 - e1) / e1 + (a2 - e2) * (a2 - e2) / e2) END, 6) AS statistic,
       CAST(NULL AS DOUBLE) AS reference_mean, CAST(NULL AS DOUBLE) AS current_mean,
       CAST(max(k) AS BIGINT) AS categories_compared,
       CAST(max(r1) AS BIGINT) AS n_ref, CAST(max(r2) AS BIGINT) AS n_cur
FROM y GROUP BY col
"""

_EV_SIDE = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END"
_LI_SIDE = "CASE WHEN l_shipdate < TIMESTAMP '1998-07-01' THEN 0 ELSE 1 END"


def _long_sql(tbl, side, cols, typ):
    return "\n  UNION ALL ".join(
        f"SELECT '{c}' AS col, {side} AS side, CAST({c} AS {typ}) AS v FROM {tbl}" for c in cols)


EV_NUM = ["event_id", "user_id", "value"]
EV_CAT = ["event_type", "props"]
LI_NUM = ["l_quantity", "l_extendedprice"]
LI_CAT = ["l_returnflag", "l_linestatus"]

_C01_SQL = (
    "SELECT * FROM (" + _KS_SQL.format(long=_long_sql("events", _EV_SIDE, ["user_id", "value"], "DOUBLE"))
    + ") UNION ALL SELECT * FROM ("
    + _CHI_SQL.format(long=_long_sql("events", _EV_SIDE, ["event_type"], "VARCHAR")) + ")")


@register("C01_drift_statistics", _C01_SQL)
def c01(spark, sf):
    ref, cur = events_sides(spark, sf)
    cols = ["user_id", "value", "event_type"]
    return _stats_out(D.drift_statistics(ref.select(*cols), cur.select(*cols)))


@register("C02_ks_statistic", _KS_SQL.format(long=_long_sql("lineitem", _LI_SIDE, LI_NUM, "DOUBLE")))
def c02(spark, sf):
    ref, cur = lineitem_sides(spark, sf)
    return _stats_out(D.drift_statistics(ref.select(*LI_NUM), cur.select(*LI_NUM)))


@register("C03_drift_report")
def c03(spark, sf):
    """Full report with p-values (exact KS below 10 000 rows a side, chi-square
    survival) -- p-values are checked by closed-form tests, not SQL."""
    ref, cur = events_sides(spark, sf)
    cols = ["value", "event_type"]
    return D.drift(ref.select(*cols), cur.select(*cols))


@register("C04_side_means", """
SELECT 'value' AS "column",
       round(avg(value) FILTER (WHERE ts < TIMESTAMP '2024-01-16'), 6) AS reference_mean,
       round(avg(value) FILTER (WHERE ts >= TIMESTAMP '2024-01-16'), 6) AS current_mean
FROM events""")
def c04(spark, sf):
    ref, cur = events_sides(spark, sf)
    ks = D.ks_statistics(ref.select("value"), cur.select("value"), ["value"])
    return ks.select("column", _r6("reference_mean"), _r6("current_mean"))


@register("C05_category_counts", """
SELECT col AS "column", coalesce(v, '__nan__') AS category,
       CAST(count(*) FILTER (WHERE side = 0) AS BIGINT) AS n_ref,
       CAST(count(*) FILTER (WHERE side = 1) AS BIGINT) AS n_cur
FROM (""" + _long_sql("lineitem", _LI_SIDE, LI_CAT, "VARCHAR") + """) s
GROUP BY col, coalesce(v, '__nan__')""")
def c05(spark, sf):
    ref, cur = lineitem_sides(spark, sf)
    cc = D.category_counts(ref.select(*LI_CAT), cur.select(*LI_CAT), LI_CAT)
    return cc.select("column", "category", F.col("n_ref").cast("long"), F.col("n_cur").cast("long"))


@register("C06_chi2_statistic", _CHI_SQL.format(long=_long_sql("lineitem", _LI_SIDE, LI_CAT, "VARCHAR")))
def c06(spark, sf):
    ref, cur = lineitem_sides(spark, sf)
    return _stats_out(D.drift_statistics(ref.select(*LI_CAT), cur.select(*LI_CAT)))


@register("C07_drift_flags")
def c07(spark, sf):
    """Forced shift (value * 1.5) must be flagged; summary row."""
    ref, cur = events_sides(spark, sf)
    cur = cur.withColumn("value", F.col("value") * 1.5)
    rep = D.drift(ref.select("value", "event_type"), cur.select("value", "event_type"))
    return D.drift_summary(rep)
