"""Aggregation, order statistics and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.plans.registry import register
from tessera.session import table


def _r6(c, name=None):
    return F.round(F.col(c), 6).alias(name or c)


@register("D01_value_counts", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def d01(spark, sf):
    return A.value_counts(table(spark, sf, "lineitem"), "l_returnflag")


@register("D02_class_balance", """
WITH c AS (SELECT quality, count(*) AS class_count FROM labels GROUP BY 1)
SELECT quality, CAST(class_count AS BIGINT) AS class_count,
       CAST((SELECT min(class_count) FROM c) AS BIGINT) AS min_class_count,
       CAST((SELECT count(*) FROM c) AS BIGINT) AS n_classes,
       (SELECT min(class_count) FROM c) > 1 AS can_stratify
FROM c""")
def d02(spark, sf):
    return A.class_balance(table(spark, sf, "labels"), "quality")


@register("D03_study_summary", """
SELECT event_type AS metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range,
       round(CASE WHEN avg(value) = 0 THEN 0 ELSE stddev_samp(value) / avg(value) END, 6) AS cv,
       round(1.0 / (1.0 + stddev_samp(value)), 6) AS stability_score
FROM (SELECT event_id % 10 AS iteration, event_type, value FROM events) s GROUP BY event_type""")
def d03(spark, sf):
    ev = table(spark, sf, "events")
    study = ev.select((F.col("event_id") % 10).alias("iteration"), F.col("event_type").alias("metric"), "value")
    s = A.summarize(study)
    return s.select("metric", *[_r6(c) for c in ["mean", "std", "min", "max", "range", "cv", "stability_score"]])


@register("D04_column_stats", """
SELECT round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS median,
       round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.75), 6) AS q75,
       (SELECT l_quantity FROM lineitem GROUP BY l_quantity ORDER BY count(*) DESC, l_quantity LIMIT 1) AS mode
FROM lineitem""")
def d04(spark, sf):
    s = A.column_stats(table(spark, sf, "lineitem"), "l_quantity")
    return s.select(_r6("mean"), _r6("median"), _r6("q25"), _r6("q75"), "mode")


@register("D04_grouped_quantiles", "\nUNION ALL ".join(
    f"SELECT l_returnflag, {p} AS p, round(quantile_cont(l_extendedprice, {p}), 6) AS value FROM lineitem "
    "GROUP BY l_returnflag" for p in ("0.1", "0.5", "0.9")))
def d04g(spark, sf):
    q = A.exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"])
    return q.select("l_returnflag", F.round("p", 6).alias("p"), _r6("value"))


def user_day_baskets(spark, sf):
    """Basket = (user, day); items = event types seen."""
    ev = table(spark, sf, "events")
    return ev.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("basket"),
                     F.col("event_type").alias("item"))


@register("D05_support", """
WITH b AS (SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS basket,
                  event_type AS item FROM events),
n AS (SELECT count(DISTINCT basket) AS n FROM b)
SELECT item, round(count(*) / max(n.n), 6) AS support FROM b, n GROUP BY item""")
def d05(spark, sf):
    """From the long form: no column is made for an item."""
    from tessera.operators.rules import item_supports
    b = user_day_baskets(spark, sf).where("item is not null").distinct()
    return item_supports(b, b.select("basket").distinct().count()).select("item", _r6("support"))


@register("D06_top_k", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def d06(spark, sf):
    return A.top_k(table(spark, sf, "orders"), 20, [F.col("o_totalprice").desc()], ["o_orderkey"])


@register("D07_sort", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey")
def d07(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(
        "o_orderdate", "o_orderkey")


def lineitem_row_id():
    """Unique row key of ``lineitem`` (order, line, part and supplier keys):
    (l_orderkey, l_linenumber) alone repeats in the driver tables."""
    return F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


def rule_predictions(spark, sf):
    """Prediction table by rule, no training: label = l_returnflag,
    prediction from l_quantity."""
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    pred = F.when(q < 17, F.lit("A")).when(q < 34, F.lit("N")).otherwise(F.lit("R"))
    return li.withColumn("prediction", pred)


@register("D08_confusion_matrix", """
SELECT l_returnflag AS label, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction,
       CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2""")
def d08(spark, sf):
    return A.confusion_matrix(rule_predictions(spark, sf), "l_returnflag", "prediction")
