"""Association-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.registry import register
from tessera.session import table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def user_day_baskets(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("basket"),
                     F.col("event_type").alias("item"))


def order_brand_baskets(spark, sf):
    """Basket = order; items = part brands on its lines."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    pa = table(spark, sf, "part").select("p_partkey", "p_brand")
    return li.join(pa, li.l_partkey == pa.p_partkey).select(
        F.col("l_orderkey").cast("string").alias("basket"), F.col("p_brand").alias("item"))


_UD = """SELECT DISTINCT CAST(user_id AS VARCHAR) || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS basket,
                event_type AS item FROM events"""
_OB = """SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS basket, p_brand AS item
         FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _rules_sql(src, min_support, min_conf, min_lift, max_rules):
    return f"""
WITH b AS ({src}), n AS (SELECT count(DISTINCT basket) AS n FROM b),
s AS (SELECT item, count(*) / max(n.n) AS s FROM b, n GROUP BY item),
p AS (SELECT x.item AS antecedent, y.item AS consequent, count(*) AS n_ab
      FROM b x JOIN b y ON x.basket = y.basket AND x.item <> y.item GROUP BY 1, 2),
r AS (SELECT antecedent, consequent, n_ab / n.n AS support,
             (n_ab / n.n) / greatest(sa.s, 1e-12) AS confidence,
             ((n_ab / n.n) / greatest(sa.s, 1e-12)) / greatest(sb.s, 1e-12) AS lift
      FROM p, n, s sa, s sb WHERE sa.item = antecedent AND sb.item = consequent)
SELECT antecedent, consequent, round(support, 6) AS support, round(confidence, 6) AS confidence,
       round(lift, 6) AS lift FROM r
WHERE support >= {min_support} AND confidence >= {min_conf} AND lift >= {min_lift}
ORDER BY lift DESC, confidence DESC, support DESC, antecedent, consequent LIMIT {max_rules}"""


@register("F01_binarize", """
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey,
       CASE WHEN coalesce(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice - 150000 END, 0) > 0 THEN 1 ELSE 0 END AS high_value,
       CASE WHEN coalesce(CAST(o_custkey % 3 AS DOUBLE) - 1, 0) > 0 THEN 1 ELSE 0 END AS cust_mod
FROM orders""")
def f01(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    w = o.select("o_orderkey",
                 F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice") - 150000).alias("high_value"),
                 ((F.col("o_custkey") % 3).cast("double") - 1).alias("cust_mod"))
    return R.binarize_columns(w, ["high_value", "cust_mod"])


@register("F02_pair_rules", _rules_sql(_OB, 0.0005, 0.01, 1.0, 1000000))
def f02(spark, sf):
    r = R.pair_rules(order_brand_baskets(spark, sf), min_support=0.0005, min_confidence=0.01, min_lift=1.0,
                     max_rules=None)
    return r.select("antecedent", "consequent", _r6("support"), _r6("confidence"), _r6("lift"))


@register("F03_top_rules", _rules_sql(_OB, 0.0005, 0.05, 1.0, 200))
def f03(spark, sf):
    r = R.pair_rules(order_brand_baskets(spark, sf), min_support=0.0005, min_confidence=0.05, min_lift=1.0,
                     max_rules=200)
    return r.select("antecedent", "consequent", _r6("support"), _r6("confidence"), _r6("lift"))


@register("F04_rule_summary", """
WITH r AS (""" + _rules_sql(_UD, 0.05, 0.2, 0.0, 200).replace("round(support, 6) AS support", "support")
          .replace("round(confidence, 6) AS confidence", "confidence").replace("round(lift, 6) AS lift", "lift") + """)
SELECT CAST(count(*) AS BIGINT) AS rule_count, round(coalesce(avg(confidence), 0), 6) AS avg_confidence,
       round(coalesce(avg(lift), 0), 6) AS avg_lift,
       round(coalesce(avg(confidence), 0) * coalesce(avg(lift), 0) * ln(1 + count(*)), 6) AS rule_score FROM r""")
def f04(spark, sf):
    r = R.pair_rules(user_day_baskets(spark, sf), min_support=0.05, min_confidence=0.2, min_lift=0.0,
                     max_rules=200)
    s = R.rule_summary(r)
    return s.select(F.col("rule_count").cast("long"), _r6("avg_confidence"), _r6("avg_lift"), _r6("rule_score"))


_SETS_SQL = f"""
WITH RECURSIVE b AS ({_OB}), n AS (SELECT count(DISTINCT basket) AS n FROM b),
s AS (SELECT basket, item AS itemset, item AS last FROM b
      UNION ALL SELECT s.basket, s.itemset || ',' || b.item, b.item FROM s JOIN b ON s.basket = b.basket AND b.item > s.last),
f AS (SELECT itemset, count(*) AS freq FROM s GROUP BY itemset HAVING count(*) >= 0.0005 * (SELECT n FROM n) - 1e-9)
"""


@register("F05_fpgrowth_itemsets", _SETS_SQL + "SELECT itemset, CAST(freq AS BIGINT) AS freq FROM f")
def f05(spark, sf):
    """Itemsets of any length; its pair rules must equal F02's (tested)."""
    items = R.itemsets(order_brand_baskets(spark, sf), min_support=0.0005)
    return items.select(F.array_join("items", ",").alias("itemset"), F.col("freq").cast("long"))


@register("F05_itemset_rules", _SETS_SQL + """
, r AS (SELECT string_split(itemset, ',') AS items, freq FROM f),
x AS (SELECT items, freq, unnest(items) AS c FROM r WHERE len(items) > 1)
SELECT array_to_string(list_filter(x.items, lambda i: i <> x.c), ',') AS antecedent, x.c AS consequent,
       round(x.freq / a.freq, 6) AS confidence, round((x.freq / a.freq) / (k.freq / n.n), 6) AS lift
FROM x JOIN f a ON a.itemset = array_to_string(list_filter(x.items, lambda i: i <> x.c), ',') JOIN f k ON k.itemset = x.c, n
WHERE x.freq / a.freq >= 0.1""")
def f05_rules(spark, sf):
    _, rules = R.itemset_rules(order_brand_baskets(spark, sf), min_support=0.0005, min_confidence=0.1)
    return rules.select(F.array_join("antecedent", ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"), _r6("confidence"), _r6("lift"))


@register("E06_cooccurrence", """
WITH b AS (""" + _OB + """)
SELECT x.item AS a, y.item AS b, CAST(count(*) AS BIGINT) AS n_ab
FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2""")
def e06(spark, sf):
    return R.pair_counts(order_brand_baskets(spark, sf)).select("a", "b", F.col("n_ab").cast("long"))
