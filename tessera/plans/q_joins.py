"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.plans.registry import register
from tessera.session import table


@register("E01_union_by_name", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS mktsegment,
       'customer' AS kind FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL, 'supplier' FROM supplier""")
def e01(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
        F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"), F.lit("customer").alias("kind"))
    s = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"),
        F.col("s_acctbal").alias("acctbal"), F.lit("supplier").alias("kind"))
    return J.union_by_name([c, s])


@register("E02_complement", "SELECT d.* FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def e02(spark, sf):
    return J.complement(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@register("E03_lookup", """
SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""")
def e03(spark, sf):
    return J.lookup(table(spark, sf, "nation"), table(spark, sf, "region"), "n_regionkey", "r_regionkey").select(
        "n_nationkey", "n_name", "n_regionkey", "r_name")


@register("E05_align_semi", """
SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
def e05(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return J.align(d, table(spark, sf, "labels"), "doc_id")


@register("E09_attach_truth", """
SELECT l.doc_id, l.quality, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction
FROM labels l JOIN documents d USING (doc_id)""")
def e09(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("prediction"))
    return J.attach_truth(d, table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        "doc_id", "quality", "prediction")
