"""Sampling and splitting queries (G01-G13).  The md5 draw is the same text
in Spark and SQL, so the oracle selects exactly the same rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessera.functions.hashing import hex_threshold
from tessera.operators import split as S
from tessera.plans.registry import register
from tessera.session import table


def _h(col, seed=42, salt="split"):
    return f"substr(md5(concat_ws(':', CAST({col} AS VARCHAR), '{seed}', '{salt}')), 1, 15)"


@register("G01_random_split", f"""
SELECT doc_id, {_h('doc_id')} < '{hex_threshold(0.8)}' AS is_train FROM labels""")
def g01(spark, sf):
    return S.random_split(table(spark, sf, "labels"), "doc_id", 0.8, seed=42).select("doc_id", "is_train")


@register("G01_exact_split", f"""
SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id')}, doc_id) <= floor(count(*) OVER () * 0.8 + 0.5) AS is_train
FROM labels""")
def g01e(spark, sf):
    return S.exact_split(table(spark, sf, "labels"), "doc_id", 0.8, seed=42).select("doc_id", "is_train")


@register("G02_stratified_split", f"""
SELECT doc_id, quality,
       row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id)
         <= floor(count(*) OVER (PARTITION BY quality) * 0.8 + 0.5) AS is_train
FROM labels""")
def g02(spark, sf):
    return S.stratified_split(table(spark, sf, "labels"), "doc_id", "quality", 0.8, seed=42).select(
        "doc_id", "quality", "is_train")


@register("G03_chronological_split", """
SELECT o_orderkey, o_orderdate,
       row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(count(*) OVER () * 0.7) AS is_train
FROM orders""")
def g03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return S.chronological_split(o, "o_orderdate", "o_orderkey", 0.7).select("o_orderkey", "o_orderdate", "is_train")


@register("G04_manual_split", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       lower(CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'Train' END) IN ('train', '1', 'true', 'tr') AS is_train
FROM orders""")
def g04(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "split_flag", F.when(F.col("o_orderkey") % 4 == 0, F.lit("test")).otherwise(F.lit("Train")))
    return S.manual_split(o, "split_flag")


@register("G06_prepare_multi", f"""
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(NULL AS BIGINT) AS s_suppkey,
       CAST(NULL AS VARCHAR) AS s_name, CAST(NULL AS INTEGER) AS s_nationkey, CAST(NULL AS DOUBLE) AS s_acctbal,
       CASE WHEN {_h('c_custkey')} < '{hex_threshold(0.7)}' THEN 'train' ELSE 'test' END AS side
FROM customer
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, s_suppkey, s_name, s_nationkey, s_acctbal, 'train' FROM supplier""")
def g06(spark, sf):
    cfg = [
        {"df": table(spark, sf, "customer"), "split": 70, "strategy": "random", "id_col": "c_custkey"},
        {"df": table(spark, sf, "supplier"), "split": 100, "strategy": "random", "id_col": "s_suppkey"},
    ]
    tr, te = S.prepare(cfg, seed=42)
    return tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))


def _fold_sql(rank0, n, k):
    q = f"({n} // {k})"
    big = f"({n} - {q} * {k})"
    edge = f"({big} * ({q} + 1))"
    return (f"CAST(CASE WHEN {rank0} < {edge} THEN {rank0} // ({q} + 1) "
            f"ELSE {big} + ({rank0} - {edge}) // {q} END AS INTEGER)")


@register("G07_kfold", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_h('doc_id', salt='kfold')}, doc_id) - 1 AS r0,
                  count(*) OVER () AS n FROM labels)
SELECT doc_id, {_fold_sql('r0', 'n', 5)} AS fold FROM r""")
def g07(spark, sf):
    return S.kfold(table(spark, sf, "labels"), 5, "doc_id", shuffle=True, seed=42).select("doc_id", "fold")


@register("G07_kfold_contiguous", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r0,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, {_fold_sql('r0', 'n', 4)} AS fold FROM r""")
def g07c(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return S.kfold(o, 4, "o_orderkey", shuffle=False, order_col="o_orderdate").select("o_orderkey", "fold")


@register("G08_stratified_kfold", f"""
SELECT doc_id, quality,
       CAST((row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id', salt='skfold')}, doc_id) - 1) % 5 AS INTEGER) AS fold
FROM labels""")
def g08(spark, sf):
    return S.stratified_kfold(table(spark, sf, "labels"), 5, "doc_id", "quality", seed=42).select(
        "doc_id", "quality", "fold")


@register("G09_time_series_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r0,
                  count(*) OVER () AS n FROM orders),
f AS (SELECT r.*, fold, n // 4 AS m FROM r, (SELECT unnest(range(0, 3)) AS fold) fs),
g AS (SELECT o_orderkey, CAST(fold AS INTEGER) AS fold,
             CASE WHEN r0 >= n - (3 - fold) * m AND r0 < n - (3 - fold) * m + m THEN 'test'
                  WHEN r0 < n - (3 - fold) * m - 2 THEN 'train' END AS role FROM f)
SELECT * FROM g WHERE role IS NOT NULL""")
def g09(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    t = S.time_series_folds(o, 3, "o_orderdate", "o_orderkey", gap=2)
    return t.select("o_orderkey", F.col("fold").cast("int"), "role")


@register("G10_monte_carlo", f"""
SELECT doc_id, CAST(i AS INTEGER) AS iteration,
       substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), CAST(42 + i AS VARCHAR), 'split')), 1, 15) < '{hex_threshold(0.8)}' AS is_train
FROM labels, (SELECT unnest(range(0, 5)) AS i) its""")
def g10(spark, sf):
    return S.monte_carlo_splits(table(spark, sf, "labels"), "doc_id", 5, 0.8, seed=42).select(
        "doc_id", F.col("iteration").cast("int"), "is_train")


@register("G12_hash_sample", f"""
SELECT * FROM orders ORDER BY {_h('o_orderkey', salt='sample')}, o_orderkey LIMIT 100""")
def g12(spark, sf):
    return S.hash_sample(table(spark, sf, "orders"), "o_orderkey", 100, seed=42)


def _poisson_case(u, lam=1.0, max_k=20):
    cdf, p, parts = 0.0, math.exp(-lam), []
    for k in range(max_k):
        cdf += p
        parts.append(f"WHEN {u} < CAST('{cdf!r}' AS DOUBLE) THEN {k}")
        p *= lam / (k + 1)
    return "CASE " + " ".join(parts) + f" ELSE {max_k} END"


@register("G13_bootstrap_weights", f"""
SELECT doc_id, CAST({_poisson_case("CAST('0x' || " + _h('doc_id', salt='boot') + " AS BIGINT) / 1152921504606846976.0")} AS INTEGER) AS weight
FROM labels""")
def g13(spark, sf):
    return S.poisson_weights(table(spark, sf, "labels"), "doc_id", 1.0, seed=42).select("doc_id", "weight")
