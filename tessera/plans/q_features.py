"""Feature-pipeline queries (H01-H12) on ``part`` with nulls by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.hashing import hash_below, hash_hex, hex_threshold
from tessera.operators import features as FE
from tessera.operators.split import random_split
from tessera.plans.q_split import _h
from tessera.plans.q_text import grams_sql, tokens_sql
from tessera.plans.registry import register
from tessera.session import table


def _r6(c):
    return F.round(F.col(c), 6).alias(c)


def part_nulls(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", "p_name", "p_brand",
                    F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("p_type"),
                    F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("p_size"),
                    F.when(k % 5 == 0, F.lit(None)).otherwise(F.col("p_retailprice")).alias("p_retailprice"))


_PN = """(SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_type END AS p_type,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part)"""
_IMP = f"""t AS {_PN}, m AS (SELECT quantile_cont(p_size, 0.5) AS ms, quantile_cont(p_retailprice, 0.5) AS mr FROM t),
i AS (SELECT p_partkey, coalesce(CAST(p_size AS DOUBLE), ms) AS p_size, coalesce(p_retailprice, mr) AS p_retailprice
      FROM t, m)"""
_NUM = ["p_size", "p_retailprice"]


def imputed(spark, sf):
    d = part_nulls(spark, sf)
    return FE.impute(d, FE.fit_medians(d, _NUM)).select("p_partkey", *_NUM)


@register("H01_median_impute", f"WITH {_IMP} SELECT p_partkey, round(p_size, 6) AS p_size, "
          "round(p_retailprice, 6) AS p_retailprice FROM i")
def h01(spark, sf):
    return imputed(spark, sf).select("p_partkey", _r6("p_size"), _r6("p_retailprice"))


def _scaled_sql(center, spread):
    sel = ", ".join(f"round((i.{c} - s.c_{c}) / CASE WHEN s.s_{c} = 0 OR s.s_{c} IS NULL THEN 1 ELSE s.s_{c} END, 6) AS {c}"
                    for c in _NUM)
    stats = ", ".join(f"{center.format(c=c)} AS c_{c}, {spread.format(c=c)} AS s_{c}" for c in _NUM)
    return f"WITH {_IMP}, s AS (SELECT {stats} FROM i) SELECT i.p_partkey, {sel} FROM i, s"


def _scaled(spark, sf, kind):
    d = imputed(spark, sf)
    return FE.scale(d, FE.fit_scaler(d, _NUM, kind)).select("p_partkey", *[_r6(c) for c in _NUM])


@register("H02_standard_scale", _scaled_sql("avg({c})", "stddev_pop({c})"))
def h02(spark, sf):
    return _scaled(spark, sf, "standard")


@register("H03_minmax_scale", _scaled_sql("min({c})", "max({c}) - min({c})"))
def h03(spark, sf):
    return _scaled(spark, sf, "minmax")


@register("H04_robust_scale", _scaled_sql("quantile_cont({c}, 0.5)",
                                          "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def h04(spark, sf):
    return _scaled(spark, sf, "robust")


@register("H05_mode_impute", f"""
WITH t AS {_PN}, m AS (SELECT p_type AS mode FROM t WHERE p_type IS NOT NULL GROUP BY p_type
                       ORDER BY count(*) DESC, p_type LIMIT 1)
SELECT p_partkey, coalesce(p_type, m.mode) AS p_type FROM t, m""")
def h05(spark, sf):
    d = part_nulls(spark, sf)
    modes = FE.fit_modes(d, ["p_type"])
    return d.select("p_partkey", F.coalesce("p_type", F.lit(modes["p_type"])).alias("p_type"))


_TRAIN = f"{_h('p_partkey')} < '{hex_threshold(0.8)}'"


def _train(spark, sf):
    return random_split(part_nulls(spark, sf), "p_partkey", 0.8, seed=42)


@register("H06_one_hot", f"""
WITH t AS {_PN}, c AS (SELECT DISTINCT p_type FROM t WHERE {_TRAIN} AND p_type IS NOT NULL)
SELECT p_partkey, 'p_type_' || p_type AS feature FROM t WHERE p_type IN (SELECT p_type FROM c)""")
def h06(spark, sf):
    tr = _train(spark, sf)
    cats = sorted(r[0] for r in tr.where("is_train AND p_type IS NOT NULL").select("p_type").distinct().collect())
    oh = FE.one_hot(part_nulls(spark, sf), "p_type", cats)
    arr = F.array(*[F.when(F.col(f"p_type_{c}") == 1.0, F.lit(f"p_type_{c}")) for c in cats])
    return oh.select("p_partkey", F.explode(arr).alias("feature")).where(F.col("feature").isNotNull())


@register("H07_ordinal_encode", f"""
WITH t AS {_PN}, d AS (SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS idx
                       FROM (SELECT DISTINCT p_name FROM t WHERE {_TRAIN}))
SELECT p_partkey, CAST(coalesce(idx, -1) AS INTEGER) AS p_name_ord FROM t LEFT JOIN d USING (p_name)""")
def h07(spark, sf):
    tr = _train(spark, sf)
    dic = FE.category_dictionary(tr.where("is_train"), "p_name")
    enc = FE.ordinal_encode(part_nulls(spark, sf), "p_name", dic, out="p_name_ord")
    return enc.select("p_partkey", F.col("p_name_ord").cast("int"))


@register("H08_label_encode", """
WITH d AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS label
           FROM (SELECT DISTINCT p_brand FROM part))
SELECT p_partkey, p_brand, label FROM part JOIN d USING (p_brand)""")
def h08(spark, sf):
    p = table(spark, sf, "part")
    dic = FE.category_dictionary(p, "p_brand")
    enc = FE.label_encode(p, "p_brand", dic, "label")
    back = FE.label_decode(enc, "label", dic, "decoded")
    return back.where(F.col("decoded") == F.col("p_brand")).select("p_partkey", "p_brand", F.col("label").cast("int"))


@register("H12_class_weights", """
WITH c AS (SELECT quality, count(*) AS nc FROM labels GROUP BY 1)
SELECT doc_id, quality, round((SELECT count(*) FROM labels) / ((SELECT count(*) FROM c) * nc), 6) AS weight
FROM labels JOIN c USING (quality)""")
def h12(spark, sf):
    w = FE.class_weights(table(spark, sf, "labels"), "quality")
    return w.select("doc_id", "quality", _r6("weight"))


@register("H11_fit_transform_features")
def h11(spark, sf):
    """Fit on the 80% train split, transform everything: vector width and label."""
    tr = _train(spark, sf)
    fitted = FE.FeaturePipeline(target="p_brand", scaler="standard", id_col="p_partkey").fit(tr.where("is_train").drop("is_train"))
    out = fitted.transform(part_nulls(spark, sf))
    from pyspark.ml.functions import vector_to_array
    return out.select("p_partkey", "label", F.size(vector_to_array("features")).alias("n_features"))


def vector_rows(df, names, *keys):
    """(keys..., feature, value) of the entries of ``features`` that are not zero."""
    d = df.select(*keys, F.unwrap_udt("features").alias("_v"))
    v = F.col("_v")
    # a dense vector has no indices
    at = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    name = F.split(F.lit("\x01".join(names)), "\x01")
    # an outer generator: for an inner one the vectors would be made again inside a size filter
    rows = d.select(*keys, F.inline_outer(F.arrays_zip(at.alias("_at"), v["values"].alias("value")))).where("value <> 0")
    return rows.select(*keys, F.get(name, F.col("_at")).alias("feature"), _r6("value"))


_DOCS = "SELECT doc_id, lang, n_chars, text FROM documents"
_TEXT_SQL = f"""
WITH d AS (SELECT doc_id, lang, n_chars, {tokens_sql('text')} AS tok, {{train}} AS is_train FROM documents),
{grams_sql('d', ['doc_id', 'is_train'], 3)},
tf AS (SELECT doc_id, is_train, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf WHERE is_train GROUP BY term ORDER BY total DESC, term LIMIT 5000),
n AS (SELECT count(*) AS n, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM d WHERE is_train),
w AS (SELECT tf.doc_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + n.n) / (1 + v.df)) + 1) AS w FROM tf JOIN v USING (term), n),
f AS (SELECT doc_id, 'text__' || term AS feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS value FROM w
      UNION ALL SELECT doc_id, 'n_chars', (n_chars - m) / CASE WHEN s = 0 THEN 1 ELSE s END FROM d, n
      UNION ALL SELECT doc_id, 'lang_' || lang, 1.0 FROM d WHERE lang IN (SELECT lang FROM d WHERE is_train))
"""


def _doc_features(spark, sf, train=None):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    fitted = FE.FeaturePipeline(text_cols=["text"], id_col="doc_id").fit(d if train is None else d.where(train))
    return fitted, fitted.transform(d)


@register("H09_assemble_text", _TEXT_SQL.replace("{train}", "true") + "SELECT doc_id, feature, round(value, 6) AS value FROM f WHERE value <> 0")
def h09(spark, sf):
    """Numeric, one-hot and text features in one vector, as its entries."""
    fitted, out = _doc_features(spark, sf)
    return vector_rows(out, fitted.feature_names(), "doc_id")


@register("H10_feature_names", _TEXT_SQL.replace("{train}", "true") + """
SELECT CAST(row_number() OVER (ORDER BY kind, total DESC, name) - 1 AS INTEGER) AS position, name
FROM (SELECT 0 AS kind, 0 AS total, 'n_chars' AS name UNION ALL SELECT DISTINCT 1, 0, 'lang_' || lang FROM d
      UNION ALL SELECT 2, total, 'text__' || term FROM v)""")
def h10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")
    names = FE.FeaturePipeline(text_cols=["text"], id_col="doc_id").fit(d).feature_names()
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")


@register("H11_text_fit_transform", _TEXT_SQL.replace("{train}", f"{_h('doc_id')} < '{hex_threshold(0.8)}'") + """
SELECT doc_id, feature, round(value, 6) AS value FROM f WHERE value <> 0""")
def h11_text(spark, sf):
    """Fitted on four fifths of the documents, applied to all."""
    fitted, out = _doc_features(spark, sf, hash_below(hash_hex("doc_id", seed=42, salt="split"), 0.8))
    return vector_rows(out, fitted.feature_names(), "doc_id")
