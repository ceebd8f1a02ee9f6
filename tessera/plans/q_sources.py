"""Source and sink queries (A01-A05, A07, A13-A16): each writes a driver
table into a fresh scratch lake under the shared checkpoint folder and reads
it back through the lake."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import register
from tessera.session import shared_dir, table
from tessera.sources import telemetry as TL
from tessera.sources.lake import Lake


def _lake(spark):
    return Lake(spark, shared_dir(spark, "lake"))


@register("A01_read_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders""")
def a01(spark, sf):
    lake = _lake(spark)
    src = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                             "o_orderpriority")
    lake.save(src, "orders export", fmt="csv")
    return lake.load("orders export")


@register("A02_csv_options", """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment
FROM customer""")
def a02(spark, sf):
    lake = _lake(spark)
    lake.save(table(spark, sf, "customer"), "customers", fmt="csv", header=False, sep="|", encoding="UTF-8")
    return lake.load("customers", header=False, sep="|", encoding="UTF-8",
                     names=["key", "name", "nation", "balance", "segment"])


@register("A03_read_json", "SELECT event_id, user_id, event_type, value, props FROM events")
def a03(spark, sf):
    lake = _lake(spark)
    lake.save(table(spark, sf, "events").drop("ts"), "events", fmt="json")
    return lake.load("events").select("event_id", "user_id", "event_type", "value", "props")


@register("A03_mixed_json", """
SELECT event_id, user_id, event_type, value, props FROM events
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM (SELECT min(event_id) FROM events) WHERE EXISTS (SELECT 1 FROM events)""")
def a03_mixed(spark, sf):
    """JSON lines of which one is cut, beside files that are arrays, in one version."""
    lake = _lake(spark)
    path = f"{lake.base}/mixed/v_20240101_000000.json"
    events = table(spark, sf, "events").drop("ts")
    line = F.to_json(F.struct(*events.columns)).alias("value")
    first = events.agg(F.min("event_id").alias("event_id"))
    cut = events.join(F.broadcast(first), "event_id", "left_semi").select(F.substring(F.to_json(F.struct(*events.columns)), 1, 20).alias("value"))
    events.where("event_id % 2 = 0").select(line).unionByName(cut).write.mode("append").text(path)

    def as_array(batches):
        import pyarrow as pa
        before = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [(before if k == 0 else ",") + r for k, r in enumerate(rows)]})
            before = "," if rows else before
        yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})

    events.where("event_id % 2 <> 0 or event_id is null").select(line).mapInArrow(as_array, "value string").write.mode("append").text(path)
    return lake.load("mixed").select("event_id", "user_id", "event_type", "value", "props")


@register("A02_csv_encodings", """
SELECT 'latin-1' AS encoding, key, label FROM (SELECT p_partkey AS key, concat(p_name, ' é', p_brand) AS label FROM part)
UNION ALL SELECT 'cp1252', p_partkey, concat(p_name, ' é', p_brand) FROM part
UNION ALL SELECT 'utf-16', p_partkey, concat(p_name, ' é', p_brand) FROM part""")
def a02_encodings(spark, sf):
    """The same table through files of three encodings."""
    lake = _lake(spark)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" é"), "p_brand").alias("label"))
    out = []
    for name, charset in (("latin-1", "ISO-8859-1"), ("cp1252", "ISO-8859-1"), ("utf-16", "UTF-16")):
        lake.save(rows, f"parts {name}", fmt="csv", encoding=charset)
        out.append(lake.load(f"parts {name}", encoding=name).select(F.lit(name).alias("encoding"), "key", "label"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("A04_read_parquet", "SELECT * FROM lineitem")
def a04(spark, sf):
    """A04 + A07: save a version, then load the latest one."""
    lake = _lake(spark)
    lake.save(table(spark, sf, "lineitem"), "lineitem", version="v_20240101_000000")
    lake.save(table(spark, sf, "lineitem"), "lineitem", version="v_20240102_000000")
    return lake.load("lineitem", version="latest")


@register("A05_read_text", "SELECT unnest(string_split(text, chr(10))) AS text FROM documents")
def a05(spark, sf):
    lake = _lake(spark)
    lake.save(table(spark, sf, "documents").select("text"), "docs", fmt="text")
    return lake.load("docs")


def events_log(spark, sf):
    e = table(spark, sf, "events")
    return TL.to_log(e, "event_id", "ts", "event_type", ["user_id", "event_type"], "value")


_LOG_SQL = """SELECT event_id, ts AS timestamp_utc, event_type AS model_version, CAST(1 AS BIGINT) AS row_count,
  event_type AS request_type, value AS prediction, CAST(ts AS DATE) AS date FROM events"""


def _decoded(df):
    return df.select("event_id", "timestamp_utc", "model_version", "row_count",
                     F.get_json_object("request_json", "$.event_type").alias("request_type"),
                     F.get_json_object("predictions_json", "$[0]").cast("double").alias("prediction"), "date")


def _written_log(spark, sf):
    path = shared_dir(spark, "telemetry")
    log = events_log(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    TL.append_log(log.where(F.col("timestamp_utc") < cut), path)
    TL.append_log(log.where(F.col("timestamp_utc") >= cut), path)
    return TL.read_log(spark, path)


@register("A13_append_log", _LOG_SQL)
def a13(spark, sf):
    return _decoded(_written_log(spark, sf))


@register("A14_recent_days", "SELECT * FROM (" + _LOG_SQL + ") l WHERE timestamp_utc >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def a14(spark, sf):
    log = _written_log(spark, sf)
    return _decoded(TL.recent(log, "timestamp_utc", days=7, as_of="2024-01-31", date_col="date"))


@register("A15_model_save_load")
def a15(spark, sf):
    """Fit a Spark ML pipeline, save it to the shared folder, load it back and score."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    d = (table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
         .select("doc_id", "n_chars", "lang", F.col("quality").cast("double").alias("label")))
    pipe = Pipeline(stages=[StringIndexer(inputCol="lang", outputCol="lang_i", handleInvalid="keep"),
                            VectorAssembler(inputCols=["n_chars", "lang_i"], outputCol="features"),
                            LogisticRegression(maxIter=20)])
    path = shared_dir(spark, "model")
    pipe.fit(d).write().save(path)
    return PipelineModel.load(path).transform(d).select("doc_id", "label", "prediction")


@register("A16_export_csv", """
SELECT l_orderkey, l_linenumber, l_returnflag AS label,
       CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS prediction FROM lineitem""")
def a16(spark, sf):
    from tessera.plans.q_aggregates import rule_predictions
    lake = _lake(spark)
    p = rule_predictions(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("label"),
                                           "prediction")
    lake.save(p, "predictions", fmt="csv")
    return lake.load("predictions")
