"""A corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, benchmark leaks go, personal data is redacted, and what is left is
packed into training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read back as the next one's ``docs``.
All but the last return the columns of ``docs``, whatever they are; their own
columns are named by ``__`` and never meet others.

Nulls and empty texts: a null text has no match, no shingle and no leak, stays
null when redacted, and is packed as an empty document.  Rows that share a doc_id
stay or go together.  A null doc_id cannot be told apart in the join stages: such
rows are kept by the deduplicating and decontaminating stages, and the toxicity
stage judges their texts like any other.  Empty tables pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, pii, queries, toxicity
from tessera.llm.common import ensure_checkpoint_dir, importable, materialise, shared_dir, small_batches, table

#: A document whose score reaches this is rejected.
TOXIC = 0.5
#: Words of a shingle and similarity of near duplicates (num / den).
SHINGLE, NUM, DEN = 5, 80, 100
CAPACITY = 1024
#: Bytes of words a packing worker remembers: the workers have served the other stages before.
CACHE_BYTES = 32_000_000
#: Number of a row within a stage that drops rows.
ROW = "__row"


def ready(spark: SparkSession) -> None:
    """Before a stage that hands texts to Python workers: those of all stages share an
    executor's memory with what the JVM has taken by then."""
    importable(spark)
    small_batches(spark)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below TOXIC."""
    ready(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    insults, weights = toxicity.fit(rows, table(spark, sf_dir, "labels"), held_out=queries.held_out())
    return toxicity.keep_below(docs, insults, weights, TOXIC)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``__row`` for each row, fixed by the written table."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "pipeline-rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest id
    (a null id after all others), of equal ids any one."""
    ready(spark)
    rows = numbered(docs)
    found = ngram_join.join(rows.select(F.col(ROW).alias("doc_id"), "text"), n=SHINGLE, num=NUM, den=DEN)
    member = (rows.select(ROW, F.col("doc_id").alias("__id"))
              .join(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("__component")), ROW))
    first = member.groupBy("__component").agg(F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", ROW)).alias("__first"))
    return rows.join(first.select(F.col(f"__first.{ROW}").alias(ROW)), ROW, "left_semi").drop(ROW)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    rows = numbered(docs)
    found = decontaminate.leaks(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.select(F.col("doc_id").alias(ROW)).distinct(), ROW, "left_anti").drop(ROW)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    ready(spark)
    return pii.redact_column(docs, "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and place there."""
    ready(spark)
    packed = packing.pack(docs, queries.tokenizer_path(), queries.END_ID, capacity=CAPACITY, cache_bytes=CACHE_BYTES)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, "pipeline", name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The learned grammar, components of links and the tokenizer are beyond SQL:
#: the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None
