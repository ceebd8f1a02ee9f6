"""One thin query for each operator; ``SQL`` holds what DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (conversation_repair, cross_tokens, decontaminate, fingerprint, ngram_join, packing, pii, quality, sharding, token_archive,
                         topk_search, toxicity, warc)
from tessera.llm.common import documents, ensure_checkpoint_dir, importable, shared_dir, table

#: Vocabulary file of the token queries.
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: The model that the alignment sets beside it.
OTHER_VOCABULARY = "piece_bpe_32k.model"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, by document and item."""
    return decontaminate.leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_partition_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles have a similarity of 0.85 or more."""
    return ngram_join.join(documents(spark, sf_dir), n=4, num=85, den=100).select("doc_id", "n_shingles", "component_id", "class_id")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likenesses."""
    docs = documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    rows = fingerprint.with_next(fingerprint.with_fingerprint(docs, "text", "bins"), "doc_id", ["text", "bins"])
    rows = rows.withColumn("edited", fingerprint.edited_text("text", "next_text"))
    rows = fingerprint.with_fingerprint(
        rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "bins", "next_bins"), "edited", "edited_bins")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint.as_hex(F.col("bins")).alias("fingerprint"), fingerprint.as_hex(F.col("edited_bins")).alias("edited_fingerprint"),
                       fingerprint.likeness("bins", "edited_bins").alias("near_edited"), fingerprint.likeness("bins", "next_bins").alias("near_next"))


def op4_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, equal texts together; row counts at most one apart."""
    nodes, links = sharding.text_nodes(documents(spark, sf_dir))
    return (sharding.shard_rows(nodes, links, 8)
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def op5_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids written to the Huffman archive and read back."""
    path = shared_dir(spark, "token-archive")
    token_archive.write_token_archive(documents(spark, sf_dir), path, tokenizer_path(), END_ID)
    return token_archive.read_token_archive(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: counts and digest of the plain spans, and all spans."""
    found = pii.find_pii(documents(spark, sf_dir))
    plain = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return (found.withColumn("plain", plain)
            .select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined("plain"), 256).alias("base_sha256"),
                    joined("spans").alias("spans"), (F.size("spans") - F.size("plain")).cast("long").alias("n_added")))


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def op7_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from positive and unlabelled ones."""
    scored = quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out=held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by the weighted grammar."""
    scored = toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), held_out=held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to the archive; its headers joined with the verified payloads."""
    path = shared_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    # the payloads themselves need not follow the records: their verified size does
    kept = warc.read_payloads(spark, path).select("digest", F.length("payload").cast("long").alias("payload_bytes"))
    return (warc.read_headers(spark, path).drop("payload_bytes").join(kept, "digest")
            .select(F.col("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"))


SQL_WARC = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text packed into sequences of 1024 tokens."""
    packed = packing.pack(documents(spark, sf_dir), tokenizer_path(), END_ID, capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op11_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after the damage, its cheapest repair and the repaired text's digest."""
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


def op12_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth one by integer inner product."""
    return topk_search.search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op13_merge_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's alignment of two tokenizers and its links' counts in the corpus."""
    return cross_tokens.describe(documents(spark, sf_dir), tokenizer_path(), tokenizer_path(OTHER_VOCABULARY))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spaced_seeds": op1_spaced_seeds,
    "op2_partition_join": op2_partition_join,
    "op3_fingerprint": op3_fingerprint,
    "op4_label_shards": op4_label_shards,
    "op5_token_archive": op5_token_archive,
    "op6_deobfuscation": op6_deobfuscation,
    "op7_positive_unlabelled": op7_positive_unlabelled,
    "op8_pattern_grammar": op8_pattern_grammar,
    "op9_warc_archive": op9_warc_archive,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_lightest_repair": op11_lightest_repair,
    "op12_sorted_lists": op12_sorted_lists,
    "op13_merge_path": op13_merge_path,
}
SQL: dict[str, str] = {"op1_spaced_seeds": decontaminate.leak_sql().strip(), "op9_warc_archive": SQL_WARC.strip(),
                       "op12_sorted_lists": topk_search.search_sql().strip()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries, each with the shared folder set and the workers' path known."""
    def ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            importable(spark)
            return f(spark, sf_dir)
        return run
    return {name: ready(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
