"""Operator 1: benchmark decontamination by spaced-seed hashing.

A leak is a window of ``WINDOW`` words in which a document and a benchmark item,
laid side by side, agree in all but ``TOLERANCE`` places; an item of fewer words
(``MIN_WORDS`` at least) must occur whole.  Words are runs of letters and digits
of the lower-cased text.

A mask selects some positions of a short span and ignores the others.  The masks
below are lossless: wherever up to TOLERANCE substitutions fall in a window, one
mask at one offset selects none of them.  So the hashes of the selected words of
every position of every document, joined with those of the items, find every
leak; each hit fixes how the two texts lie side by side, and the words around it
are compared in full.

Everything is a DataFrame expression.  Items that repeat a text count under their
smallest id.  Null and empty texts hold no words and leak nothing; repeated
documents are reported once for each id; texts of any length are read whole; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, bounded

WINDOW, TOLERANCE, MIN_WORDS = 13, 2, 5
#: Positions that a seed selects.  Fixed values; lossless for 2 substitutions in 13 words.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 2, 3, 6, 7, 8))


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text in order."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(h: str, at: str, masks: tuple[tuple[int, ...], ...]) -> Column:
    """The hashes of all masks at one position; null where a mask passes the end."""
    def one(m: tuple[int, ...]) -> Column:
        words = [F.get(F.col(h), F.col(at) + o) for o in m]
        return F.when(F.col(at) + m[-1] < F.size(h), F.xxhash64(F.lit(repr(m)), *words))
    return F.array(*[one(m) for m in masks])


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text",
          item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, tolerance: int = TOLERANCE,
          min_words: int = MIN_WORDS, masks: tuple[tuple[int, ...], ...] = MASKS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and item that overlap: doc_id, item_id,
    item_words, matched_words (most agreeing words in one alignment), doc_word
    (where the first window starts).

    Up to ``broadcast_rows`` benchmark seeds travel to the documents.  Beyond that the
    positions of the documents are shuffled by seed, without their words; the hits
    fetch the words again."""
    items = (benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("item_h"))
             .filter(F.size("item_h") >= min_words)
             .groupBy("item_h").agg(F.min("item_id").alias("item_id")))
    # an item shorter than the window is one solid seed; there are fewer such lengths than words in a window
    short = [r[0] for r in items.select(F.size("item_h").alias("n")).filter(F.col("n") < window).distinct().collect()]
    every = (*masks, *[tuple(range(n)) for n in sorted(short)])

    def exploded(rows: DataFrame, h: str, *keep: str) -> DataFrame:
        at = rows.select(*keep, h, F.posexplode(h).alias("at", "word"))
        return (at.select(*keep, h, "at", F.explode(_seeds(h, "at", every)).alias("seed")).filter("seed is not null"))

    seeds = exploded(items, "item_h", "item_id").select("seed", "item_id", F.col("at").alias("item_at"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_text).alias("copy"), word_hashes(F.col(doc_text)).alias("h"))
    n_seeds, n_items = seeds.count(), items.count()
    carried = ["h"] if n_seeds <= broadcast_rows else []
    hits = (exploded(rows, "h", "doc_id", "copy").select("doc_id", "copy", *carried, "at", "seed")
            .join(bounded(seeds, n_seeds, broadcast_rows), "seed")
            .select("doc_id", "copy", "item_id", *carried, (F.col("at") - F.col("item_at")).alias("shift")))
    if not carried:
        words = rows.dropDuplicates(["doc_id", "copy"]).select(F.col("doc_id").alias("__d"), F.col("copy").alias("__c"), "h")
        hits = hits.distinct().join(words, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("copy") == F.col("__c"))).drop("__d", "__c")
    # the document's words beside the item: from where either begins to where either ends
    sized = items.select("item_id", "item_h", F.size("item_h").alias("item_words"))
    beside = (hits.join(bounded(sized, n_items), "item_id")
              .withColumn("low", F.greatest(F.lit(0), -F.col("shift")))
              .withColumn("n", F.least(F.col("item_words"), F.size("h") - F.col("shift")) - F.col("low"))
              .select("doc_id", "copy", "item_id", "shift", "low", "n",
                      F.slice("h", F.col("shift") + F.col("low") + 1, F.col("n")).alias("words"))
              .groupBy("doc_id", "copy", "item_id", "shift")  # the seeds of one alignment are one candidate
              .agg(F.first("low").alias("low"), F.first("n").alias("n"), F.first("words").alias("words")))
    agree = F.zip_with("words", F.slice("item_h", F.col("low") + 1, F.col("n")), lambda a, b: (a == b).cast("int"))
    need = F.when(F.col("item_words") >= window, F.lit(window - tolerance)).otherwise(F.col("item_words"))
    span = F.least(F.lit(window), F.col("item_words"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    compared = (beside.join(bounded(sized, n_items), "item_id").filter(F.col("n") >= span)
                .withColumn("agree", agree).withColumn("span", span).withColumn("need", need)
                .withColumn("matched", total(F.col("agree"))).filter("matched >= need"))
    starts = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("agree", i) == 1) & (
        total(F.slice("agree", i + 1, F.col("span"))) >= F.col("need")))
    return (compared.withColumn("starts", starts).filter(F.size("starts") > 0)
            .groupBy("doc_id", "item_id")
            .agg(F.first("item_words").cast("long").alias("item_words"), F.max("matched").cast("long").alias("matched_words"),
                 F.min(F.col("shift") + F.col("low") + F.get("starts", F.lit(0))).cast("long").alias("doc_word")))


def leak_sql(window: int = WINDOW, tolerance: int = TOLERANCE, min_words: int = MIN_WORDS) -> str:
    """DuckDB: agreeing words of every alignment, without seeds."""
    words = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH i0 AS (SELECT {words.format('text')} AS ws, item_id FROM benchmark),
i AS (SELECT ws, min(item_id) AS item_id, len(ws) AS item_words FROM i0 WHERE len(ws) >= {min_words} GROUP BY ws),
d AS (SELECT doc_id, {words.format('text')} AS ws FROM documents),
iw AS (SELECT item_id, item_words, unnest(ws) AS w, unnest(range(len(ws))) AS ip FROM i),
dw AS (SELECT doc_id, len(ws) AS doc_words, unnest(ws) AS w, unnest(range(len(ws))) AS dp FROM d),
m AS (SELECT doc_id, item_id, item_words, doc_words, dp, dp - ip AS shift FROM dw JOIN iw USING (w)),
a AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS matched,
             count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY dp
                            RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS ahead
      FROM m WHERE least(item_words, doc_words - shift) - greatest(0, -shift) >= least({window}, item_words))
SELECT doc_id, item_id, CAST(min(item_words) AS BIGINT) AS item_words, CAST(max(matched) AS BIGINT) AS matched_words,
       CAST(min(dp) AS BIGINT) AS doc_word
FROM a WHERE ahead >= CASE WHEN item_words >= {window} THEN {window - tolerance} ELSE item_words END
GROUP BY doc_id, item_id
"""
