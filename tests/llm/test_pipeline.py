import random

import corpus_pipeline as C
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.llm import pii, queries, toxicity
from tessera.session import table

from .conftest import CLASHES, frame, words
from .test_decontaminate import brute as leaks
from .test_ngram_join import brute as links
from .test_packing import check, tokenizer  # noqa: F401

NUMBERS = [8, 2, 1, 6, 10]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_equals_its_brute_force(spark, sf, tokenizer):  # noqa: F811
    docs = table(spark, sf, "documents")
    names = docs.columns
    at = names.index("text")
    # toxicity: the fitted grammar applied to one text after another
    insults, weights = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf, "labels"), held_out=queries.held_out())
    found = toxicity.Matcher(insults)
    score = lambda t: 1 / (1 + np.exp(-(toxicity._features(np.array([found.counts(t or "")])) @ weights)[0]))
    rows = rows_of(docs)
    kept = [r for r in rows if score(r[at]) < C.TOXIC]
    out = C.drop_toxic(spark, docs, sf)
    assert out.columns == names and rows_of(out) == kept and 0 < len(rows) - len(kept)
    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    # near duplicates: all pairs
    stay = {d for d, _, c in links([(r[0], r[at]) for r in rows], C.SHINGLE, C.NUM, C.DEN) if d == c}
    kept = [r for r in rows if r[0] in stay]
    out = C.drop_near_duplicates(spark, docs, sf)
    assert out.columns == names and rows_of(out) == kept and len(kept) < len(rows)
    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    # leaks: all alignments
    bench = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    gone = {x[0] for x in leaks([(r[0], r[at]) for r in rows], bench)}
    kept = [r for r in rows if r[0] not in gone]
    out = C.drop_leaks(spark, docs, sf)
    assert out.columns == names and rows_of(out) == kept and gone
    docs, rows = spark.createDataFrame(kept, docs.schema), kept
    # personal data
    kept = [(*r[:at], None if r[at] is None else pii.redact(r[at]), *r[at + 1:]) for r in rows]
    out = C.redact_personal_data(spark, docs, sf)
    assert out.columns == names and rows_of(out) == sorted(kept, key=str) and any("[EMAIL]" in (r[at] or "") for r in kept)
    # packing
    out = C.pack_sequences(spark, spark.createDataFrame(kept, docs.schema), sf)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.select("doc_id").distinct().count() == len(kept)


def test_run_is_the_chain_of_stages(spark, sf):
    out = C.run(spark, sf)
    assert out.count() > 0 and [n for n, _ in C.STAGES] and len(C.STAGES) == len(NUMBERS)


def test_odd_rows(spark, odd, none, sf):
    odd = odd.drop("item_id").withColumn("item_id", F.lit(1))
    for docs in (odd, none):
        left = docs
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.collect()
            left = stage(spark, left, sf)
        packed = C.pack_sequences(spark, left, sf)
        assert packed.filter("piece = 0").count() == left.count()
    kept = {r.doc_id for r in C.drop_near_duplicates(spark, odd, sf).collect()}
    assert {0, 1, 2, 3, None, 7} <= kept and 2**40 not in kept and 5 not in kept
    assert set(CLASHES) <= set(odd.columns)


def test_rows_without_or_with_shared_ids_are_judged_alike(spark, sf):
    rng = random.Random(8)
    base, other = words(rng, 50), words(rng, 50)
    leak = table(spark, sf, "benchmark").filter("size(split(text, ' ')) > 14").first().text
    rows = [(None, base), (4, base), (4, base), (9, base + " end"), (None, other), (None, other), (6, leak), (None, leak), (6, "clean words " + other[:40])]
    docs = frame(spark, rows)
    assert rows_of(C.drop_near_duplicates(spark, docs, sf)) == sorted([(4, base), (None, other), (6, leak), (6, "clean words " + other[:40])], key=str)
    left = rows_of(C.drop_leaks(spark, docs, sf))
    assert left == sorted([r for r in rows if r[1] != leak], key=str)


def test_entry_has_every_query():
    names = E.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names


def test_stages_hand_short_batches_to_python(spark, sf):
    """After any stage with Python workers 12 MB of long texts come in batches of 5 MB at most, short rows
    still by the thousands; a limit of the session's own stays."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = frame(spark, [(i, f"some words {i}") for i in range(5)])
    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("abcd"), 1000).alias("text"))
    try:
        for stage in (C.drop_toxic, C.drop_near_duplicates, C.redact_personal_data, C.pack_sequences):
            spark.conf.unset(key)
            stage(spark, docs, sf)
            got = long.mapInArrow(sizes, "n long, bytes long").collect()
            assert sum(r.n for r in got) == 3000 and max(r.bytes for r in got) < 5_000_000, stage
        assert [r.n for r in spark.range(0, 9000, 1, 1).mapInArrow(sizes, "n long, bytes long").collect()] == [9000]
        spark.conf.set(key, "30m")
        C.redact_personal_data(spark, docs, sf)
        assert spark.conf.get(key) == "30m"
    finally:
        spark.conf.unset(key)
