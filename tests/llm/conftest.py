import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.common import ensure_checkpoint_dir, importable

#: Names that the operators use inside; they must not matter.
CLASHES = ["ids", "n_tokens", "node", "shard", "seed", "x", "part", "length", "run", "score", "size", "rep", "h", "item_id", "__w", "label", "spans"]


@pytest.fixture(autouse=True)
def shared(spark):
    ensure_checkpoint_dir(spark)
    importable(spark)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    base = words(rng, 60)
    rows = [(0, base), (1, None), (2, ""), (3, " \n\t "), (4, words(rng, 30_000)), (5, base), (5, base), (None, "some words without an id"),
            (None, None), (7, "one"), (8, "one two three four"), (9, base + " more"), (10, words(rng, 300)), (-3, "negative id é ß"), (2**40, base)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    """The odd rows with extra columns of clashing names."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit(f"extra {c}"))
    return df


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
