"""Operator 3: document fingerprints by one-permutation MinHash.

Every word shingle (``SHINGLE`` words, the whole text if it has fewer) is hashed
once; the high bits of the hash name one of ``BINS`` bins and a bin keeps its
smallest hash.  Each empty bin borrows from the full bin that its own fixed
probing order reaches first, so two texts borrow alike (optimal densification).
The fingerprint packs the ``BITS`` low bits of each bin as hexadecimal digits;
chance agreement of those bits is taken out of a likeness.

Everything is a DataFrame expression.  Texts without words (null, empty, white
space) have the empty fingerprint, which is like itself and nothing else.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE, BINS, BITS = 5, 128, 8
_LOW = 63 - int(math.log2(BINS))  # bits of a hash below its bin
_EMPTY = (1 << _LOW) - 1  # the largest value of a bin marks it as empty
#: Rows of one run of neighbouring documents.
RUN = 1000
MAX_RUNS = 1 << 16


def _probe(i: int) -> tuple[int, int]:
    """Start and odd step of bin i's probing order."""
    x = (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    return (x >> 40) % BINS, (x >> 20) % BINS | 1


def _constants(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def with_fingerprint(df: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """Add ``out``: the fingerprint's bytes, less 128 each, as array<tinyint>; empty without words.

    Each step is a column of its own, since a lambda evaluates what it captures
    once for every element.
    """
    keep = [F.col(c) for c in df.columns]
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), "")
    hashed = df.select(*keep, F.transform(words, lambda w: F.xxhash64(w)).alias("__w"))
    n = F.size("__w")
    rolling = F.transform(F.slice("__w", 1, F.greatest(n - (shingle - 1), F.lit(0))), lambda x, i: F.shiftrightunsigned(
        F.xxhash64(x, *[F.get(F.col("__w"), i + k) for k in range(1, shingle)]), 1))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(F.transform("__w", lambda x: x.cast("string")), " ")), 1))
    shingles = F.when(n >= shingle, rolling).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    marks = _constants([((i + 1) << _LOW) - 1 for i in range(BINS)])
    # with one mark behind each bin's hashes, the first value of every bin is its minimum, or the mark
    ordered = hashed.select(*keep, F.sort_array(F.concat(shingles, marks)).alias("__s"))
    first = ordered.select(*keep, F.filter("__s", lambda x, i: (i == 0) | (
        F.shiftright(x, _LOW) != F.shiftright(F.get(F.col("__s"), i - 1), _LOW))).alias("__d"))
    full = first.select(*keep, "__d", F.filter("__d", lambda x: x.bitwiseAND(_EMPTY) != _EMPTY).alias("__f"))
    start, step = (_constants(list(c)) for c in zip(*map(_probe, range(BINS)), strict=True))

    def borrowed(i: Column) -> Column:
        """The value of the full bin that comes first in bin i's order, without its bin."""
        turn = lambda y: F.shiftleft(((F.shiftright(y, _LOW) - F.get(start, i)) * F.get(step, i)).bitwiseAND(BINS - 1), _LOW)
        return F.array_min(F.transform("__f", lambda y: turn(y) + y.bitwiseAND(_EMPTY)))

    low = lambda v: (v.bitwiseAND((1 << BITS) - 1) - 128).cast("tinyint")
    dense = F.transform("__d", lambda x, i: low(F.when(x.bitwiseAND(_EMPTY) != _EMPTY, x).otherwise(borrowed(i))))
    return full.select(*keep, F.when(F.size("__f") > 0, dense).otherwise(F.array().cast("array<tinyint>")).alias(out))


def as_hex(fingerprint: Column) -> Column:
    """The packed bytes as lower-case hexadecimal digits, two for each bin."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.substring(F.hex(x.cast("int") + 384), 2, 2)), ""))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -BITS
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))))


def _run_of(key: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` up to ``key``, found in two steps."""
    step = max(1, math.isqrt(len(bounds)))
    parts = [bounds[i: i + step] for i in range(0, len(bounds), step)] or [[]]
    upto = lambda a: F.size(F.filter(a, lambda b: b <= key))
    if not bounds:
        return F.lit(0)
    heads = upto(_constants([p[0] for p in parts]))
    inside = F.array(*[_constants(p) for p in parts])
    return F.coalesce(F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * step + upto(F.get(inside, heads - 1))), F.lit(0))


def with_next(df: DataFrame, key: str, columns: list[str], prefix: str = "next_", run: int = RUN) -> DataFrame:
    """Add the ``columns`` of the row that follows by ``key`` (ties by the hash of
    the first column); the first row follows the last.  A null key comes first.

    Rows are dealt into runs of about ``run`` neighbouring keys and ordered inside
    a run; the rows of each run's first key are copied behind the run before, so
    the wide columns are shuffled once and no task orders the table.
    """
    spark = df.sparkSession
    n = df.count()
    runs = max(1, min(MAX_RUNS, n // run))
    found = df.stat.approxQuantile(key, [i / runs for i in range(1, runs)], 0.25 / runs) if runs > 1 else []
    bounds = sorted({int(b) for b in found})
    run_of = _run_of(F.col(key), bounds)
    # at most MAX_RUNS rows
    heads = (df.select(F.col(key).alias("k"), run_of.alias("run")).groupBy("run")
             .agg(F.min("k").alias("head"), F.max(F.col("k").isNull()).alias("no_key")).orderBy("run").collect())
    order = [r["run"] for r in heads]
    links = [(r["run"], None if r["no_key"] else r["head"], order[i - 1], i == 0) for i, r in enumerate(heads)]
    small = spark.createDataFrame(links, "__run int, __head long, __to int, __wrap boolean")
    dealt = (df.withColumn("__run", run_of).join(F.broadcast(small), "__run")
             .withColumn("__put", F.when(F.col(key).eqNullSafe(F.col("__head")), F.array(
                 F.struct(F.col("__run").alias("run"), F.lit(0).alias("guest")), F.struct(F.col("__to").alias("run"), F.lit(1).alias("guest"))))
                 .otherwise(F.array(F.struct(F.col("__run").alias("run"), F.lit(0).alias("guest")))))
             .withColumn("__put", F.explode("__put"))
             .select(*df.columns, F.col("__put.run").alias("__in"), F.col("__put.guest").alias("__guest")))
    window = Window.partitionBy("__in").orderBy("__guest", F.col(key).asc_nulls_first(), F.xxhash64(columns[0]), columns[0])
    return (dealt.select(*df.columns, "__guest", *[F.lead(c).over(window).alias(prefix + c) for c in columns])
            .filter("__guest = 0").drop("__guest"))


def edited_text(text: str, following: str) -> Column:
    """The last quarter of the code points (rounded down) replaced by the first
    as many, or all, of the following text."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(following, F.lit(1), quarter))
