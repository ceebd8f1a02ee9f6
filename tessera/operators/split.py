"""Sampling and splitting.

All randomness is the md5 draw of (id, seed, salt) (primitive P2): the same
row lands on the same side for a given seed whatever the partitioning, and a
SQL engine with ``md5`` reproduces the split.  Exact-size variants rank rows
by the draw with ``hash_rank`` (balanced hash buckets, so a hot class is
spread over thousands of tasks); orderings by time use ``range_rank``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import DIGITS, hash_below, hash_hex, hash_uniform
from tessera.operators.ordering import group_count, hash_rank, range_rank
from tessera.operators.profile import TRAIN_WORDS, apply_schema

SPLIT_COL = "is_train"


def random_split(df: DataFrame, id_col: str, fraction: float, seed: int = 42,
                 salt: str = "split") -> DataFrame:
    """``is_train`` with probability ``fraction`` (>= 1 all train,
    <= 0 all test)."""
    return df.withColumn(SPLIT_COL, hash_below(hash_hex(id_col, seed=seed, salt=salt), fraction))


def _round_half_up(x):
    return F.floor(x + F.lit(0.5)).cast("long")


def exact_split(df: DataFrame, id_col: str, fraction: float, seed: int = 42,
                stratify_col: str | None = None, salt: str = "split") -> DataFrame:
    """G01 exact-size / G02 stratified: within each class the rows with the
    ``round(n_c * fraction)`` smallest draws are train."""
    groups = [stratify_col] if stratify_col else []
    d = df.withColumn("_h", hash_hex(id_col, seed=seed, salt=salt))
    d = hash_rank(d, "_h", [id_col], groups, name="_r")
    d = group_count(d, groups, "_nc")
    return d.withColumn(SPLIT_COL, F.col("_r") <= _round_half_up(F.col("_nc") * F.lit(float(fraction)))).drop(
        "_h", "_r", "_nc")


def stratified_split(df: DataFrame, id_col: str, label: str, fraction: float, seed: int = 42) -> DataFrame:
    """G02 with the reference's guard: stratify only when every class has more
    than one row, else a plain exact split."""
    mins = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return exact_split(df, id_col, fraction, seed, stratify_col=label if mins and mins > 1 else None)


def chronological_split(df: DataFrame, order_col: str, id_col: str, fraction: float) -> DataFrame:
    """First floor(n * fraction) rows by (order_col, id_col) are train."""
    d = range_rank(df, [order_col, id_col], name="_r")
    d = group_count(d, [], "_n")
    return d.withColumn(SPLIT_COL, F.col("_r") <= F.floor(F.col("_n") * F.lit(float(fraction)))).drop("_r", "_n")


def manual_split(df: DataFrame, col: str) -> DataFrame:
    """Booleans, or text in train/1/true/tr (any case) -> train; the flag
    column is removed."""
    from pyspark.sql import types as T
    dt = df.schema[col].dataType
    if isinstance(dt, T.BooleanType):
        flag = F.coalesce(F.col(col), F.lit(False))
    else:
        flag = F.coalesce(F.lower(F.col(col).cast("string")).isin(*TRAIN_WORDS), F.lit(False))
    return df.withColumn(SPLIT_COL, flag).drop(col)


def split(df: DataFrame, fraction: float, strategy: str = "random", id_col: str | None = None,
          order_col: str | None = None, label: str | None = None, manual_col: str | None = None,
          seed: int = 42) -> DataFrame:
    """One entry point over G01-G05; returns ``df`` plus ``is_train``."""
    if fraction >= 1.0:
        return df.withColumn(SPLIT_COL, F.lit(True))
    if fraction <= 0.0:
        return df.withColumn(SPLIT_COL, F.lit(False))
    if strategy == "chronological":
        return chronological_split(df, order_col, id_col, fraction)
    if strategy == "manual":
        return manual_split(df, manual_col)
    if strategy == "stratified" and label:
        return stratified_split(df, id_col, label, fraction, seed)
    if strategy == "exact":
        return exact_split(df, id_col, fraction, seed)
    return random_split(df, id_col, fraction, seed)


def prepare(configs, global_split: float | None = None, seed: int = 42):
    """Per dataset apply overrides and split, then union each side by
    name.  ``configs``: dicts with ``df``, optional ``overrides``, ``split``
    (percent), ``strategy``, ``id_col``, ``order_col``, ``label``, ``manual_col``."""
    trains, tests = [], []
    for c in configs:
        d = c["df"]
        if c.get("overrides"):
            d = apply_schema(d, c["overrides"])
        frac = global_split if global_split is not None else c.get("split", 80) / 100.0
        s = split(d, frac, c.get("strategy", "random"), c.get("id_col"), c.get("order_col"),
                  c.get("label"), c.get("manual_col"), seed)
        trains.append(s.where(F.col(SPLIT_COL)).drop(SPLIT_COL))
        tests.append(s.where(~F.col(SPLIT_COL)).drop(SPLIT_COL))

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out
    return union(trains), union(tests)


def _contiguous_fold(rank0, n, k: int):
    """sklearn-style contiguous folds: the first n % k folds hold one extra row."""
    q = F.floor(n / F.lit(k))
    big = n - q * F.lit(k)
    edge = big * (q + 1)
    return F.when(rank0 < edge, F.floor(rank0 / (q + 1))).otherwise(
        big + F.floor((rank0 - edge) / q)).cast("int")


def kfold(df: DataFrame, k: int, id_col: str, shuffle: bool = True, seed: int = 42,
          order_col: str | None = None) -> DataFrame:
    """Column ``fold`` in [0, k).  Shuffled: contiguous blocks of the hash
    order; otherwise contiguous blocks of (order_col, id_col)."""
    if shuffle:
        d = hash_rank(df.withColumn("_h", hash_hex(id_col, seed=seed, salt="kfold")), "_h", [id_col],
                      name="_r").drop("_h")
    else:
        d = range_rank(df, [order_col, id_col] if order_col else [id_col], name="_r")
    d = group_count(d, [], "_n")
    return d.withColumn("fold", _contiguous_fold(F.col("_r") - 1, F.col("_n"), k)).drop("_r", "_n")


def stratified_kfold(df: DataFrame, k: int, id_col: str, label: str | None, seed: int = 42) -> DataFrame:
    """Within each class, rows dealt round-robin in hash order; without a
    label it is G07."""
    if not label:
        return kfold(df, k, id_col, True, seed)
    d = hash_rank(df.withColumn("_h", hash_hex(id_col, seed=seed, salt="skfold")), "_h", [id_col],
                  [label], name="_r")
    return d.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def time_series_folds(df: DataFrame, k: int, order_col: str, id_col: str, gap: int = 0,
                      max_train_size: int | None = None, test_size: int | None = None) -> DataFrame:
    """Expanding-window splits.  Long output (fold, role, row...) where a
    row appears once per fold it belongs to: test block i covers ranks
    [n - (k - i) m, n - (k - i - 1) m), m = n // (k + 1); train is every rank
    before the block minus ``gap``, keeping the last ``max_train_size``."""
    d = range_rank(df, [order_col, id_col], name="_r")
    d = group_count(d, [], "_n")
    m = F.coalesce(F.lit(test_size).cast("long"), F.floor(F.col("_n") / F.lit(k + 1)))
    r0 = F.col("_r") - 1
    folds = F.sequence(F.lit(0), F.lit(k - 1))
    d = d.withColumn("_m", m).withColumn("fold", F.explode(folds))
    test_start = F.col("_n") - (F.lit(k) - F.col("fold")) * F.col("_m")
    test_end = test_start + F.col("_m")
    train_end = test_start - F.lit(gap)
    is_test = (r0 >= test_start) & (r0 < test_end)
    is_train = r0 < train_end
    if max_train_size:
        is_train = is_train & (r0 >= train_end - F.lit(max_train_size))
    d = d.withColumn("role", F.when(is_test, F.lit("test")).when(is_train, F.lit("train")))
    return d.where(F.col("role").isNotNull()).drop("_r", "_n", "_m")


def monte_carlo_splits(df: DataFrame, id_col: str, n_iter: int, fraction: float, seed: int = 42) -> DataFrame:
    """Iteration i uses seed + i; all iterations in one job: each row is
    expanded to its n_iter memberships (no join)."""
    d = df.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n_iter - 1))))
    h = F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"),
                                      (F.lit(seed) + F.col("iteration")).cast("string"), F.lit("split"))), 1, DIGITS)
    from tessera.functions.hashing import hex_threshold
    flag = F.lit(True) if fraction >= 1 else (F.lit(False) if fraction <= 0 else h < F.lit(hex_threshold(fraction)))
    return d.withColumn(SPLIT_COL, flag)


def auto_strategy(n_rows: int, task: str) -> str:
    """Time series -> time split; fewer than 1000 rows -> k-fold; else holdout."""
    if task == "time_series":
        return "time_series"
    return "kfold" if n_rows < 1000 else "holdout"


def hash_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Fixed-size sample = the n smallest draws (top-k, no full sort)."""
    return (df.withColumn("_h", hash_hex(id_col, seed=seed, salt="sample"))
            .orderBy("_h", id_col).limit(n).drop("_h"))


def poisson_weights(df: DataFrame, id_col: str, fraction: float = 1.0, seed: int = 42,
                    name: str = "weight") -> DataFrame:
    """Bootstrap as a Poisson(fraction) copy count per row by inverse CDF
    of the row's draw (deterministic, no shuffle).  The largest count follows
    from the fraction: its tail beyond that is below one draw in 2^60."""
    import math
    max_k = math.ceil(fraction + 12 * math.sqrt(fraction) + 20)
    # a column of its own: within the branches it would be drawn again for each
    df, u = df.withColumn("__draw", hash_uniform(id_col, seed=seed, salt="boot")), F.col("__draw")
    cdf, p, expr = 0.0, math.exp(-fraction), None
    branches = []
    for k in range(max_k):
        cdf += p
        branches.append((k, cdf))
        p *= fraction / (k + 1)
    expr = F.lit(max_k)
    for k, c in reversed(branches):
        expr = F.when(u < F.lit(c), F.lit(k)).otherwise(expr)
    return df.withColumn(name, expr.cast("int")).drop("__draw")


def bootstrap(df: DataFrame, id_col: str, fraction: float = 1.0, seed: int = 42) -> DataFrame:
    """Materialised resample -- each row repeated by its Poisson weight."""
    w = poisson_weights(df, id_col, fraction, seed, "_w")
    return w.where(F.col("_w") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop(
        "_w", "_copy")
