"""Exact global order statistics without a one-partition window.

Three ways to rank or accumulate across a whole table, each exact, none of
which sends an unbounded group to one task:

* ``hash_rank``   -- order by a hash draw: the first hex digits are a uniform
  bucket (65 536 buckets), so buckets are balanced whatever the key skew.
* ``prefix_sums`` -- cumulative sums over distinct ordered values: buckets
  come from ``percentile_approx`` boundaries computed once, so the bucket of
  a value never changes between jobs.
* ``range_rank``  -- row numbers for an arbitrary ordering (with a unique
  tie-break): ``repartitionByRange`` samples the composite key, so a hot
  value is split by the tie-break; positions are materialised in the shared
  checkpoint folder before they are used twice.

In each, per-bucket totals form a small table (buckets x groups) that is
cumulated with a window and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

UNB = Window.unboundedPreceding
#: Bounds of all groups together up to which they are broadcast.
BOUNDS_BROADCAST = 2_000_000


def _cols(cs) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


def null_safe_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null, keeping the left key columns.
    A plain equi-join would silently drop every row whose group key is null."""
    keys = _cols(keys)
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    named = right.select(*[F.col(k).alias(f"_rk_{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_rk_{i}"))
    return left.join(named, on, how).drop(*[f"_rk_{i}" for i in range(len(keys))])


def hash_rank(df: DataFrame, hex_col: str, tie_cols, group_cols=(), name: str = "rank",
              digits: int = 4) -> DataFrame:
    """1-based row number within ``group_cols`` ordered by (hex_col, tie_cols).

    16^digits uniform buckets (65 536 by default): a class holding a third of
    10^12 rows still puts only ~5 million rows into one window partition."""
    groups, ties = _cols(group_cols), _cols(tie_cols)
    b = "_hb"
    d = df.withColumn(b, F.conv(F.substring(F.col(hex_col), 1, digits), 16, 10).cast("int"))
    local = F.row_number().over(
        Window.partitionBy(*groups, b).orderBy(F.col(hex_col), *[F.col(t) for t in ties]))
    d = d.withColumn("_local", local)
    counts = d.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("_n"))
    off = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.partitionBy(*groups).orderBy(b).rowsBetween(UNB, -1)), F.lit(0)))
    off = off.select(*groups, b, "_off")
    # buckets x groups rows; without groups it is at most 16^digits rows (65 536).
    if not groups:
        off = F.broadcast(off)
    out = null_safe_join(d, off, [*groups, b])
    return out.withColumn(name, (F.col("_off") + F.col("_local")).cast("long")).drop(b, "_local", "_off")


def prefix_sums(df: DataFrame, order_col: str, sum_cols, partition_cols=(), buckets: int = 256,
                accuracy: int = 10000, suffix: str = "_cum") -> DataFrame:
    """Inclusive cumulative sums of ``sum_cols`` ordered by ``order_col``
    (numeric, unique within ``partition_cols``)."""
    parts, sums = _cols(partition_cols), _cols(sum_cols)
    probs = [i / buckets for i in range(1, buckets)]
    bounds = df.groupBy(*parts).agg(
        F.percentile_approx(F.col(order_col).cast("double"), probs, accuracy).alias("_bounds"))
    # one row per partition group
    v = F.col(order_col).cast("double")
    few = False
    if parts:
        # a list of bounds for each group: counted, and sent to the rows where they are few
        bounds = cut_lineage(bounds)
        few = bounds.count() * buckets <= BOUNDS_BROADCAST
        d = null_safe_join(df, F.broadcast(bounds) if few else bounds, parts)
        bcol = F.col("_bounds")
    else:
        # a single list of (buckets - 1) numbers: inline it as a literal
        row = bounds.first()
        d = df
        bcol = F.array(*[F.lit(float(x)) for x in (row["_bounds"] or [])]).cast("array<double>")
    d = d.withColumn("_bk", F.size(F.filter(bcol, lambda x: x < v)))
    if parts:
        d = d.drop("_bounds")
    w = Window.partitionBy(*parts, "_bk").orderBy(order_col).rowsBetween(UNB, 0)
    for s in sums:
        d = d.withColumn(f"_l_{s}", F.sum(s).over(w))
    tot = d.groupBy(*parts, "_bk").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    wb = Window.partitionBy(*parts).orderBy("_bk").rowsBetween(UNB, -1)
    for s in sums:
        tot = tot.withColumn(f"_o_{s}", F.coalesce(F.sum(f"_t_{s}").over(wb), F.lit(0)))
    tot = tot.select(*parts, "_bk", *[f"_o_{s}" for s in sums])
    # at most ``buckets`` rows for each group
    d = null_safe_join(d, F.broadcast(tot) if few or not parts else tot, [*parts, "_bk"])
    for s in sums:
        d = d.withColumn(f"{s}{suffix}", F.col(f"_o_{s}") + F.col(f"_l_{s}"))
    return d.drop("_bk", *[f"_l_{s}" for s in sums], *[f"_o_{s}" for s in sums])


def range_rank(df: DataFrame, order_cols, group_cols=(), name: str = "rank",
               num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``group_cols`` by ``order_cols`` (the last
    order column must make the order unique).  Ascending, nulls first."""
    groups, orders = _cols(group_cols), _cols(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [*groups, *orders]
    r = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
         .withColumn("_pos", F.monotonically_increasing_id()))
    r = cut_lineage(r)
    r = r.withColumn("_pid", F.shiftright("_pos", 33))
    stats = r.groupBy(*groups, "_pid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*groups).orderBy("_pid").rowsBetween(UNB, -1)), F.lit(0)))
    stats = stats.select(*groups, "_pid", "_first", "_off")
    # at most (groups + partitions) rows; without groups, one per partition.
    if not groups:
        stats = F.broadcast(stats)
    out = null_safe_join(r, stats, [*groups, "_pid"])
    return (out.withColumn(name, (F.col("_off") + F.col("_pos") - F.col("_first") + 1).cast("long"))
            .drop("_pos", "_pid", "_first", "_off"))


def group_count(df: DataFrame, group_cols=(), name: str = "_group_n") -> DataFrame:
    """Attach the row count of each group (aggregate + join, not a window, so
    a hot group is counted with map-side partial aggregation)."""
    groups = _cols(group_cols)
    if not groups:
        n = df.count()
        return df.withColumn(name, F.lit(n).cast("long"))
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias(name))
    return null_safe_join(df, counts, groups)


def lit_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def top_k_per_group(df: DataFrame, group_cols, order: list[Column], k: int, salt_key: str,
                    name: str = "rank", salt_buckets: int = 64) -> DataFrame:
    """First ``k`` rows of each group by ``order`` (which must end in a
    unique key), ranked 1..k.  Two phases: rows are salted by a hash of
    ``salt_key`` into ``salt_buckets`` sub-groups and cut to k within each,
    so a group holding a third of the table is ranked by many tasks; the
    final ranking sees at most k * salt_buckets rows per group."""
    groups = _cols(group_cols)
    salt = F.pmod(F.xxhash64(F.col(salt_key)), F.lit(salt_buckets))
    d = df.withColumn("_salt", salt)
    d = d.withColumn("_r1", F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order)))
    d = d.where(F.col("_r1") <= k).drop("_r1", "_salt")
    d = d.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return d.where(F.col(name) <= k)


def block_windows(df: DataFrame, group_cols, rank_col: str, halo: int, block: int = 100_000) -> DataFrame:
    """Cut each group's rank sequence into blocks of ``block`` consecutive
    ranks and copy the last ``halo`` rows of every block into the next one.
    A window partitioned by (group, ``_blk``) then sees, for every own row
    (``_halo`` false), its ``halo`` predecessors -- exact lags and short
    rolling frames with bounded window partitions, even for a hot series."""
    groups = _cols(group_cols)
    r0 = F.col(rank_col) - 1
    blk = F.floor(r0 / F.lit(block)).cast("long")
    in_tail = (r0 % F.lit(block)) >= F.lit(block - halo)
    copies = F.when(in_tail, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    d = df.withColumn("_shift", F.explode(copies))
    return d.withColumn("_blk", blk + F.col("_shift")).withColumn("_halo", F.col("_shift") == 1).drop("_shift")


def running_agg(df: DataFrame, group_cols, rank_col: str, value_col: str, fn: str = "max",
                name: str | None = None, inclusive: bool = True, block: int = 100_000) -> DataFrame:
    """Running max / min / sum of ``value_col`` along a dense 1-based
    ``rank_col`` within groups, exact, with windows bounded to one block:
    local running values per block plus the exclusive total of earlier
    blocks (a small table: one row per group and block)."""
    groups = _cols(group_cols)
    name = name or f"running_{fn}_{value_col}"
    agg = {"max": F.max, "min": F.min, "sum": F.sum}[fn]
    d = df.withColumn("_blk", F.floor((F.col(rank_col) - 1) / F.lit(block)).cast("long"))
    frame_end = 0 if inclusive else -1
    w = Window.partitionBy(*groups, "_blk").orderBy(rank_col).rowsBetween(UNB, frame_end)
    d = d.withColumn("_local", agg(value_col).over(w))
    tot = d.groupBy(*groups, "_blk").agg(agg(value_col).alias("_bt"))
    tot = tot.withColumn("_prev", agg("_bt").over(
        Window.partitionBy(*groups).orderBy("_blk").rowsBetween(UNB, -1))).drop("_bt")
    d = null_safe_join(d, tot, [*groups, "_blk"])
    if fn == "sum":
        combined = F.coalesce(F.col("_prev"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
        combined = F.when(F.col("_prev").isNull() & F.col("_local").isNull(), F.lit(None)).otherwise(combined)
    else:
        pick = F.greatest if fn == "max" else F.least
        combined = pick(F.col("_prev"), F.col("_local"))  # greatest/least skip nulls
    return d.withColumn(name, combined).drop("_blk", "_local", "_prev")
