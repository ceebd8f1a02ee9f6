"""Association rules (F01-F05) over a long basket table (basket, item).

Pair counting prunes items below ``min_support`` first (a pair's support is
at most either item's), so each basket contributes pairs only among its
frequent items; pairs are counted once as a < b with map-side partial
aggregation and mirrored into both rule directions.

A basket of more than ``BASKET_BLOCK`` items is cut into blocks of items, and each
pair of its blocks is a join key of its own: a basket that holds a third of all rows is
paired by many tasks, whose partial counts add up.  Longer itemsets grow from the
shorter ones by the same joins; no basket is ever collected.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import checked_broadcast
from tessera.session import cut_lineage

#: Items of a basket that one join key pairs.
BASKET_BLOCK = 256
# Fixed value: a support or confidence below this does not divide.
LEAST = 1e-12

RULE_COLUMNS = ["antecedent", "consequent", "support", "confidence", "lift"]
BROADCAST_ITEM_LIMIT = 200_000
WIDE_ITEM_LIMIT = 10_000


def binarize_columns(df: DataFrame, cols) -> DataFrame:
    """F01 (wide form): null -> 0, > 0 -> 1, else 0."""
    return df.select(*[F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, 1).otherwise(0).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def binarize(long: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """F01 (long -> wide): one 0/1 column per distinct item.  Items are
    collected to name the columns, so the vocabulary is checked first; large
    vocabularies stay in the long form (``pair_rules`` needs no wide frame)."""
    vocab = long.select(item_col).distinct()
    n_items = vocab.count()
    if n_items > WIDE_ITEM_LIMIT:
        raise ValueError(f"{n_items} items: too many columns for a wide frame; use the long form")
    items = sorted(r[0] for r in vocab.collect())
    wide = (long.select(basket_col, item_col).distinct().groupBy(basket_col)
            .pivot(item_col, items).agg(F.count(F.lit(1))))
    return wide.select(basket_col, *[F.when(F.col(i) > 0, 1).otherwise(0).alias(i) for i in items])


def wide_to_long(df: DataFrame, basket_col: str, item_cols) -> DataFrame:
    """Wide 0/1 frame -> (basket, item) rows for the positive cells."""
    arr = F.array(*[F.when(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) > 0, F.lit(c)) for c in item_cols])
    return df.select(F.col(basket_col).alias("basket"), F.explode(arr).alias("item")).where(F.col("item").isNotNull())


def item_supports(baskets: DataFrame, n_baskets: int) -> DataFrame:
    return baskets.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).withColumn(
        "support", F.col("n_item") / F.lit(float(n_baskets)))


def _frequent(baskets: DataFrame, min_count: int) -> DataFrame:
    """Distinct (basket, item) rows whose item is in at least ``min_count`` baskets."""
    b = baskets.select("basket", "item").where(F.col("item").isNotNull() & F.col("basket").isNotNull()).distinct()
    if min_count > 1:
        freq = b.groupBy("item").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_count).select("item")
        b = b.join(checked_broadcast(freq, BROADCAST_ITEM_LIMIT), "item")
    return b


def _blocked(b: DataFrame, block: int) -> DataFrame:
    """``b`` with the number of blocks its basket is cut into (1 for most)."""
    large = (b.groupBy("basket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
             .where("blocks > 1"))
    return b.join(checked_broadcast(large), "basket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def pair_counts(baskets: DataFrame, min_count: int = 1, block: int = BASKET_BLOCK) -> DataFrame:
    """Co-occurrence counts (a, b, n_ab) with a < b over distinct
    (basket, item) rows; items rarer than ``min_count`` are pruned before
    the self-join, and baskets over ``block`` items are joined block by block."""
    return _count_pairs(_blocked(_frequent(baskets, min_count), block).withColumn("w", F.lit(1)))


def _count_pairs(b: DataFrame) -> DataFrame:
    """(a, b, n_ab) of the (basket, item, blocks, w) rows ``b``; ``w`` baskets are alike."""
    mine = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    cells = (b.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("basket", "item", "w", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")))
    left = cells.select("basket", "w", "i", "j", F.col("item").alias("a"), F.col("mine").alias("of_a"))
    right = cells.select("basket", "i", "j", F.col("item").alias("b"), F.col("mine").alias("of_b"))
    # a cell (i, j) pairs the items of its two blocks, and (i, i) those of one
    met = (F.col("i") == F.col("j")) | (F.col("of_a") != F.col("of_b"))
    return (left.join(right, ["basket", "i", "j"]).where((F.col("a") < F.col("b")) & met)
            .groupBy("a", "b").agg(F.sum("w").alias("n_ab")))


def _merged(items: DataFrame) -> DataFrame:
    """(basket, item, blocks, w): of the baskets of one block that hold the same items one
    stays, with their number; larger ones stay as they are."""
    alike = (items.where("blocks = 1").groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("held"))  # at most a block of items
             .groupBy("held").agg(F.min("basket").alias("basket"), F.count(F.lit(1)).alias("w")))
    alike = alike.select("basket", F.explode("held").alias("item"), F.lit(1).alias("blocks"), "w")
    return alike.unionByName(items.where("blocks > 1").withColumn("w", F.lit(1).cast("long")))


def pair_rules(baskets: DataFrame, basket_col: str = "basket", item_col: str = "item",
               min_support: float = 0.05, min_confidence: float = 0.2, min_lift: float = 1.0,
               max_rules: int | None = 200, n_baskets: int | None = None) -> DataFrame:
    """directed pair rules a -> b with support(ab) >= min_support,
    confidence = s(ab)/s(a) >= min_confidence, lift = confidence/s(b) >=
    min_lift; ordered by lift, confidence, support (desc) then names; the
    first ``max_rules`` kept."""
    b = baskets.select(F.col(basket_col).cast("string").alias("basket"),
                       F.col(item_col).cast("string").alias("item")).where(F.col("item").isNotNull()).distinct()
    # five consumers (counts, supports, pruning, both join sides): materialise once
    b = cut_lineage(b)
    n = n_baskets if n_baskets is not None else b.select("basket").distinct().count()
    spark = baskets.sparkSession
    if not n:
        return spark.createDataFrame([], "antecedent string, consequent string, support double, "
                                         "confidence double, lift double")
    min_count = max(1, math.ceil(min_support * n - 1e-9))
    pc = pair_counts(b, min_count=min_count)
    sup = item_supports(b, n).select("item", "support")
    # both directions of a counted pair, without counting pairs twice
    both = pc.select(F.explode(F.array(
        F.struct(F.col("a").alias("antecedent"), F.col("b").alias("consequent")),
        F.struct(F.col("b").alias("antecedent"), F.col("a").alias("consequent")))).alias("_p"), "n_ab").select("_p.*", "n_ab")
    sa = sup.select(F.col("item").alias("antecedent"), F.col("support").alias("s_a"))
    sb = sup.select(F.col("item").alias("consequent"), F.col("support").alias("s_b"))
    r = both.join(sa, "antecedent").join(sb, "consequent")
    r = r.withColumn("support", F.col("n_ab") / F.lit(float(n)))
    r = r.withColumn("confidence", F.col("support") / F.greatest(F.col("s_a"), F.lit(LEAST)))
    r = r.withColumn("lift", F.col("confidence") / F.greatest(F.col("s_b"), F.lit(LEAST)))
    r = r.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)
                & (F.col("lift") >= min_lift)).select(*RULE_COLUMNS)
    if max_rules is not None:
        r = r.orderBy(F.col("lift").desc(), F.col("confidence").desc(), F.col("support").desc(),
                      "antecedent", "consequent").limit(max_rules)
    return r


def rule_summary(rules: DataFrame) -> DataFrame:
    """rule_count, avg_confidence, avg_lift and
    rule_score = avg_confidence * avg_lift * ln(1 + rule_count); zeros when empty."""
    s = rules.agg(F.count(F.lit(1)).alias("rule_count"),
                  F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
                  F.coalesce(F.avg("lift"), F.lit(0.0)).alias("avg_lift"))
    return s.withColumn("rule_score", F.col("avg_confidence") * F.col("avg_lift") * F.log1p("rule_count"))


def itemsets(baskets: DataFrame, basket_col: str = "basket", item_col: str = "item", min_support: float = 0.05,
             max_items: int | None = None, block: int = BASKET_BLOCK) -> DataFrame:
    """(items, freq): all sets of items that at least ``min_support`` of the baskets
    hold, items sorted.

    Only items in enough baskets count, and baskets that then hold the same ones are
    merged, so the work grows with the different ones.  Level by level: the occurrences (basket, set) of the frequent sets of one length are
    joined with their basket's items behind the last, kept where that item and the last
    are a frequent pair, and counted.  The items of a large basket meet its sets under
    one of several keys, so that many tasks extend them."""
    b = cut_lineage(baskets.select(F.col(basket_col).cast("string").alias("basket"), F.col(item_col).cast("string").alias("item"))
                    .where("item is not null and basket is not null").distinct())
    n = b.select("basket").distinct().count()
    min_count = max(1, math.ceil(min_support * n - 1e-9))
    items = cut_lineage(_merged(_blocked(_frequent(b, min_count), block)))
    one = items.groupBy("item").agg(F.sum("w").alias("freq")).select(F.array("item").alias("items"), "freq")
    found = [one]
    if max_items == 1 or not n:
        return one
    pairs = cut_lineage(_count_pairs(items).where(F.col("n_ab") >= min_count))
    linked = checked_broadcast(pairs.select(F.col("a").alias("last"), F.col("b").alias("item")))
    # a large basket's items under each of its keys
    spread = items.withColumn("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("basket", "key", "item")
    now = items.select("basket", "blocks", "w", F.array("item").alias("items"), F.col("item").alias("last"))
    size = 1
    while max_items is None or size < max_items:
        size += 1
        keyed = now.withColumn("key", F.pmod(F.xxhash64("items"), F.col("blocks")).cast("int"))
        grown = (keyed.join(spread, ["basket", "key"]).where(F.col("item") > F.col("last")).join(linked, ["last", "item"])
                 .select("basket", "blocks", "w", F.concat("items", F.array("item")).alias("items"), F.col("item").alias("last")))
        kept = cut_lineage(grown.groupBy("items").agg(F.sum("w").alias("freq")).where(F.col("freq") >= min_count))
        if kept.isEmpty():
            break
        found.append(kept)
        now = cut_lineage(grown.join(checked_broadcast(kept.select("items")), "items", "left_semi").select("basket", "blocks", "w", "items", "last"))
    return functools.reduce(DataFrame.unionByName, found)


def itemset_rules(baskets: DataFrame, basket_col: str = "basket", item_col: str = "item",
                  min_support: float = 0.05, min_confidence: float = 0.2, max_items: int | None = None):
    """(frequent itemsets, rules antecedent -> one item with confidence, lift and support)."""
    b = baskets.select(F.col(basket_col).cast("string").alias("basket"), F.col(item_col).cast("string").alias("item"))
    sets = cut_lineage(itemsets(b, min_support=min_support, max_items=max_items))
    n = float(b.where("item is not null and basket is not null").select("basket").distinct().count())
    whole = sets.where(F.size("items") > 1)
    split = whole.select("freq", F.col("items").alias("_all"), F.explode("items").alias("_c")).select(
        F.array_remove("_all", F.col("_c")).alias("antecedent"), F.array("_c").alias("consequent"), "freq")
    of = lambda name, count: sets.select(F.col("items").alias(name), F.col("freq").alias(count))
    r = split.join(of("antecedent", "_na"), "antecedent").join(of("consequent", "_nc"), "consequent")
    r = r.select("antecedent", "consequent", (F.col("freq") / F.col("_na")).alias("confidence"),
                 (F.col("freq") / F.col("_na") / (F.col("_nc") / F.lit(n))).alias("lift"), (F.col("freq") / F.lit(n)).alias("support"))
    return sets, r.where(F.col("confidence") >= min_confidence)
