"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def _checksum(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): the smallest id of the component of every node of ``edges``.

    Large-star and small-star steps hang every node under the smallest neighbour
    it knows until the edges stop changing, so a chain of n nodes takes a number
    of rounds logarithmic in n, and the result is always converged.  Each round
    is two aggregations and two joins; lineage is cut in the shared checkpoint
    folder.  Nodes without edges do not appear.
    """
    now = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    mark = _checksum(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = cut_lineage(small)
        after = _checksum(now)
        if after == mark:
            break
        mark = after
    under = now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    tops = under.select(F.col("label").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return under.unionByName(tops)
