"""Operator 4: shards by balanced label propagation.

Documents that share a group are linked (a star around the group, never all
pairs).  Linked documents start without a shard, and the whole quota is room; in
each round Spark joins the links with the shards, counts each group by shard, and
a document asks for the shard that holds most of its neighbours and has room.
Requests are admitted up to the room that the shard's quota leaves, whole
neighbourhoods and large ones first, so groups gather and no shard grows over its
share.  Groups over the quota are placed before all others.  Once all have a
shard, rounds go on for as long as more neighbours come together.  So groups are
split only if they are over the quota, or if no shard had room for all of one when
its turn came: this is greedy, not an optimal packing.  Documents without links
then fill what is left, which makes the sizes exact: row counts at most one apart.

Groups may hold any share of the rows: they are counted with partial sums and
numbered by many tasks.  A null text belongs to no group; equal texts, empty ones
included, form one; repeated rows are rows of their own; an empty table gives no
rows; a null id is kept.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dense_position, materialise

SHARDS = 8


def _quota(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _best(scores: list[Column], allowed: list[Column], space: list[Column], tie: Column) -> Column:
    """The allowed shard with the highest score, then the most space; ties go by an
    order that all documents of a group share."""
    k = len(scores)
    keyed = [F.when(a, F.struct(s.alias("score"), w.alias("space"), F.pmod(F.lit(i) + tie, F.lit(k)).alias("turn"), F.lit(i).alias("shard")))
             for i, (s, a, w) in enumerate(zip(scores, allowed, space, strict=True))]
    return F.array_max(F.array(*keyed)).getField("shard")


def propagate(links: DataFrame, quota: list[int]) -> DataFrame:
    """Shards of the linked nodes: (node, shard).

    ``links`` has one row for each (node, group) that a node belongs to; ``quota``
    is the most rows each shard may hold, in all at least the number of nodes.
    """
    shards = len(quota)
    state = materialise(links.select("node").distinct().withColumn("shard", F.lit(None).cast("int")), "shards")
    kept, most = state, -1
    while True:
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        waiting = load.pop(None, 0)
        room = [q - load.get(s, 0) for s, q in enumerate(quota)]
        held = links.join(state, "node").groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[
            F.sum(F.col("shard").eqNullSafe(F.lit(s)).cast("long")).alias(f"n{s}") for s in range(shards)])
        scores = (links.join(held, "group").groupBy("node")
                  .agg(F.sum("n").alias("total"), *[F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)], F.min("group").alias("group")))
        own = [F.col("shard").eqNullSafe(F.lit(s)) for s in range(shards)]
        # a shard that has room for all the neighbours it lacks, if there is one, or for some
        counts = [F.col(f"n{s}") for s in range(shards)]
        fits = [F.lit(room[s]) >= F.col("total") - counts[s] for s in range(shards)]
        allowed = [own[s] | F.when(F.col("whole"), fits[s]).otherwise(F.lit(room[s] > 0)) for s in range(shards)]
        # what has to be split goes to few shards
        lacking = F.col("total") - sum(counts[1:], counts[0])
        space = [F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.least(F.lit(room[s]).cast("long"), lacking)) for s in range(shards)]
        turn = F.pmod(F.xxhash64("group"), F.lit(shards))
        near = sum((F.when(own[s], counts[s]).otherwise(0) for s in range(1, shards)), F.when(own[0], counts[0]).otherwise(0))
        joined = scores.join(state, "node").withColumn("whole", reduce(or_, fits))
        asked = materialise(joined.select("node", "group", "shard", "total", "whole", near.alias("near"),
                                          _best(counts, allowed, space, turn).alias("to")), "shard-requests")
        wants = asked.filter(~F.col("to").eqNullSafe(F.col("shard"))).select("node", "group", "shard", "to", "whole", (-F.col("total")).alias("small"))
        if waiting:
            wants = wants.filter("shard is null")
            over = wants.filter(F.col("small") < -max(quota))
            wants = wants if over.isEmpty() else over
        else:
            together = asked.agg(F.sum("near")).first()[0] or 0
            if together <= most:
                return kept
            kept, most = state, together
        n_wants = {r["to"]: r["n"] for r in wants.groupBy("to").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not n_wants:
            return kept
        if any(n > room[s] for s, n in n_wants.items()):
            # large neighbourhoods first; what fits as a whole is not admitted in part
            limit = F.element_at(F.create_map(*[F.lit(x) for s in range(shards) for x in (s, max(0, room[s]))]), F.col("to"))
            placed = materialise(dense_position(wants, ["to"], ["small", "group", "node"], "place", "shard-places"), "shard-places")
            ends = placed.groupBy("to", "group").agg(F.max("place").alias("end"))
            wants = placed.join(ends, ["to", "group"]).filter(F.when(F.col("whole"), F.col("end")).otherwise(F.col("place")) < limit)
            if waiting and wants.isEmpty():  # neighbourhoods that overlap can bar each other
                wants = placed.filter(F.col("place") < limit)
        moves = materialise(wants.select("node", "to"), "shard-moves")
        if moves.isEmpty():
            return kept
        state = materialise(asked.select("node", "shard").join(moves, "node", "left")
                            .select("node", F.coalesce("to", "shard").alias("shard")), "shards")


def _fill(position: Column, room: list[int]) -> Column:
    """The shard whose stretch of ``room`` a position falls into."""
    out, start = F.lit(len(room) - 1), sum(room)
    for s in reversed(range(len(room))):
        start -= room[s]
        out = F.when(position < start + room[s], F.lit(s)).otherwise(out)
    return out


def shard_rows(nodes: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``nodes`` (column ``node``, unique) with ``shard`` and ``slot``, the gapless
    place in the shard.  Row counts of the shards are at most one apart."""
    total = nodes.count()
    quota = _quota(total, shards)
    kept = propagate(links, quota)
    load = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = [q - load.get(s, 0) for s, q in enumerate(quota)]
    rest = nodes.select("node").join(kept.select("node"), "node", "left_anti").withColumn("any", F.lit(0))
    filled = (dense_position(rest.withColumn("mix", F.xxhash64("node")), ["any"], ["mix", "node"], "place", "shard-fill")
              .select("node", _fill(F.col("place"), room).alias("shard")))
    placed = dense_position(kept.unionByName(filled), ["shard"], ["node"], "slot", "shard-slots")
    return nodes.join(placed, "node")


def text_nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents as (node, doc_id, size, text_crc32) and the links of equal texts;
    ``node`` numbers the rows, so repeated ids stay apart."""
    text = F.col(text_col).cast("string")
    facts = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.md5(text).alias("key"), F.lit(0).alias("any"))
    nodes = materialise(dense_position(facts, ["any"], ["doc_id", "key"], "node", "shard-nodes").drop("any"), "shard-nodes")
    groups = (nodes.filter("key is not null").groupBy("key", "text_crc32", "size")
              .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("group")).filter("n > 1"))
    links = materialise(nodes.join(groups, ["key", "text_crc32", "size"]).select("node", "group"), "shard-links")
    return nodes.drop("key"), links
