"""Operator 12: exact top-k search by aggregating sorted lists without random access.

The integer components of the vectors are the lists: one for each dimension and
block of vectors, sorted by value and written once.  A query reads a list from its
high end where its own component is positive and from its low end where it is
negative, so that what it reads falls steadily.

*Bounds.*  After a round of reading, a vector's unread entries of a list are worth
at most what was read last (the frontier) and at least the list's far end.  The sum
over all lists bounds its score from above and below, for all vectors and queries of
a round at once.  A query's k-th best lower bound, or score of an earlier block,
rules out every vector whose upper bound stays below it.  A query stops reading when
the vectors never ruled out are few, or the lists end; their scores are then resolved
in full, ties kept.  Nothing is estimated: the result is that of comparing all pairs.

*Spread.*  Vectors are dealt into cells of a few blocks and queries into groups; each
(group, cell) is a task's work of bounded size, whatever the tables' sizes.  A cell
gives its k best for each query, of which the last step keeps k.

Components are floor(scale * x) with x as double.  Vectors that are null, or hold null
or non-finite components, take no part, nor do those with a component of 2**28 or more
after scaling, whose products no longer add up in a long.  A shorter vector counts as
padded with zeros.  Rows are told apart by their place in a written table: a vector
may repeat an id, and only the query's own row is no candidate of it.  A null id is no
query; as a candidate it ranks behind all ids of its score.  Copies of a vector tie and
rank by id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise

SCALE, EVERY, K = 256, 50, 5
#: Vectors of a block, blocks of a cell on average, and queries of a group and of a pass over a block.
BLOCK, CELL_BLOCKS, GROUP, PASS = 2_048, 4, 4_096, 256
#: Shares of the lists read by the end of each round.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)
#: Share of a pass's pairs that may be left when reading stops.
FEW = 0.01
#: Components must stay below this.
MOST = 1 << 28

LISTS = "block long, n int, rows binary, ids binary, nulls binary, values binary, orders binary"
ASKED = "pack long, n int, rows binary, ids binary, vectors binary"


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale < float(MOST)))
    return F.when(vector.isNotNull() & fit, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _dense(lists: pa.Array, dims: int) -> np.ndarray:
    """Rows of integers, padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _sorted_lists(dims: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, id, integers) to blocks: every dimension's values in descending order, and
    whose they are."""
    def block(number: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        x = _dense(t.column(2).chunk(0), dims)
        order = np.argsort(-x, axis=0, kind="stable")
        ids = t.column(1)
        return pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([len(x)], pa.int32()),
            pa.array([t.column(0).to_numpy().astype("<i8").tobytes()]),
            pa.array([ids.fill_null(0).to_numpy().astype("<i8").tobytes()]), pa.array([np.asarray(ids.is_null()).astype("u1").tobytes()]),
            pa.array([np.take_along_axis(x, order, 0).T.astype("<i4").tobytes()]), pa.array([order.T.astype("<u2").tobytes()]),
        ], names=["block", "n", "rows", "ids", "nulls", "values", "orders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - n))
                n += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if n == size:
                    yield block(number, held)
                    number, held, n = number + 1, [], 0
        if n:
            yield block(number, held)
    return run


def _packs(dims: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, id, integers) of queries to packs of at most ``size``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([part.num_rows], pa.int32()), pa.array([part.column(0).to_numpy().astype("<i8").tobytes()]),
                    pa.array([part.column(1).to_numpy().astype("<i8").tobytes()]), pa.array([_dense(part.column(2), dims).astype("<i4").tobytes()]),
                ], names=["pack", "n", "rows", "ids", "vectors"])
                number += 1
    return run


class Block:
    """The sorted lists of some vectors, read from both ends."""

    def __init__(self, dims: int, n: int, rows: bytes, ids: bytes, nulls: bytes, values: bytes, orders: bytes):
        self.n = n
        self.rows, self.ids, self.nulls = np.frombuffer(rows, "<i8"), np.frombuffer(ids, "<i8"), np.frombuffer(nulls, "u1")
        self.values = np.frombuffer(values, "<i4").reshape(dims, n).astype(np.int64)
        self.orders = np.frombuffer(orders, "<u2").reshape(dims, n).astype(np.int64)
        self.low, self.high = self.values[:, -1], self.values[:, 0]
        self.read = 0
        lists = np.arange(dims)[:, None]
        # entry of each vector in each list as known from the high end, and from the low end
        self.above = np.zeros((dims, n), np.int64)
        self.below = np.zeros((dims, n), np.int64)
        self.seen_above, self.seen_below = np.zeros((dims, n), bool), np.zeros((dims, n), bool)
        self.lists = lists

    def advance(self, upto: int) -> None:
        """Read every list on, from either end, up to ``upto`` entries."""
        if upto <= self.read:
            return
        head = self.orders[:, self.read: upto]
        self.above[self.lists, head], self.seen_above[self.lists, head] = self.values[:, self.read: upto], True
        a, b = self.n - upto, self.n - self.read
        tail = self.orders[:, a: b]
        self.below[self.lists, tail], self.seen_below[self.lists, tail] = self.values[:, a: b], True
        self.read = upto

    def known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest value of each entry as read from the high end, and from the low end."""
        last, first = self.values[:, self.read - 1, None], self.values[:, self.n - self.read, None]
        return (np.where(self.seen_above, self.above, self.low[:, None]), np.where(self.seen_above, self.above, last),
                np.where(self.seen_below, self.below, first), np.where(self.seen_below, self.below, self.high[:, None]))

    def vectors(self) -> np.ndarray:
        """All entries, once the survivors' scores are resolved."""
        out = np.empty((self.n, len(self.values)), np.int64)
        np.put_along_axis(out, self.orders.T, self.values.T, 0)
        return out


def _kind(largest: int) -> type:
    """A type whose sums up to ``largest`` are exact: products of small integers are
    added by the float routines, which are much faster."""
    return np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64


def candidates(block: Block, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Pairs (query, vector) that reading the lists does not rule out, and the share
    of the lists read.  ``own`` is a query's own place in the block or -1, ``floor``
    a score that k other vectors are known to reach."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    largest = int(np.abs(queries).sum(axis=1).max(initial=0)) * int(max(np.abs(block.low).max(initial=0), np.abs(block.high).max(initial=0)))
    kind = _kind(largest)
    q = np.hstack([up, down]).astype(kind)
    floor = floor.copy()
    mine = np.nonzero(own >= 0)[0]
    alive = np.arange(len(queries))  # queries still reading
    found: list[tuple[np.ndarray, np.ndarray]] = []
    share = 0.0
    for depth in DEPTHS:
        # a block may have been read further for other queries
        block.advance(max(block.read, 1, round(block.n * depth)))
        share = block.read / block.n
        a_low, a_high, b_low, b_high = block.known()
        # a positive component reads from the high end, a negative one from the low end
        best = q[alive] @ np.vstack([a_high, b_low]).astype(kind)
        worst = q[alive] @ np.vstack([a_low, b_high]).astype(kind)
        here = {int(i): j for j, i in enumerate(alive)}
        for i in mine:
            if int(i) in here:
                best[here[int(i)], own[i]] = worst[here[int(i)], own[i]] = -largest - 1 if kind is np.int64 else -np.inf
        if block.n >= k:
            kth = np.partition(worst, block.n - k, axis=1)[:, block.n - k]
            floor[alive] = np.maximum(floor[alive], np.where(np.isfinite(kth), kth, -np.inf))
        left = best >= floor[alive][:, None]
        n = left.sum(axis=1)
        stop = (n <= max(k, FEW * block.n)) if block.read < block.n else np.ones(len(alive), bool)
        if stop.any():
            i, j = np.nonzero(left[stop])
            found.append((alive[stop][i], j))
        alive = alive[~stop]
        if not len(alive):
            break
    pairs = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
    other = pairs[1] != own[pairs[0]]
    return pairs[0][other], pairs[1][other], share


def resolve(queries: np.ndarray, vectors: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 50_000) -> np.ndarray:
    """The scores of pairs."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), step):
        out[a: a + step] = np.einsum("ij,ij->i", queries[i[a: a + step]], vectors[j[a: a + step]])
    return out


def _best(i: np.ndarray, score: np.ndarray, null: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, queries in order."""
    order = np.lexsort((row, ids, null, -score, i))
    q = i[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def search_cell(dims: int, k: int, step: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a cell for each query of a group."""
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("null_id", pa.int32()), ("place", pa.int64()), ("score", pa.int64())])

    def run(cell: pa.Table, group: pa.Table) -> pa.Table:
        if not cell.num_rows or not group.num_rows:
            return schema.empty_table()
        packs = sorted(group.select(["pack", "n", "rows", "ids", "vectors"]).to_pylist(), key=lambda r: r["pack"])
        rows = np.concatenate([np.frombuffer(r["rows"], "<i8") for r in packs])
        ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in packs])
        queries = np.vstack([np.frombuffer(r["vectors"], "<i4").reshape(r["n"], dims) for r in packs]).astype(np.int64)
        floor = np.full(len(rows), -np.inf)
        held = [np.zeros(0, np.int64)] * 5  # query, score, null id, id, row of the best so far
        for r in sorted(range(cell.num_rows), key=lambda r: cell.column("block")[r].as_py()):
            block = Block(dims, *[cell.column(c)[r].as_py() for c in ("n", "rows", "ids", "nulls", "values", "orders")])
            vectors = None
            place = {int(x): n for n, x in enumerate(block.rows)}
            own = np.array([place.get(int(x), -1) for x in rows])
            new = [held]
            for a in range(0, len(rows), step):
                i, j, _ = candidates(block, queries[a: a + step], own[a: a + step], k, floor[a: a + step])
                if vectors is None:
                    vectors = block.vectors()
                new.append([i + a, resolve(queries[a: a + step], vectors, i, j), block.nulls[j].astype(np.int64), block.ids[j], block.rows[j]])
            held = [np.concatenate(x) for x in zip(*new, strict=True)]
            keep = _best(*held, k)
            held = [x[keep] for x in held]
            # the k-th score so far is a floor for the blocks to come
            n = np.bincount(held[0], minlength=len(rows))
            last = np.cumsum(n) - 1
            floor[n >= k] = held[1][last[n >= k]]
        i, score, null, vec, row = held
        return pa.Table.from_arrays([pa.array(rows[i]), pa.array(ids[i]), pa.array(vec, mask=null > 0), pa.array(null.astype(np.int32)), pa.array(row), pa.array(score)], schema=schema)
    return run


def search(vectors: DataFrame, *, every: int = EVERY, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding",
           block: int = BLOCK, cell_blocks: int = CELL_BLOCKS, group: int = GROUP, step: int = PASS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of
    each row whose id is divisible by ``every`` with all other rows, ties by smaller
    id.  ``score`` is a long, ``rank`` counts from 1.  A task compares about ``group``
    queries, ``step`` at a time, with ``cell_blocks`` blocks of at most ``block`` vectors."""
    spark = vectors.sparkSession
    x = F.col(vector_col)
    dealt = (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), integers(x, scale).alias("x"))
             .filter("x is not null"))
    rows = materialise(dealt, "search-rows")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"), F.count(F.when(F.col("id") % every == 0, 1)).alias("asked")).first()
    dims, cells, groups = max(1, facts["dims"] or 0), -(-facts["n"] // (block * cell_blocks)) or 1, -(-facts["asked"] // group) or 1
    lists = materialise(rows.mapInArrow(_sorted_lists(dims, block), LISTS), "search-lists")
    asked = materialise(rows.filter(F.col("id") % every == 0).mapInArrow(_packs(dims, step), ASKED), "search-queries")
    left = (lists.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = (asked.withColumn("group", F.pmod(F.xxhash64("pack"), F.lit(groups)).cast("int"))
             .withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))))
    # a task for each cell and group
    tasks = min(cells * groups, max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) * 16)
    left, right = (d.repartition(tasks, "cell", "group") for d in (left, right))
    found = left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInArrow(
        search_cell(dims, k, step), "row long, query_id long, vec_id long, null_id int, place long, score long")
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "null_id", "vec_id", "place")  # k rows of each cell
    return (found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search_sql(every: int = EVERY, k: int = K, scale: int = SCALE) -> str:
    """DuckDB: every query against every row."""
    return f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
p AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rn <> c.rn WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}
"""
