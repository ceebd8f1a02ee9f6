"""Operator 10: best-two-fit packing of documents into training sequences.

A document's ids and the end id form one piece; only a longer one is cut, into
pieces of the full length of which the first may be shorter.  Packing depends
on lengths alone, and there are at most ``capacity`` of them, so the driver
packs the *histogram*: best-two-fit fills a bin greedily with the longest
pieces that fit, then replaces the shortest by the two unpacked pieces that fill
the widened gap most tightly.  The next bin comes out the same for as long as
its lengths last, so equal bins are made at once and each pattern uses up at
least one length.  Pieces then take their places by their rank among pieces of
their length; no piece passes through the driver.

Null texts are empty documents (the end id alone); a null doc_id is a key like
any other; repeated rows are packed as often as they occur; an empty table
gives no sequences.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import bounded, materialise

CAPACITY = 1024
PIECES = "doc_id long, piece long, start long, length long, ids binary, part long, nth long"
PLACED = "doc_id long, piece long, start long, length long, ids binary, sequence_id long, offset long"


def best_two_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces in a bin}, bins) that use up ``histogram``."""
    left = {n: c for n, c in histogram.items() if c}
    lengths = sorted(left)
    made = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def free(n: int) -> int:
            return left[n] - used.get(n, 0)

        def longest(most: int, start: int | None = None) -> int | None:
            """Index of the longest length up to ``most`` of which a piece is unpacked."""
            i = bisect_right(lengths, most) - 1 if start is None else start
            while i >= 0 and (lengths[i] > most or not free(lengths[i])):
                i -= 1
            return i if i >= 0 else None

        while gap and (i := longest(gap)) is not None:
            n = lengths[i]
            k = min(free(n), gap // n)
            used[n] = used.get(n, 0) + k
            gap -= k * n
        if gap and sum(used.values()) > 1:
            small = min(used)
            used[small] -= 1
            room, best = gap + small, (small, None)
            low = 0
            high = longest(room)
            # two pointers over the lengths: the pair of unpacked pieces with the largest sum within the room
            while high is not None and low <= high:
                a, b = lengths[low], lengths[high]
                if not free(a):
                    low += 1
                elif not free(b) or a + b > room:
                    high -= 1
                elif a == b and free(a) < 2:
                    break
                else:
                    if a + b > best[0]:
                        best = (a + b, (a, b))
                    low += 1
            for n in best[1] or (small,):
                used[n] = used.get(n, 0) + 1
            used = {n: k for n, k in used.items() if k}
        bins = min(left[n] // k for n, k in used.items())
        made.append((used, bins))
        for n, k in used.items():
            left[n] -= k * bins
            if not left[n]:
                lengths.remove(n)
    return made


def places(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces a bin, offset): pieces of
    a length take ranks from 0 on, pattern after pattern."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for used, bins in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            k = used[n]
            rows.append((n, taken.get(n, 0), sequence, k, offset))
            taken[n] = taken.get(n, 0) + k * bins
            offset += k * n
        sequence += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _pieces(tokenizer: str, end_id: int, capacity: int, cache_bytes: int):
    dtype = tokens.id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end = tokens.encoder(tokenizer, dtype, cache_bytes), np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        seen = [0] * (capacity + 1)
        for batch in batches:
            for keys, texts in tokens.keyed(batch):
                rows = []
                for key, ids in zip(keys, enc.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // width
                    cut, k = (n - 1) % capacity + 1 if n > capacity else n, 0
                    at, upto = 0, cut
                    while at < n:
                        length = upto - at
                        rows.append((key, k, at, length, ids[at * width: upto * width], part, seen[length]))
                        seen[length] += 1
                        at, upto, k = upto, upto + capacity, k + 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate([*columns[:5], *columns[5:]])],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, *, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text", cache_bytes: int = tokens.CACHE_BYTES) -> DataFrame:
    """One row for each piece: (doc_id, piece, start, length, ids, sequence_id,
    offset); ``ids`` are little-endian unsigned 32-bit.  A worker remembers the ids of
    words up to ``cache_bytes``."""
    spark = docs.sparkSession
    dtype = tokens.id_type(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # part and nth number the pieces of a length; the written table fixes both
    pieces = materialise(rows.mapInArrow(_pieces(tokenizer, end_id, capacity, cache_bytes), PIECES), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    table = spark.sparkContext.broadcast(places(best_two_fit(by_length, capacity)))
    # at most one row for each part within a length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = (pieces.join(bounded(shifts, counts.count()), ["part", "length"])
              .select("doc_id", "piece", "start", "length", "ids", (F.col("base") + F.col("nth")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, per_bin, offset = table.value.T if len(table.value) else np.zeros((5, 0), np.int64)
        keys = (length << 44) + first
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            i = np.searchsorted(keys, (n << 44) + rank, side="right") - 1
            bin_, slot = np.divmod(rank - first[i], per_bin[i])
            wide = [np.frombuffer(b.as_py(), dtype).astype("<u4").tobytes() for b in batch.column(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(wide, pa.binary()), pa.array(sequence[i] + bin_), pa.array(offset[i] + slot * n)],
                names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PLACED)
