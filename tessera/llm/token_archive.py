"""Operator 5: token ids in a canonical, length-limited Huffman archive.

``write_token_archive`` encodes every text, counts ids over the whole corpus,
builds one code and writes blocks of whole documents in ascending id order:

``code``    id, bits.  Canonical: codes ascend by (bits, id).
``blocks``  segment, block, first (ids of the segment before the block), doc_id[], n_ids[],
            payload (the codes, high bit first), lanes[] (bit offset of every
            ``LANE``-th id).  A block decodes alone, from any of its lanes.
``segments`` segment, start (ids of all segments before it).

Texts are tokenised once; ids stay in 16 bits where the vocabulary allows.  The
code table is bounded by the vocabulary, segments by the number of partitions.
Null texts are empty documents (the end id alone); a null doc_id comes first;
rows that repeat a doc_id stay rows of their own; an empty table gives an empty
archive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import materialise

#: Ids after which a block is closed at the next document's end.
BLOCK = 1 << 16
#: Ids between two checkpoints of a block.
LANE = 256
#: No code is longer; a vocabulary of more than 2**MAX_BITS ids needs more.
MAX_BITS = 16

RAW = "segment long, block long, first long, doc_id array<long>, n_ids array<long>, ids binary"
BLOCKS = "segment long, block long, first long, doc_id array<long>, n_ids array<long>, payload binary, lanes array<long>"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive ``counts``
    (package-merge)."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    # each level holds the sorted weights of leaves and pairs of the level below; is_leaf marks the leaves
    levels = []
    weights = leaves
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([leaves, pairs])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        weights = merged[rank]
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    lengths[:take] += 1
    out = np.empty(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The codes of ``ids`` that are sorted by (bits, id)."""
    longest = int(bits.max()) if len(bits) else 0
    steps = np.left_shift(np.int64(1), longest - bits.astype(np.int64))
    return (np.cumsum(steps) - steps) >> (longest - bits)


class Code:
    """Encoding and decoding tables of one canonical code."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.codes = canonical(self.ids, self.bits)
        self.longest = int(self.bits.max()) if len(bits) else 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every LANE-th id."""
        if not hasattr(self, "by_id"):
            top = int(self.ids.max()) + 1
            self.by_id, self.code_of = np.zeros(top, np.int64), np.zeros(top, np.int64)
            self.by_id[self.ids], self.code_of[self.ids] = self.bits, self.codes
        n = self.by_id[ids]
        ends = np.cumsum(n)
        at = ends - n
        total = int(ends[-1]) if len(ids) else 0
        byte, bit = at >> 3, at & 7
        word = self.code_of[ids] << (32 - bit - n)  # a code reaches at most 4 bytes: 25 bits and less
        size = (total + 7) // 8 + 4
        out = np.zeros(size, dtype=np.float64)
        for k in range(4):
            part = (word >> (24 - 8 * k)) & 255
            out += np.bincount(byte + k, weights=part, minlength=size)  # bits do not overlap, so sums are ors
        return out.astype(np.uint8)[: (total + 7) // 8].tobytes(), at[::LANE]

    def decode(self, payload: np.ndarray, at: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Ids from bit ``at[i]`` on, ``steps[i]`` of them, for all lanes i at once:
        a table gives the id and length for the next ``longest`` bits."""
        if not hasattr(self, "symbol"):
            spans = np.left_shift(1, self.longest - self.bits)
            # an id and the length of its code as one number
            self.symbol = np.ones(1 << self.longest, np.int64 if len(self.ids) and self.ids.max() >> 26 else np.uint32)
            self.symbol[: int(spans.sum())] = np.repeat(self.ids << 6 | self.bits, spans)
        wide = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        order = np.argsort(-steps, kind="stable")  # lanes that end early drop off the tail
        pos, left = at[order].astype(np.int64), steps[order]
        most = int(left[0]) if len(left) else 0
        out = np.zeros((most, len(pos)), np.uint32)
        mask, shift = (1 << self.longest) - 1, 32 - self.longest
        alive = len(pos)
        for k in range(most):
            while alive and left[alive - 1] <= k:
                alive -= 1
            p = pos[:alive]
            found = self.symbol[(window[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask]
            out[k, :alive] = found >> 6
            p += found & 63
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return out.T[back][np.arange(most) < steps[:, None]]


def _raw_blocks(path: str, end_id: int, block: int):
    """Arrow batches of (doc_id, text), sorted, to raw blocks of one segment."""
    dtype = tokens.id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId()
        enc, end = tokens.encoder(path, dtype), np.array([end_id], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        number = first = held = 0
        docs: list = []
        sizes: list[int] = []
        ids: list[bytes] = []

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([segment], pa.int64()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                 pa.array([b"".join(ids)], pa.binary())], names=["segment", "block", "first", "doc_id", "n_ids", "ids"])

        for batch in batches:
            for keys, part in tokens.keyed(batch):
                for k, b in zip(keys, enc.encode(part), strict=True):
                    b += end
                    docs.append(k)
                    sizes.append(len(b) // width)
                    ids.append(b)
                    held += len(b) // width
                    if held >= block:
                        yield closed()
                        number, first, held, docs, sizes, ids = number + 1, first + held, 0, [], [], []
        if docs:
            yield closed()

    return run


def write_token_archive(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id",
                        text_col: str = "text", block: int = BLOCK, max_bits: int = MAX_BITS) -> None:
    """Encode every text of ``docs`` and write the archive below ``path``."""
    spark = docs.sparkSession
    dtype = tokens.id_type(tokenizer)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = materialise(ordered.mapInArrow(_raw_blocks(tokenizer, end_id, block), RAW), "token-blocks")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for b in batch.column(0):
                part = np.bincount(np.frombuffer(b.as_py(), dtype))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    # at most one row for each id of the vocabulary
    counts = raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    ids = np.array([r["id"] for r in counts], np.int64)
    bits = code_lengths(np.array([r["n"] for r in counts], np.int64), max_bits)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id long, bits int").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((ids, bits))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Code(*code.value)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                payload, lanes = table.encode(np.frombuffer(one.column(5)[0].as_py(), dtype).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*one.columns[:5], pa.array([payload], pa.binary()), pa.array([lanes], pa.list_(pa.int64()))],
                    names=["segment", "block", "first", "doc_id", "n_ids", "payload", "lanes"])

    raw.mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")
    # one row for each segment, and there are as many as shuffle partitions
    sizes = (spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
             .groupBy("segment").agg(F.sum(F.aggregate("n_ids", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
             .orderBy("segment").collect())
    starts, at = [], 0
    for r in sizes:
        starts.append((r["segment"], at))
        at += r["n"]
    spark.createDataFrame(starts, "segment long, start long").coalesce(1).write.parquet(f"{path}/segments")


def read_token_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) of an archive; ``ids`` are
    little-endian unsigned 32-bit, ``start`` counts the ids of all rows before."""
    table = spark.read.schema("id long, bits int").parquet(f"{path}/code").collect()  # bounded by the vocabulary
    code = spark.sparkContext.broadcast((np.array([r["id"] for r in table], np.int64), np.array([r["bits"] for r in table], np.int64)))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Code(*code.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 16):
                rows = batch.slice(a, 16).to_pylist()
                payloads = [np.frombuffer(r["payload"], np.uint8) for r in rows]
                base = np.cumsum([0] + [len(p) for p in payloads])
                at, steps = [], []
                for r, b in zip(rows, base.tolist(), strict=False):
                    total = sum(r["n_ids"])
                    lanes = np.array(r["lanes"], np.int64)
                    at.append(lanes + 8 * b)
                    steps.append(np.minimum(LANE, total - LANE * np.arange(len(lanes))))
                ids = by.decode(np.concatenate(payloads), np.concatenate(at), np.concatenate(steps)).astype("<u4")
                docs, starts, sizes, out, segments, k = [], [], [], [], [], 0
                for r in rows:
                    start = r["first"]
                    for d, n in zip(r["doc_id"], r["n_ids"], strict=True):
                        segments.append(r["segment"])
                        docs.append(d)
                        starts.append(start)
                        sizes.append(n)
                        out.append(ids[k: k + n].tobytes())
                        start += n
                        k += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segments, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], names=["segment", "doc_id", "first", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(decode, "segment long, doc_id long, first long, n_tokens long, ids binary")
    starts = spark.read.schema("segment long, start long").parquet(f"{path}/segments")
    return (rows.join(F.broadcast(starts), "segment")  # as many rows as the writer had partitions
            .select("doc_id", (F.col("start") + F.col("first")).alias("start"), "n_tokens", "ids"))
