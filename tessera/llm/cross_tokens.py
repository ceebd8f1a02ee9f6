"""Operator 13: cross-tokenizer alignment by merge-path partitioning.

A text is tokenised twice: a space and the text by a byte-level BPE vocabulary (A),
the text by a sentencepiece model that adds the space itself (B).  Both then spell
the same bytes, and the ends of their tokens are two sorted lists of byte offsets.

*Merge path.*  The lists of a batch of documents, laid end to end, are merged in
pieces of equal work: a diagonal d of the merge matrix is crossed where i ends of A
and d - i ends of B have been taken, and a binary search on each diagonal finds that
place without merging what lies before.  A piece therefore holds ``PIECE`` ends
whatever the documents' lengths, and none depends on another.  It emits the overlaps
of its tokens: one for each byte offset where a token ends, with the A and the B token
that cover the bytes before.  Where equal ends fall into two pieces, the boundary is
stitched: both overlaps are one, which closes a group.  Groups end where an A and a B
token end together.

*Counts.*  Links are the pairs of tokens that end together.  Pairs are counted inside
the tasks before they are shuffled.  A pair that makes up at least one in ``HOT`` of all
links is frequent; there are at most ``HOT`` of them, so their counts are broadcast and
looked up where the document lies.  Other pairs occur at most total / HOT times and are
joined by shuffle, without a hot key.

Null and empty texts, and texts whose A or B tokens spell other bytes than a space and
the text (a literal U+2581, say), have no tokens.  Rows are told apart by their place
in a written table, so repeated and null ids each keep their row; texts of any length
are tokenised whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import bounded, by_size, materialise

#: Token ends that one piece merges.
PIECE = 1 << 16
#: Most pairs that are looked up by broadcast.
HOT = 500_000
#: Pairs that a task holds before it gives their counts out.
COUNTED = 1_000_000
#: Bytes of words that a worker remembers for A.
CACHE_BYTES = 96_000_000

ALIGNED = "doc_id long, a_ids binary, b_ids binary, a_sizes binary, b_sizes binary"


def splits(a: np.ndarray, b: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals ``step`` apart cross the merge path of two sorted lists: ends of
    ``a`` and of ``b`` taken by then.  Of equal ends, that of ``a`` comes first."""
    d = np.append(np.arange(0, len(a) + len(b), step), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # take more of a while its next end is not behind the last of b that would be taken
        more = np.zeros(len(d), bool)
        more[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low = np.where(open_ & more, mid + 1, low)
        high = np.where(open_ & ~more, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, j0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of a piece that begins at tokens ``i0`` and ``j0``: (end, A token, B
    token, whether both end there), in order."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")  # two sorted runs
    ends, of_a = ends[order], order < len(a)
    i, j = np.cumsum(of_a), np.cumsum(~of_a)
    both = np.zeros(len(ends), bool)
    both[1:] = ends[1:] == ends[:-1]  # an end of b behind an equal one of a
    i, j = i0 + i - (of_a | both), j0 + j - ~of_a
    keep = np.append(~both[1:], True) if len(ends) else both
    return ends[keep], i[keep], j[keep], both[keep]


def overlaps(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of two lists of token ends, merged in independent pieces."""
    i, j = splits(a, b, piece)
    made = [merge_piece(a[i[k]: i[k + 1]], b[j[k]: j[k + 1]], int(i[k]), int(j[k])) for k in range(len(i) - 1)]
    for k in range(1, len(made)):
        before, now = made[k - 1], made[k]
        if len(before[0]) and len(now[0]) and before[0][-1] == now[0][0]:
            # an end of A closed the piece before, the equal end of B opens this one
            made[k - 1] = tuple(x[:-1] for x in before)
            now[1][0] -= 1
            now[3][0] = True
    return tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)


class Pair:
    """Both tokenizers of a worker, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.a = tokens.encoder(path_a, tokens.id_type(path_a), CACHE_BYTES, True)
        self.b = SentencePieceProcessor(model_file=path_b)
        self.a_bytes = tokens.token_bytes(path_a)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode()
                        for k in range(self.b.get_piece_size()) for p in (self.b.id_to_piece(k),)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text by A and B; none if either spells other bytes."""
        out = []
        for t, a, b in zip(texts, self.a.encode_spaced(texts), self.b.encode(texts, num_threads=1), strict=True):
            ids_a, ids_b = np.frombuffer(a, self.a.dtype).astype(np.int64), np.array(b, np.int64)
            raw = (" " + t).encode()
            same = t and all(b"".join(map(spell.__getitem__, ids.tolist())) == raw for spell, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b)))
            out.append((ids_a, ids_b) if same else (ids_a[:0], ids_b[:0]))
        return out

    def groups(self, texts: list[str], piece: int = PIECE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(A ids, B ids, A tokens of each group, B tokens of each group) of each text."""
        ids = self.encode(texts)
        all_a, all_b = (np.concatenate([x[k] for x in ids]) if ids else np.zeros(0, np.int64) for k in (0, 1))
        # texts one behind another: the last ends of a text fall together
        _, i, j, both = overlaps(np.cumsum(self.a_sizes[all_a]), np.cumsum(self.b_sizes[all_b]), piece)
        end_a, end_b = i[both] + 1, j[both] + 1
        size_a, size_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        cuts = np.searchsorted(end_a, np.cumsum([len(x[0]) for x in ids]), side="right")
        out, at = [], 0
        for (a, b), cut in zip(ids, cuts.tolist(), strict=True):
            out.append((a, b, size_a[at: cut], size_b[at: cut]))
            at = cut
        return out


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _aligned(path_a: str, path_b: str) -> Run:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in batches:
            for part in by_size(batch):
                found = both.groups([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[k].astype("<u4").tobytes() for x in found], pa.binary()) for k in range(4)]],
                                                 names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])
    return run


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, a_sizes, b_sizes): the ids of every text by both
    vocabularies and how many of each form a group, as little-endian unsigned 32-bit
    integers."""
    return _narrow(docs, id_col, text_col).mapInArrow(_aligned(path_a, path_b), ALIGNED)


@lru_cache(maxsize=1)
def _decimals(upto: int) -> list[bytes]:
    """The decimal of each id before each separator."""
    return [b"%d%c" % (i, c) for i in range(upto) for c in b",|;"]


def written(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, decimals: list[bytes]) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    at_a = np.arange(len(a)) + np.repeat(end_b - size_b, size_a)
    at_b = np.arange(len(b)) + np.repeat(end_a, size_b)
    codes = np.empty(len(a) + len(b), np.int64)
    codes[at_a], codes[at_b] = a * 3, b * 3
    codes[at_a[end_a - 1]] += 1
    codes[at_b[end_b - 1]] += 2
    return b"".join(map(decimals.__getitem__, codes.tolist()))[:-1]


FACTS = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, counts binary"


def _described(width: int, ids: int) -> Run:
    """Aligned rows to their counts, digest and distinct pairs (A id * width + B id);
    ``ids`` is above every id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for binary in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                a, b, size_a, size_b = (np.frombuffer(x, "<u4").astype(np.int64) for x in binary)
                sha, codes, counts = "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(a):
                    sha = hashlib.sha256(written(a, b, size_a, size_b, _decimals(ids))).hexdigest()
                    codes, counts = np.unique(a[np.cumsum(size_a) - 1] * width + b[np.cumsum(size_b) - 1], return_counts=True)
                rows.append((row, len(a), len(b), len(size_a), sha, codes.astype("<u8").tobytes(), counts.astype("<u4").tobytes()))
                row += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([columns[0], batch.column(0), *columns[1:]],
                                             names=["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts"])
    return run


def _added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes with their counts added up."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pairs, counts) of documents to (pair, n), added up within the task."""
    codes, counts, held = [], [], 0

    def given(c: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes.append(np.frombuffer(p, "<i8"))
            counts.append(np.frombuffer(n, "<u4"))
            held += len(codes[-1])
            if held > 2 * COUNTED:
                c, n = _added(codes, counts)
                codes, counts, held = [c], [n], len(c)
                if held > COUNTED:
                    yield given(c, n)
                    codes, counts, held = [], [], 0
    yield given(*_added(codes, counts))


def pair_counts(facts: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): how many links hold each pair, and whether its B id has no pair of more."""
    pairs = materialise(facts.filter("n_groups > 0").select("pairs", "counts").mapInArrow(_pair_counts, "pair long, n long")
                        .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b = (F.col("pair") % width).alias("b")
    top = pairs.groupBy(b).agg(F.max("n").alias("top"))
    # a row for each id of B at most
    return pairs.withColumn("b", b).join(bounded(top, width), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


LOOKED = "row long, pair long, n long, count_sum long, n_best long"


def _look_up(table) -> Run:  # noqa: ANN001
    """Documents' sums over the frequent pairs, and a row for each other pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = table.value
        for batch in batches:
            for part in by_size(batch, 1):
                row, codes, counts = part.column(0).to_numpy(), [], []
                for p, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    codes.append(np.frombuffer(p, "<i8"))
                    counts.append(np.frombuffer(n, "<u4"))
                owner = np.repeat(np.arange(len(row)), list(map(len, codes)))
                code, n = np.concatenate(codes), np.concatenate(counts).astype(np.int64)
                at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                hot = known[at] == code if len(known) else np.zeros(len(code), bool)
                total, top = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
                np.add.at(total, owner[hot], n[hot] * count[at[hot]])
                np.add.at(top, owner[hot], n[hot] * best[at[hot]])
                cold = np.nonzero(~hot)[0]
                zeros = np.zeros(len(cold), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([row, row[owner[cold]]])), pa.array(np.concatenate([np.zeros(len(row), np.int64), code[cold]]), mask=np.arange(len(row) + len(cold)) < len(row)),
                    pa.array(np.concatenate([np.zeros(len(row), np.int64), n[cold]])), pa.array(np.concatenate([total, zeros])), pa.array(np.concatenate([top, zeros])),
                ], names=["row", "pair", "n", "count_sum", "n_best"])
    return run


def describe(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    from sentencepiece import SentencePieceProcessor

    spark = docs.sparkSession
    width = SentencePieceProcessor(model_file=path_b).get_piece_size()
    aligned, described = _aligned(path_a, path_b), _described(width, max(width, tokens.shape(path_a)[0]))
    facts = materialise(_narrow(docs, id_col, text_col).mapInArrow(lambda batches: described(aligned(batches)), FACTS), "token-facts")
    pairs = materialise(pair_counts(facts, width), "pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most ``hot`` pairs
    often = pairs.filter(F.col("n") * hot >= total).toArrow() if hot else None
    known = [c.to_numpy().astype(np.int64) for c in often.columns] if often is not None else [np.zeros(0, np.int64)] * 3
    order = np.argsort(known[0])
    table = spark.sparkContext.broadcast([c[order] for c in known])
    looked = materialise(facts.filter("n_groups > 0").select("row", "pairs", "counts").mapInArrow(_look_up(table), LOOKED), "pair-sums")
    rare = looked.filter("pair is not null").select("row", "pair", F.col("n").alias("times")).join(pairs, "pair")
    parts = looked.filter("pair is null").select("row", "count_sum", "n_best").unionByName(
        rare.select("row", (F.col("times") * F.col("n")).alias("count_sum"), F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best")))
    sums = parts.groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    return (facts.join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256"))
