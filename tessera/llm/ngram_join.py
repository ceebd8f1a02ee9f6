"""Operator 2: n-gram Jaccard join by partitioning the universe of shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches
``num / den``.  The join is exact:

*Sets.*  Equal sets form a class and join once, by their smallest id.

*Signatures.*  Sets of a size band (a factor of two) deal their shingles by hash
into m segments.  Similar sets of sizes up to s differ in at most
H = s (den - num) / num shingles.  d segments are indexed with their one-deletion
neighbourhood: they match unless they differ in two places or more.  If none
matches, the other m - d segments hold at most H - 2d differences, so of those
that agree the one with the best priority (most shingles, then smallest hash:
a matter of its contents alone) is among the first H - 2d + 1 of either set.
Indexing just these finds every pair and skips poor segments.  m and d are those
of least cost, given how many sets the band holds.  A set near the lower end of
its band is indexed under the band below too.

*Links.*  Sets that share a signature are candidates, but a bucket is never
expanded into all its pairs: each set is compared with the smallest id of one
bucket, then with the set of each bucket that has the fewest shingles of its own,
which gathers copies; only pairs of a bucket that this left in different
components are compared, and only if neither the shingles they share with other
components at all nor the sizes of their classes of shingles rule a link out.  Buckets too large for a task are compared in
blocks.  Components come from pointer jumping and alternating stars; nothing of
them passes through the driver.

Shingles are compared by 64-bit hashes, classes by 128 bits.  Null and empty texts
have no shingles and link with nothing; a null id links with nothing; texts that
share an id count as linked; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, materialise

NGRAM, NUM, DEN = 4, 85, 100
#: Words whose hashes one worker remembers, and sets it knows to have indexed.
CACHE_WORDS, CACHE_SETS = 100_000, 200_000
#: Chance that two unrelated sets share a given shingle, for the cost of a segment.
SHARED = 0.02
#: Classes of shingles whose counts bound an overlap, and the most that a count says.  Few
#: shingles to a class, or sets that differ too much have much the same counts.
CLASSES, FULL = 512, 255
#: Sets of a bucket that one task compares at most; larger ones are cut into blocks.
BLOCK = 4_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sorted, distinct shingle hashes of a text."""

    def __init__(self, n: int):
        self.n, self.words = n, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.zeros(0, _U)
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        h = np.array(list(map(self.words.__getitem__, words)), _U)
        k = min(self.n, len(h))
        out = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            out = (out + h[i: len(h) - k + 1 + i]) * _U(0x9E3779B97F4A7C15)
            out ^= out >> _U(29)
        return np.unique(_mix(out + _U(k)))


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def most_different(size: int, num: int = NUM, den: int = DEN) -> int:
    """The most shingles in which a set of ``size`` differs from one it links with."""
    return size * (den - num) // num


def allocate(band: int, sets: int, num: int = NUM, den: int = DEN) -> tuple[int, int]:
    """(segments m, one-deletion segments d) of least cost for sets of 2**band up
    to 2**(band + 1), of which there are ``sets``."""
    largest = (1 << (band + 1)) * den // num
    size, differ = 1.5 * (1 << band), most_different(largest, num, den)
    typical = most_different(int(size), num, den)
    best = None
    for d in range(0, (differ + 1) // 2 + 1):
        need = max(0, differ - 2 * d + 1)
        # spare segments let a set pass over its poorest
        for others in {need, need + math.ceil(need * 0.3)} if need else {0}:
            m = d + others
            if not m:
                continue
            c = size / m
            plain = max(0, typical - 2 * d + 1)
            rows = plain + d * (1 + c)
            wrong = plain * SHARED ** c + d * ((1 + c) * SHARED ** max(c - 1, 0))
            cost = rows + 0.05 * sets * wrong
            if best is None or cost < best[0]:
                best = (cost, m, d)
    return best[1], best[2]


def signatures(shingles: np.ndarray, band: int, m: int, d: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The signatures of a set under the allocation of a band."""
    segment = ((shingles >> _U(17)) % _U(m)).astype(np.int64)
    mixed = _mix(shingles ^ _U(0xA5A5A5A5A5A5A5A5))
    total, count = np.zeros(m, _U), np.bincount(segment, minlength=m)
    np.add.at(total, segment, mixed)
    place = _mix(np.arange(m, dtype=_U) + _U((band + 1) << 32))
    own = _mix(total + place + count.astype(_U))
    out = [own[:d]]
    if d:
        first = segment < d
        s = segment[first]
        out.append(_mix(total[s] - mixed[first] + place[s] + (count[s] - 1).astype(_U)))
    plain = max(0, most_different(len(shingles), num, den) - 2 * d + 1)
    if plain:
        rest, key = own[d:], (_U(255) - np.minimum(count[d:], 255).astype(_U) << _U(56)) | (own[d:] >> _U(8))
        out.append(rest if plain >= len(rest) else rest[np.argpartition(key, plain - 1)[:plain]])
    return np.unique(np.concatenate(out))


def schemes(size: int, num: int = NUM, den: int = DEN) -> list[int]:
    """The bands that a set of ``size`` is indexed under."""
    band = size.bit_length() - 1
    # a partner of the band below has fewer than 2**band shingles and at least size * num / den
    below = band and size * num < (1 << band) * den
    return [band, band - 1] if below else [band]


def _facts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                sizes, digests = [], []
                for t in part.column(1):
                    x = shingle(t.as_py())
                    sizes.append(len(x))
                    digests.append(digest(x))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())],
                                                 names=["doc_id", "n_shingles", "digest"])
    return run


def _index(n: int, plan: dict[int, tuple[int, int]], num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(n), set()
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids, rows = [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    x = shingle(t.as_py())
                    if not len(x):
                        continue
                    key = digest(x)
                    if key in seen:  # a copy: the first of this task stands for it
                        continue
                    if len(seen) < CACHE_SETS:
                        seen.add(key)
                    for band in schemes(len(x), num, den):
                        rows.append(signatures(x, band, *plan[band], num, den))
                        ids.append(np.full(len(rows[-1]), k, np.int64))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows).view(np.int64)), pa.array(np.concatenate(ids))],
                                                     names=["sig", "doc_id"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sig, doc_id), those whose signature has two ids or more."""
    sig, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened = False  # the carried row's signature has been found shared
    for batch in batches:
        if not batch.num_rows:
            continue
        new_sig, new_ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        carried = len(sig)
        sig, ids = np.concatenate([sig, new_sig]), np.concatenate([ids, new_ids])
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
        sig, ids = sig[fresh], ids[fresh]
        same = sig[1:] == sig[:-1]
        shared = np.zeros(len(sig), bool)
        shared[1:] |= same
        shared[:-1] |= same
        keep = shared.copy()
        if carried and opened:
            keep[0] = False  # given out already
        # the last row stays behind: what follows may share its signature
        last_opened = bool(shared[-1]) or (opened and len(sig) == 1 and carried > 0)
        out_sig, out_ids = sig[keep], ids[keep]
        sig, ids, opened = sig[-1:], ids[-1:], last_opened
        if len(out_sig):
            yield pa.RecordBatch.from_arrays([pa.array(out_sig), pa.array(out_ids)], names=["sig", "doc_id"])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                sets = [shingle(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "set"])
    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(a) > len(b):
                    a, b = b, a
                if len(a) * den < len(b) * num:
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                ok[i] = both * den >= (len(a) + len(b) - both) * num
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])
    return run


def verified(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ``edges`` whose sets are similar."""
    left, right = sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    rows = edges.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return rows.mapInArrow(_verify(num, den), "a long, b long").distinct()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, set) to distinct (shingle, comp), both cut to 32 bits."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            comps = part.column(0).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x.as_buffer(), _U) for x in part.column(1)]
            if not sets:
                continue
            low = np.concatenate([(x >> _U(32)).astype(np.uint32) for x in sets]).view(np.int32)
            comp = np.repeat((_mix(comps.astype(_U)) >> _U(32)).astype(np.uint32), [len(x) for x in sets]).view(np.int32)
            both = np.unique((low.astype(np.int64) << 32) | comp.astype(np.int64) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)), pa.array((both & 0xFFFFFFFF).astype(np.uint32).view(np.int32))],
                                             names=["token", "comp"])


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, set) to (rep, token), a row for each shingle."""
    for batch in batches:
        for a in range(0, batch.num_rows, 500):
            part = batch.slice(a, 500)
            sets = [np.frombuffer(x.as_buffer(), _U) for x in part.column(1)]
            if sets:
                reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in sets])
                low = np.concatenate([(x >> _U(32)).astype(np.uint32) for x in sets]).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(low)], names=["rep", "token"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, set) to (rep, sketch): how many shingles each of CLASSES classes holds."""
    for batch in batches:
        out = []
        for x in batch.column(1):
            at = (np.frombuffer(x.as_buffer(), _U) % _U(CLASSES)).astype(np.int64)
            out.append(np.minimum(np.bincount(at, minlength=CLASSES), FULL).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "sketch"])


def _cross(num: int, den: int):
    """Rows sorted by cell (sig, i, j): pairs of different components, one of
    block i and one of block j, that could be similar: neither the shingles they
    share with other components nor the counts of their classes rule it out."""
    def pairs(rows: np.ndarray, sketch: np.ndarray, i: int, j: int) -> np.ndarray:
        rep, comp, n, c, block = rows.T
        out = []
        first = np.flatnonzero(block == i)
        second = first if i == j else np.flatnonzero(block == j)
        for k, x in enumerate(first):
            y = second[k + 1:] if i == j else second
            most = np.minimum(c[x], c[y])
            ok = (comp[y] != comp[x]) & (most * den >= (n[x] + n[y] - most) * num)
            hit = y[ok]
            if len(hit):
                least = np.minimum(sketch[x], sketch[hit])
                both = least.sum(axis=1, dtype=np.int64)
                if np.maximum(n[x], n[hit]).max() >= FULL:  # a class may be full in both, and then says nothing
                    both = np.where((least == FULL).any(axis=1), n[hit], both)
                hit = hit[both * den >= (n[x] + n[hit] - both) * num]
            if len(hit):
                out.append(np.stack([np.minimum(rep[x], rep[hit]), np.maximum(rep[x], rep[hit])], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def given(found: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        def closed() -> np.ndarray:
            return pairs(np.concatenate([r for r, _ in held]), np.concatenate([s for _, s in held]), key[1], key[2])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)], axis=1)
            sketch = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, CLASSES)
            cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist(), len(rows)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                now = tuple(rows[a, :3])
                if now != key and held:
                    found = closed()
                    held = []
                    if len(found):
                        yield given(found)
                key = now
                held.append((rows[a:b, 3:], sketch[a:b]))
        if held:
            found = closed()
            if len(found):
                yield given(found)
    return run


def _same(a: DataFrame, b: DataFrame) -> bool:
    sums = [df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for df in (a, b)]
    return sums[0] == sums[1]


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b), by
    alternating large and small stars until nothing changes."""
    edges = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        after = materialise(small, "links")
        if _same(edges, after):
            return after.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        edges = after


def roots(parents: DataFrame) -> DataFrame:
    """(node, label) from (node, parent) with parent < node, by pointer jumping."""
    now = materialise(parents.select("node", F.col("parent").alias("label")), "roots")
    while True:
        up = now.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = materialise(now.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")), "roots")
        now = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return now


def join(docs: DataFrame, *, n: int = NGRAM, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, class_id (smallest id of an
    equal set), component_id."""
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must be over 1/2, so that partners are in neighbouring bands")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    facts = materialise(rows.mapInArrow(_facts(n), "doc_id long, n_shingles long, digest binary"), "join-facts")
    linked = facts.filter("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("size"))
    member = materialise(linked.select("doc_id", "digest").distinct().join(classes, "digest").select("doc_id", "rep", "size"), "join-members")
    # at most 64 bands
    bands = {r["band"]: r["n"] for r in member.filter("doc_id = rep").groupBy(F.floor(F.log2(F.col("size"))).cast("int").alias("band"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = {b: allocate(b, bands.get(b, 0), num, den) for b in range(max(bands, default=0) + 2)}
    index = rows.filter("doc_id is not null and text is not null").mapInArrow(_index(n, plan, num, den), "sig long, doc_id long")
    buckets = materialise(index.repartition("sig").sortWithinPartitions("sig", "doc_id").mapInArrow(_shared, "sig long, doc_id long"), "join-buckets")
    named = materialise(buckets.join(member, "doc_id").select("sig", "rep", "size").distinct(), "join-named")
    hubs = named.groupBy("sig").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last").select("sig", "hub")
    starred = named.join(hubs, "sig")
    # each set against the hub it shares most signatures with
    best = (starred.filter("rep <> hub").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("rep").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("best"))
            .select(F.col("rep").alias("b"), (-F.col("best.hub")).alias("a")))
    best = materialise(best, "join-stars")
    # every set of a shared bucket, also one that is the hub of all its buckets and that no set picked
    wanted = materialise(starred.select(F.col("rep").alias("doc_id")).distinct(), "join-wanted")
    sets = materialise(rows.join(bounded(wanted, wanted.count()), "doc_id", "left_semi").mapInArrow(_sets(n), "rep long, set binary")
                       .dropDuplicates(["rep", "set"]), "join-sets")
    label = roots(verified(best, sets, num, den).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    # what the stars left apart
    placed = (starred.select("sig", "rep", "size").join(label.withColumnRenamed("node", "rep"), "rep", "left")
              .select("sig", "rep", "size", F.coalesce("label", "rep").alias("comp")))
    apart = placed.groupBy("sig").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("sig")
    left = materialise(placed.join(apart, "sig"), "join-apart")
    nodes = materialise(left.select("rep", "size", "comp").distinct(), "join-open")
    held = sets.join(nodes.select("rep", "comp"), "rep")
    tokens = (held.select("comp", "set").mapInArrow(_tokens, "token int, comp int").groupBy("token")
              .agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("token"))
    # shingles that some other component has: an upper bound of any overlap
    able = materialise(held.select("rep", "set").mapInArrow(_token_rows, "rep long, token int").join(tokens, "token", "left_semi")
                       .groupBy("rep").agg(F.count(F.lit(1)).alias("c")).join(nodes, "rep").filter(F.col("c") * den >= F.col("size") * num), "join-able")
    rest = materialise(left.select("sig", "rep").join(able, "rep"), "join-rest")
    of = label.select("node", "label")
    top = lambda c: (of.withColumnRenamed("node", c).withColumnRenamed("label", f"{c}_top"))

    def between(links: DataFrame) -> DataFrame:
        """Links as pairs of the stars' components."""
        return (links.join(top("a"), "a", "left").join(top("b"), "b", "left")
                .select(F.coalesce("a_top", "a").alias("a"), F.coalesce("b_top", "b").alias("b")).filter("a <> b"))

    # each bucket's set with the smallest share of shingles of its own is the likeliest original: all others against it
    mid = rest.groupBy("sig").agg(
        F.max(F.struct((F.col("c") / F.col("size")).alias("share"), (-F.col("rep")).alias("hub"), "comp", "size", "c")).alias("hub"),
        F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("sig", "hub")
    most = F.least("c", "hub.c")
    closer = (rest.join(mid, "sig").filter(F.col("comp") != F.col("hub.comp"))
              .filter(most * den >= (F.col("size") + F.col("hub.size") - most) * num)
              .select(F.col("rep").alias("b"), (-F.col("hub.hub")).alias("a")).distinct())
    gathered = materialise(verified(materialise(closer, "join-stars"), sets, num, den), "join-links")
    merged = components(between(gathered)).select(F.col("node").alias("comp"), "label")
    rest = materialise(rest.join(merged, "comp", "left").withColumn("comp", F.coalesce("label", "comp")).drop("label"), "join-rest")
    blocks = rest.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    sketch = sets.join(able.select("rep"), "rep").mapInArrow(_sketches, "rep long, sketch binary")
    cells = (rest.join(blocks.select("sig", "blocks"), "sig").join(sketch, "rep").withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "comp", "size", "c", "block", "sketch"))
    pairs = (cells.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
             .mapInArrow(_cross(num, den), "a long, b long").distinct())
    links = gathered.unionByName(verified(materialise(pairs, "join-pairs"), sets, num, den))
    # texts that share an id are one document
    same_id = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("a", "b")
    merged = components(between(links.unionByName(same_id)))
    final = member.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    final = (final.join(of.select(F.col("node").alias("class_id"), "label"), "class_id", "left").withColumn("mid", F.coalesce("label", "class_id"))
             .join(merged.select(F.col("node").alias("mid"), F.col("label").alias("last")), "mid", "left")
             .select("doc_id", "class_id", F.coalesce("last", "mid").alias("component_id")))
    return (facts.select("doc_id", "n_shingles").join(final, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id")))
