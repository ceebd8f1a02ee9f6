import hashlib
import random

import xxhash

from pyspark.sql import functions as F
from tessera.llm import fingerprint as P
from tessera.llm import queries as Q

from .conftest import frame, words


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def spark_xxhash64(*values):
    """Spark's xxhash64: each value is hashed with the hash so far as its seed."""
    h = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % 2**64).to_bytes(8, "little")
        h = xxhash.xxh64_intdigest(data, seed=h)
    return signed(h)


def brute(text):
    w = [spark_xxhash64(x) for x in (text or "").lower().split()]
    if not w:
        return ""
    if len(w) < P.SHINGLE:
        shingles = [spark_xxhash64(" ".join(map(str, w)))]
    else:
        shingles = [spark_xxhash64(*w[i: i + P.SHINGLE]) for i in range(len(w) - P.SHINGLE + 1)]
    full = {}
    for s in shingles:
        v = (s % 2**64) >> 1
        full[v >> P._LOW] = min(v, full.get(v >> P._LOW, v))
    out = []
    for i in range(P.BINS):
        if i not in full:
            start, step = P._probe(i)
            j = min(full, key=lambda j: ((j - start) * step) % P.BINS)
        else:
            j = i
        out.append(full[j] & 255)
    return bytes(out).hex()


def jaccard(a, b, n=5):
    def sh(t):
        w = (t or "").lower().split()
        return {tuple(w[i: i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    x, y = sh(a), sh(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def prints(df):
    return [r.out for r in P.with_fingerprint(df, "text", "bins").select(P.as_hex(F.col("bins")).alias("out")).collect()]


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [words(rng, n) for n in (1, 4, 5, 6, 9, 30, 130, 700, 5000)] + ["", None, "  "]
    df = frame(spark, list(enumerate(texts))).coalesce(1)
    assert prints(df) == [brute(t) for t in texts]


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        a = words(rng, 250, 10**6).split()
        b = list(a)
        for _ in range(k // 3):
            b[rng.randrange(len(b))] = "other"
        rows.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "text string, t2 string")
    df = P.with_fingerprint(P.with_fingerprint(df, "text", "a"), "t2", "b")
    err = [r.near - jaccard(r.text, r.t2) for r in df.select("text", "t2", P.likeness("a", "b").alias("near")).collect()]
    assert max(map(abs, err)) < 0.2
    assert (sum(e * e for e in err) / len(err)) ** 0.5 < 0.06
    assert abs(sum(err) / len(err)) < 0.03


def check(rows, found):
    order = sorted(rows, key=lambda r: r[0])
    by = {r.doc_id: r for r in found}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute(t), brute(edited))
        if brute(t) == brute(after):
            assert r.near_next == 1.0


def query(spark, rows, tmp_path, name):
    folder = str(tmp_path / name)
    frame(spark, rows).repartition(4).withColumn("bins", F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    return Q.queries()["op3_fingerprint"](spark, folder).collect()


def test_query_across_runs(spark, tmp_path, monkeypatch):
    """Neighbours are found across runs, the last document's is the first."""
    monkeypatch.setattr(P.with_next, "__defaults__", ("next_", 7))
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 60)
    rows = [(d, words(rng, rng.randrange(0, 60))) for d in ids] + [(-1, None), (10**9, ""), (10**9 + 1, "é" * 9)]
    found = query(spark, rows, tmp_path, "many")
    assert len(found) == len(rows)
    check(rows, found)


def test_odd_rows(spark, odd, odd_rows, tmp_path):
    folder = str(tmp_path / "odd")
    odd.write.parquet(f"{folder}/documents.parquet")
    found = Q.queries()["op3_fingerprint"](spark, folder).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(str(d) for d, _ in odd_rows)
    texts = {d: t for d, t in odd_rows if d is not None}
    assert all(r.fingerprint == brute(texts[r.doc_id]) for r in found if r.doc_id is not None)
    one = query(spark, [(5, "a b c d e f g h")], tmp_path, "one")
    assert len(one) == 1 and one[0].near_next == 1.0
    assert query(spark, [], tmp_path, "none") == []
