import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import cross_tokens as X
from tessera.llm import queries as Q

from .conftest import frame, words

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
AWKWARD = ["Hello  world. the\ncat", "  lead", "trail ", " ", "\n", "\t\ttabs <|endoftext|> x", "</s> <unk> <0x0A> <s>", "café \U0001f600\U0001f1e9\U0001f1ea é",
           "literal ▁ mark", " nbsp em", "\x00\x01 control", "don't WON'T 123456 1,000.50", "漢字かな ไทย", "a" * 3000, "x" + " " * 40 + "y", "\r\n\r\n"]


@pytest.fixture(scope="module")
def paths():
    return Q.tokenizer_path(), Q.tokenizer_path(Q.OTHER_VOCABULARY)


@pytest.fixture(scope="module")
def plain(paths):
    """Ids and ends of a text by both libraries, a whole text at a time."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    # the printable bytes stand for themselves, the others for the letters from 256 on
    printable = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    letters = {chr(x): x for x in printable} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in printable)}

    def run(text):
        if not text:
            return [], [], [], []
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        spell_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in (b.id_to_piece(i),)]
        raw = (" " + text).encode()
        if b"".join(spell_a) != raw or b"".join(spell_b) != raw:
            return [], [], [], []
        return ids_a, ids_b, list(np.cumsum([len(s) for s in spell_a])), list(np.cumsum([len(s) for s in spell_b]))
    return run


def brute(rows, plain):
    docs = [(d, *plain(t)) for d, t in rows]
    links = [[(a, b) for a, x in zip(ids_a, ends_a, strict=True) for b, y in ((ids_b[k], y) for k, y in enumerate(ends_b) if y == x)]
             for _, ids_a, ids_b, ends_a, ends_b in docs]
    count = Counter(p for one in links for p in one)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for (d, ids_a, ids_b, ends_a, ends_b), one in zip(docs, links, strict=True):
        cuts = sorted(set(ends_a) & set(ends_b))
        parts, last = [], 0
        for c in cuts:
            parts.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if last < e <= c) for ids, ends in ((ids_a, ends_a), (ids_b, ends_b))))
            last = c
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest() if ids_a else ""
        out.append((d, len(ids_a), len(ids_b), len(cuts), len(one), sum(count[p] == top[p[1]] for p in one), sum(count[p] for p in one), sha))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def texts(n, seed=1):
    rng = random.Random(seed)
    made = [words(rng, rng.randrange(0, 40)) for _ in range(n)]
    return [*AWKWARD, "", None, *made, *["".join(rng.choice("ab \n.é中") for _ in range(rng.randrange(40))) for _ in range(60)]]


@pytest.mark.parametrize("hot", [0, 5, X.HOT])
def test_equals_brute_force(spark, paths, plain, hot):
    rows = [*enumerate(texts(40)), (3, "a repeated id"), (None, "no id"), (None, "no id")]
    assert got(X.describe(frame(spark, rows).repartition(4), *paths, hot=hot)) == brute(rows, plain)


def test_merge_path_equals_plain_merge():
    rng = random.Random(2)
    for n in range(300):
        a, b = (np.array(sorted(rng.sample(range(60), rng.randrange(0, 25)))) for _ in range(2))
        if n % 3 == 0 and len(a):
            b = a.copy()
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        for step in (1, 2, 3, 7, 100):
            i, j = X.splits(a, b, step)
            for d, (x, y) in enumerate(zip(i, j, strict=True)):
                taken = merged[: min(d * step, len(merged))]
                assert (x, y) == (sum(k == 0 for _, k in taken), sum(k == 1 for _, k in taken))
            ends, of_a, of_b, both = X.overlaps(a, b, step)
            expected = [(e, int((a < e).sum()), int((b < e).sum()), e in set(a) and e in set(b)) for e in sorted({*a.tolist(), *b.tolist()})]
            assert list(zip(ends.tolist(), of_a.tolist(), of_b.tolist(), both.tolist(), strict=True)) == expected


def test_pieces_are_of_equal_work():
    a, b = np.arange(1, 100_001), np.arange(5, 100_001, 5)
    i, j = X.splits(a, b, 1000)
    work = np.diff(i) + np.diff(j)
    assert (work[:-1] == 1000).all() and work.sum() == 120_000


def test_groups_do_not_depend_on_pieces(paths):
    both = X.Pair(*paths)
    found = texts(30, 4)
    rows = [t or "" for t in found]
    whole = both.groups(rows, 1 << 20)
    for piece in (1, 3, 50):
        for x, y in zip(whole, both.groups(rows, piece), strict=True):
            assert all((p == q).all() for p, q in zip(x, y, strict=True))


def test_align_returns_ids_and_groups(spark, paths, plain):
    rows = list(enumerate(AWKWARD))
    for r in X.align(frame(spark, rows), *paths).collect():
        ids_a, ids_b, ends_a, ends_b = plain(rows[r.doc_id][1])
        a, b, size_a, size_b = (np.frombuffer(r[c], "<u4").tolist() for c in ("a_ids", "b_ids", "a_sizes", "b_sizes"))
        assert (a, b) == (ids_a, ids_b) and sum(size_a) == len(a) and sum(size_b) == len(b)
        cuts = sorted(set(ends_a) & set(ends_b))
        assert [ends_a[k - 1] for k in np.cumsum(size_a)] == cuts and [ends_b[k - 1] for k in np.cumsum(size_b)] == cuts


def test_odd_rows(spark, odd, odd_rows, none, paths, plain):
    assert got(X.describe(odd, *paths)) == brute(odd_rows, plain)
    assert got(X.describe(none, *paths)) == []
