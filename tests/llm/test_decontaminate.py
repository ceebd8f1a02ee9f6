import itertools
import random
import re

from tessera.llm import decontaminate as D

from .conftest import frame, words


def brute(docs, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    by_text = {}
    for i, t in items:
        w = tuple(split(t))
        if len(w) >= D.MIN_WORDS:
            by_text[w] = min(i, by_text.get(w, i))
    out = {}
    for d, t in docs:
        a = split(t)
        for w, i in by_text.items():
            span, need = min(D.WINDOW, len(w)), D.WINDOW - D.TOLERANCE if len(w) >= D.WINDOW else len(w)
            for shift in range(-len(w) + 1, len(a)):
                low, high = max(0, -shift), min(len(w), len(a) - shift)
                if high - low < span:
                    continue
                agree = [w[k] == a[k + shift] for k in range(low, high)]
                starts = [k for k in range(len(agree)) if agree[k] and sum(agree[k: k + span]) >= need]
                if starts:
                    old = out.get((d, i), (0, 10**9))
                    out[d, i] = (max(old[0], sum(agree)), min(old[1], shift + low + starts[0]))
    return {(d, i, n[0], n[1]) for (d, i), n in out.items()}


def test_masks_are_lossless():
    """Wherever up to TOLERANCE substitutions fall in a window, a mask misses them."""
    for gone in itertools.combinations(range(D.WINDOW), D.TOLERANCE):
        assert any(not {o + m for m in mask} & set(gone) for mask in D.MASKS for o in range(D.WINDOW - mask[-1]))


def got(df):
    return {(r.doc_id, r.item_id, r.matched_words, r.doc_word) for r in df.collect()}


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    items = [(k, words(rng, rng.choice([6, 9, 13, 14, 20, 40]), 60)) for k in range(25)]
    items += [(90, items[3][1]), (91, "two words"), (92, None), (93, "")]
    docs = []
    for d in range(120):
        text = words(rng, rng.randrange(0, 80), 60).split()
        if d % 3 == 0:
            leak = rng.choice(items[:25])[1].split()
            a = rng.randrange(0, max(1, len(leak) - 12))
            part = leak[a:]
            for _ in range(rng.randrange(0, 4)):
                part[rng.randrange(len(part))] = "other"
            at = rng.randrange(0, len(text) + 1)
            text[at:at] = part
        docs.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    found = D.leaks(frame(spark, docs), frame(spark, items, "item_id long, text string"))
    expected = brute(docs, items)
    assert got(found) == expected
    assert len(expected) > 20


def test_shuffled_seeds_find_the_same(spark, capsys):
    """Beyond the broadcast bound positions are shuffled by seed, without the words of their documents."""
    rng = random.Random(2)
    items = [(1, words(rng, 30)), (2, words(rng, 14))]
    rows = [(1, words(rng, 10) + " " + items[0][1]), (2, words(rng, 50)), (3, words(rng, 5_000) + " " + items[1][1] + " " + items[0][1])]
    rows += [rows[0], (None, rows[0][1]), (1, items[1][1])]
    docs, bench = frame(spark, rows), frame(spark, items, "item_id long, text string")
    expected = got(D.leaks(docs, bench))
    few = D.leaks(docs, bench, broadcast_rows=0)
    assert got(few) == expected and len(expected) == 5
    few.explain("formatted")
    plan = capsys.readouterr().out
    by_seed = [x for x in plan.split("\n\n") if "hashpartitioning(seed" in x]
    assert by_seed
    for node in by_seed:
        names = node.split("Input")[1].split("\n")[0]
        assert "h#" not in names and "item_h#" not in names


def test_odd_rows(spark, odd, odd_rows, none):
    bench = frame(spark, [(1, odd_rows[0][1]), (2, None)], "item_id long, text string")
    found = D.leaks(odd, bench).collect()
    assert {r.doc_id for r in found} == {0, 5, 9, 2**40}
    assert len(found) == 4
    assert D.leaks(none, bench).count() == 0
    assert D.leaks(odd, frame(spark, [], "item_id long, text string")).count() == 0
