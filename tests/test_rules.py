import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators.rules import itemset_rules, itemsets, pair_counts, pair_rules, rule_summary, wide_to_long

BASKETS = {"milk": [1, 1, 0, 1, 0, 1], "bread": [1, 1, 1, 0, 1, 1], "eggs": [0, 1, 0, 0, 1, 1],
           "butter": [1, 0, 1, 1, 0, 1]}


def _wide(spark):
    rows = [(i, *[BASKETS[c][i] for c in BASKETS]) for i in range(6)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} int" for c in BASKETS))


def test_pair_rules_fixture(spark):
    long = wide_to_long(_wide(spark), "id", list(BASKETS))
    rules = {(r["antecedent"], r["consequent"]): r for r in pair_rules(long, n_baskets=6).collect()}
    r = rules[("eggs", "bread")]
    assert r["support"] == pytest.approx(3 / 6)
    assert r["confidence"] == pytest.approx(1.0)
    assert r["lift"] == pytest.approx(1.2)
    assert ("milk", "bread") not in rules or rules[("milk", "bread")]["lift"] >= 1.0
    s = rule_summary(pair_rules(long, n_baskets=6)).collect()[0]
    assert s["rule_count"] == len(rules)


def test_empty_rules_summary(spark):
    long = spark.createDataFrame([], "basket string, item string")
    s = rule_summary(pair_rules(long)).collect()[0]
    assert (s["rule_count"], s["avg_confidence"], s["avg_lift"], s["rule_score"]) == (0, 0.0, 0.0, 0.0)


def test_itemset_pairs_equal_pair_rules(spark):
    long = wide_to_long(_wide(spark), "id", list(BASKETS))
    ours = {(r["antecedent"], r["consequent"]): round(r["confidence"], 9)
            for r in pair_rules(long, min_support=0.3, min_confidence=0.2, min_lift=0.0, max_rules=None).collect()}
    _, fp = itemset_rules(long, min_support=0.3, min_confidence=0.2)
    theirs = {(r["antecedent"][0], r["consequent"][0]): round(r["confidence"], 9)
              for r in fp.where(F.size("antecedent") == 1).collect()}
    assert ours == theirs


def _hot_baskets(seed=1):
    """A basket with a third of all rows beside small ones."""
    rng = random.Random(seed)
    rows = [(f"b{k}", f"i{rng.randrange(40):02d}") for k in range(60) for _ in range(4)]
    return rows + [("hot", f"i{k:02d}") for k in range(120)] + [(None, "i01"), ("b1", None)]


def _sets(rows, least, longest=9):
    by = {}
    for b, i in rows:
        if b is not None and i is not None:
            by.setdefault(b, set()).add(i)
    count = Counter(c for items in by.values() for k in range(1, longest + 1) if k <= 2 or len(items) < 20 for c in itertools.combinations(sorted(items), k))
    return {c: n for c, n in count.items() if n >= least}


@pytest.mark.parametrize("block", [256, 7, 1])
def test_large_baskets_are_joined_in_blocks(spark, block):
    rows = _hot_baskets()
    df = spark.createDataFrame(rows, "basket string, item string").repartition(3)
    got = {(r.a, r.b): r.n_ab for r in pair_counts(df, block=block).collect()}
    assert got == {c: n for c, n in _sets(rows, 1, 2).items() if len(c) == 2}


def test_hot_basket_is_spread_over_tasks(spark):
    """No join key holds more than one pair of blocks of the hot basket."""
    import tessera.operators.rules as R
    df = spark.createDataFrame(_hot_baskets(), "basket string, item string")
    blocked = R._blocked(R._frequent(df, 1), 16)
    assert {r.basket: r.blocks for r in blocked.where("blocks > 1").select("basket", "blocks").distinct().collect()} == {"hot": 8}


@pytest.mark.parametrize("block", [256, 5])
def test_itemsets_equal_brute_force(spark, block):
    rng = random.Random(3)
    rows = [(f"b{k}", f"i{rng.randrange(8)}") for k in range(80) for _ in range(5)]
    df = spark.createDataFrame(rows, "basket string, item string")
    got = {tuple(r["items"]): r.freq for r in itemsets(df, min_support=0.1, block=block).collect()}
    assert got == _sets(rows, 8) and max(map(len, got)) >= 3
    assert {tuple(r["items"]) for r in itemsets(df, min_support=0.1, max_items=2).collect()} == {c for c in got if len(c) <= 2}
    assert itemsets(df.limit(0)).count() == 0


def test_alike_baskets_are_merged(spark, monkeypatch):
    """Baskets of the same frequent items are joined once, with their number."""
    from tessera.operators import rules as R
    rows = [(f"k{i}", x) for i in range(60) for x in ("a", "b", "c", f"rare{i}")] + [("z", "a"), ("z", "b"), ("z", None)]
    df = spark.createDataFrame(rows + rows[:7], "basket string, item string")
    merged, made = R._merged, []
    monkeypatch.setattr(R, "_merged", lambda items: made.append(merged(items)) or made[-1])
    got = {tuple(r["items"]): r.freq for r in R.itemsets(df, min_support=0.1).collect()}
    assert got == {("a",): 61, ("b",): 61, ("c",): 60, ("a", "b"): 61, ("a", "c"): 60, ("b", "c"): 60, ("a", "b", "c"): 60}
    assert {(r.item, r.w) for r in made[0].collect()} == {("a", 60), ("b", 60), ("c", 60), ("a", 1), ("b", 1)} and made[0].count() == 5
