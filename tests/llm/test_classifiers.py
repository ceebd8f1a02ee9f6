import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality, toxicity
from tessera.llm import queries as Q
from tessera.session import table

SF = "/root/testdata/sf0.01"


def scored(spark, name, column, sf=SF):
    labels = table(spark, sf, "labels")
    rows = Q.queries()[name](spark, sf).join(labels, "doc_id").filter("held_out").select("score", "predicted", column).collect()
    y, p = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    return y, p, np.array([r[0] for r in rows])


def test_quality_beats_the_majority_on_held_out_labels(spark):
    y, p, s = scored(spark, "op7_positive_unlabelled", "quality")
    assert (y == p).mean() > max(y.mean(), 1 - y.mean()) + 0.05
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    y, p, _ = scored(spark, "op8_pattern_grammar", "toxic")
    assert (p[y == 0] == 0).mean() > 0.97  # clean texts are left alone
    assert p[y == 1].mean() > 0.6


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_not_read(spark, module, label):
    docs, labels = table(spark, SF, "documents").filter("doc_id < 300"), table(spark, SF, "labels").filter("doc_id < 300")
    flipped = labels.withColumn(label, F.when(Q.held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    a, b = ({r.doc_id: r.score for r in module.classify(docs, x, held_out=Q.held_out()).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd, odd_rows, none, module):
    label = "quality" if module is quality else "toxic"
    schema = f"doc_id long, {label} int"
    labels = spark.createDataFrame([(0, 1), (0, 1), (4, 0), (None, 1), (7, None), (99, 0), (2, 0)], schema)
    for y in (labels, spark.createDataFrame([], schema)):
        rows = module.classify(odd, y).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
        assert module.classify(none, y).count() == 0
    same = {r.score for r in module.classify(odd, labels).filter("doc_id = 5").collect()}
    assert len(same) == 1


def test_prior_and_non_negative_risk():
    rng = np.random.default_rng(1)
    good = lambda n: rng.normal(1.5, 1, (n, 3))
    bad = lambda n: rng.normal(-1.5, 1, (n, 3))
    positive, unlabelled = good(2000), np.concatenate([good(1400), bad(600)])
    model, prior = quality.fit(positive, unlabelled)
    assert abs(prior - 0.7) < 0.1
    mean, scale, w = model
    z = lambda x: np.hstack([np.clip((x - mean[:-1]) / scale[:-1], -6, 6), np.ones((len(x), 1))]) @ w
    assert (z(good(500)) > 0).mean() > 0.9 and (z(bad(500)) < 0).mean() > 0.9


def test_composition_equals_the_cascade():
    """The composed machine rewrites like its parts one after another."""
    rng = np.random.default_rng(2)
    base = toxicity.BASE
    one = toxicity._marker("g", "a", base)
    two = toxicity._marker("n", "n", (*base, "ia", "ta", "wa"))
    both = toxicity.compose(one, two, base)
    for _ in range(200):
        x = [base[i] for i in rng.integers(0, len(base), 20)]
        assert both.run(x) == two.run(one.run(x))


def test_clauses_decide_not_words():
    found = toxicity.Matcher({"idiot": "i", "slur*": "i"})
    names = dict(zip(toxicity.MARKED, range(len(toxicity.MARKED)), strict=True))
    marks = lambda t: {m for m, i in names.items() if found.counts(t)[i]}
    assert marks("an idiot") == {"i"}
    assert marks("you are an idiot") == {"ia"}
    assert marks("you are not an idiot") == {"ian"}
    assert marks("she said: you idiot") == {"ia"}  # the colon ends the clause
    assert marks("she said you idiot") == {"iar"}
    assert marks("You. Idiot! slurring") == {"i"}
    assert marks("I will kill you") == {"t"}
    assert marks("you I will kill") == {"ta"}
    assert marks("idiotic, a slurry") == {"i"}
    w = toxicity.prior_weights()
    score = lambda t: float((toxicity._features(np.array([found.counts(t)])) @ w)[0])
    assert score("you are an idiot") > score("an idiot") > score("not an idiot") > score("nice words")


def test_class_prior_equals_a_plain_search():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        positive = rng.normal(2, 1, 800)
        unlabelled = np.concatenate([rng.normal(2, 1, int(2000 * share)), rng.normal(-2, 1, 2000 - int(2000 * share))])
        best = None
        for q in np.linspace(0.0, 0.9, 46):
            c = float(np.quantile(positive, q))
            p = sum(x >= c for x in positive) / 800
            u = sum(x >= c for x in unlabelled) / 2000
            slack = (np.log(4 / 0.1) / 2) ** 0.5 * (1 / 800 ** 0.5 + 1 / 2000 ** 0.5)
            if best is None or (u + slack) / p < best[0]:
                best = ((u + slack) / p, u / p)
        found = quality.class_prior(positive, unlabelled)
        assert found == pytest.approx(min(0.99, max(0.05, best[1])))
        assert abs(found - share) < 0.06


def test_non_negative_risk_is_as_low_as_a_plain_search_finds():
    """One measure and a constant: the fit against all weights of a grid."""
    rng = np.random.default_rng(2)
    prior = 0.4
    ready = lambda v: np.stack([v, np.ones(len(v))], axis=1)
    p = ready(rng.normal(1.5, 1, 300))
    u = ready(np.concatenate([rng.normal(1.5, 1, 240), rng.normal(-1.5, 1, 360)]))

    def risk(w):
        loss = lambda x, y: np.log1p(np.exp(-y * (x @ w))).mean()
        return prior * loss(p, 1) + max(0.0, loss(u, -1) - prior * loss(p, -1)) + 0.5e-4 * w @ w

    least = min(risk(np.array([a, b])) for a in np.linspace(-4, 4, 81) for b in np.linspace(-4, 4, 81))
    w = quality.nn_pu(p, u, prior)
    assert risk(w) <= least + 0.01 and w[0] > 0


def test_measures_equal_plain_counts():
    text = "One two two  THREE!! a|b\nOne two two\n\nOne two two\nx: 42; " + "w" * 25
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    plain = {"upper": sum(w == w.upper() and w != w.lower() for w in words) / len(words), "digits": sum(c in "0123456789" for c in text) / len(text),
             "punctuation": sum(c in ".,;:" for c in text) / len(words), "loud": 1 / len(words), "bars": text.count("|") / len(words),
             "repeated": 1 - len(set(words)) / len(words), "top_word": max(words.count(w) for w in words) / len(words),
             "distinct": len(set(words)) / len(words), "short_words": sum(len(w) <= 2 for w in words) / len(words),
             "word_length": sum(map(len, words)) / len(words) / 10, "long_words": sum(len(w) > 20 for w in words) / len(words),
             "adjacent": sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words), "lines_repeated": 1 - len(set(lines)) / len(lines),
             "length": np.log(1 + len(words)) / 10, "bare": 0.0}
    got = dict(zip(quality.MEASURES, quality.measure(text), strict=True))
    for name, value in plain.items():
        assert got[name] == pytest.approx(value), name
    assert quality.measure("")[-1] == 1.0
