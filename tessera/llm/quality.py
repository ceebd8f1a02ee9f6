"""Operator 7: a quality classifier from positive and unlabelled texts.

Trusted positives are labelled good texts; every unlabelled text may be either.
A linear model over measures of the whole text minimises the non-negative
unbiased risk  pi R+(P) + max(0, R-(U) - pi R-(P))  under the logistic loss.  The
class prior pi is estimated by the best bin: the smallest ratio of unlabelled to
positive texts above a threshold of a first positive-against-unlabelled model.

Measures of all texts are written once; the model is fitted on a sample bounded
by ``SAMPLE`` rows of each kind (smallest hashes of their ids), and scores are
DataFrame expressions over the written measures.  Null and empty texts get the
measures of a text without words; labels that repeat an id count once; without
positives the score is the prior 0.5 everywhere; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

#: Most positives and most unlabelled texts that the model is fitted on.
SAMPLE = 20_000
MEASURES = ("symbols", "upper", "digits", "punctuation", "loud", "bars", "repeated", "top_word", "distinct", "short_words", "word_length",
            "long_words", "adjacent", "lines_repeated", "line_length", "packed", "length", "symbol_words", "bare")
_STRANGE = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_RUNS = re.compile(r"[!?]{2,}")


def measure(text: str) -> list[float]:
    """The MEASURES of one whole text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * (len(MEASURES) - 1) + [1.0]
    counts = Counter(words)
    letters = sum(map(len, words))
    strange = len(_STRANGE.findall(text))
    lines = [x for x in text.split("\n") if x]
    adjacent = sum(map(str.__eq__, words, words[1:]))
    sizes = list(map(len, words))
    data = text.encode()
    return [strange / chars, sum(map(str.isupper, words)) / n, sum(map(text.count, "0123456789")) / chars, sum(map(text.count, ".,;:")) / n,
            len(_RUNS.findall(text)) / n, text.count("|") / n, 1 - len(counts) / n, max(counts.values()) / n, len(counts) / n,
            sum(x <= 2 for x in sizes) / n, letters / n / 10, sum(x > 20 for x in sizes) / n, adjacent / n,
            1 - len(set(lines)) / len(lines), min(chars / len(lines), 2000) / 1000, len(zlib.compress(data, 1)) / len(data),
            np.log1p(n) / 10, min(1.0, strange / n), 0.0]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                x = [measure(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<double>")


def _fit(x: np.ndarray, gradient, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Weights by Adam; ``gradient`` of the risk at the given weights."""
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among the unlabelled, from the
    scores of a model of positives against unlabelled."""
    cuts = np.quantile(positive, np.linspace(0.0, 0.9, 46))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    slack = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative risk."""
    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = positive @ w, unlabelled @ w
        as_negative_p = positive.T @ _sigmoid(zp) / len(zp)
        as_positive_p = -positive.T @ _sigmoid(-zp) / len(zp)
        as_negative_u = unlabelled.T @ _sigmoid(zu) / len(zu)
        risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        negative = as_negative_u - prior * as_negative_p
        # below zero the estimate has overfitted: step back along that part alone
        return prior * as_positive_p + negative if risk >= 0 else -negative
    return _fit(positive, gradient)


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights over raw measures with the constant last, estimated prior)."""
    both = np.concatenate([positive, unlabelled])
    # the clean bulk sets the scale; far values are cut so that one odd text does not
    mean = np.median(both, axis=0)
    scale = np.maximum(both.std(axis=0), 1e-3)
    ready = lambda x: np.hstack([np.clip((x - mean) / scale, -6, 6), np.ones((len(x), 1))])
    p, u = ready(positive), ready(unlabelled)

    def against(w: np.ndarray) -> np.ndarray:
        return (-p.T @ _sigmoid(-(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u)) / 2

    first = _fit(p, against, 300)
    prior = class_prior(p @ first, u @ first)
    return np.stack([np.append(mean, 0), np.append(scale, 1), nn_pu(p, u, prior)]), prior


def score(x: str, model: np.ndarray) -> Column:
    """Probability of good quality from the measures in column ``x``."""
    mean, scale, w = model
    z = F.lit(float(w[-1]))
    for i in range(len(mean) - 1):
        z = z + F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.get(x, F.lit(i)) - float(mean[i])) / float(scale[i]))) * float(w[i])
    return 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: Column | None = None,
             sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of every text; labels of ``held_out`` ids are never read."""
    found = materialise(measures(docs), "quality-measures")
    seen = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    train = seen.filter(~held_out) if held_out is not None else seen
    train = train.groupBy("doc_id").agg(F.min("y").alias("y"))
    mix = F.xxhash64("doc_id", F.lit(7))
    some = lambda df: np.array([r["x"] for r in df.orderBy(mix).limit(sample).collect()], dtype=np.float64)
    positive = some(found.join(train.filter("y = 1").select("doc_id"), "doc_id", "left_semi"))
    # texts without a label, and those whose label may not be read
    unlabelled = some(found.join(train.select("doc_id"), "doc_id", "left_anti"))
    if not len(positive) or not len(unlabelled):
        return found.select("doc_id", F.lit(0.5).alias("score"))
    model, _ = fit(positive, unlabelled)
    return found.select("doc_id", score("x", model).alias("score"))
