"""Operator 8: toxicity by a weighted finite-state pattern grammar.

The words of a clause become symbols (insult, weak insult, threat, target,
negation, reported speech, other), and a cascade of transducers rewrites them: one marks insults and
threats within reach of a target, one those in the scope of a negation, one those
in reported speech.  ``compose`` multiplies the cascade out into a single machine
that reads every clause once.  A text's score weighs its marked matches; a word
alone has no score of its own outside its clause.

Insults are learned: words and word beginnings that texts labelled toxic have and
others lack, picked greedily by the toxic texts that no other explains (or one
other, for frequent ones), so that words which copies merely share are not taken up.  The weights of marked matches
are fitted by logistic regression that is drawn to the prior weights below.  Both
use a sample of labelled texts bounded by ``SAMPLE``.

Null and empty texts have no matches and get the base score; labels that repeat an
id count once; without labels the prior weights and the fixed word lists remain;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import by_size, materialise

#: Most labelled texts of either class that patterns and weights are learned from.
SAMPLE = 6_000
#: Most patterns considered, those in most toxic texts first.
CANDIDATES = 5_000
#: Patterns that a task counts before it gives the counts out; the shuffle adds them up.
COUNTED = 60_000
#: Share of clean texts that may hold an insult, and a weak one, relative to the share of toxic ones.
IMPURITY, WEAK_IMPURITY = 0.02, 0.25
#: Shortest word beginning that may be a pattern.
STEM = 4
#: Word lists of the grammar.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile")
THREATS = ("kill", "murder", "hurt", "destroy", "stab", "shoot", "strangle", "beat")
TARGETS = ("you", "your", "he", "she", "they", "them", "those", "people", "du", "ihr", "tu", "vous", "usted", "ustedes")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "nicht", "kein", "keine", "ne", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "calls", "wrote", "quoted", "claimed", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")
#: Words after a target, negation or report within which it bears on a match.
REACH = {"a": 5, "n": 3, "r": 8}
#: Prior weights: the constant, a match, and what each mark adds.
PRIOR = {"base": -4.0, "i": 5.0, "t": 2.5, "w": 1.0, "a": 1.5, "n": -2.5, "r": -1.5}

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")


class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbol)."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def run(self, symbols: list[str]) -> list[str]:
        state, out, arcs = self.start, [], self.arcs
        for x in symbols:
            state, y = arcs[state, x]
            out.append(y)
        return out


#: Symbols: a match carries its marks in the order a, n, r.
BASE = ("o", "i", "t", "w", "g", "n", "r")
MARKED = tuple(m + "".join(c for c, on in zip("anr", marks, strict=True) if on) for m in "itw" for marks in product((0, 1), repeat=3))


def _marker(trigger: str, mark: str, alphabet: tuple[str, ...]) -> Transducer:
    """Marks matches within reach after ``trigger``; the state counts down."""
    reach = REACH[mark]
    arcs = {}
    for state, x in product(range(reach + 1), alphabet):
        match = x[0] in "itw"
        arcs[state, x] = (reach if x == trigger else max(0, state - 1), x + mark if match and state else x)
    return Transducer(0, arcs)


def compose(first: Transducer, second: Transducer, alphabet: tuple[str, ...]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``."""
    start = (first.start, second.start)
    arcs, todo = {}, [start]
    seen = {start}
    while todo:
        state = todo.pop()
        for x in alphabet:
            a, y = first.arcs[state[0], x]
            b, z = second.arcs[state[1], y]
            arcs[state, x] = ((a, b), z)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(start, arcs)


def grammar() -> Transducer:
    """Target, negation and reported-speech markers as one machine."""
    aimed = _marker("g", "a", BASE)
    after_aimed = (*BASE, "ia", "ta", "wa")
    negated = compose(aimed, _marker("n", "n", after_aimed), BASE)
    after_negated = (*after_aimed, "in", "tn", "wn", "ian", "tan", "wan")
    return compose(negated, _marker("r", "r", after_negated), BASE)


class Matcher:
    """Counts the marked matches of a text. Patterns ending in * are beginnings."""

    def __init__(self, insults: dict[str, str]):
        whole = {w: x for w, x in insults.items() if not w.endswith("*")}
        stems = sorted((w[:-1] for w in insults if w.endswith("*")), key=lambda w: (-len(w), w))
        self.symbol = {**dict.fromkeys(TARGETS, "g"), **dict.fromkeys(NEGATIONS, "n"), **dict.fromkeys(REPORTS, "r"),
                       **dict.fromkeys(THREATS, "t"), **whole}
        self.stems, self.by_stem = tuple(stems), {w: insults[w + "*"] for w in stems}
        # one scan tells whether a text has any match
        words = "|".join(map(re.escape, sorted({*whole, *THREATS})))
        begin = "|".join(map(re.escape, stems))
        self.any = re.compile(rf"\b(?:(?:{words})\b" + (rf"|(?:{begin})" if begin else "") + ")")
        self.machine = grammar()

    def _symbol(self, word: str) -> str:
        if word in self.symbol:
            return self.symbol[word]
        if word.startswith(self.stems):  # false for no stems
            return next(self.by_stem[s] for s in self.stems if word.startswith(s))
        return "o"

    def counts(self, text: str) -> list[int]:
        out = dict.fromkeys(MARKED, 0)
        low = text.lower()
        at = 0
        while (m := self.any.search(low, at)) is not None:
            # the clause around the match
            left = max(low.rfind(c, 0, m.start()) for c in ".!?;:\n") + 1
            end = _CLAUSE.search(low, m.end())
            right = end.start() if end else len(low)
            words = _WORD.findall(low, max(left, at), right)
            marked = self.machine.run(list(map(self._symbol, words)))
            for x in marked:
                if x in out:
                    out[x] += 1
            at = max(right, m.end())
        return [out[x] for x in MARKED]


def _features(counts: np.ndarray) -> np.ndarray:
    """Matches of each marking, each with less weight the more there are, and a constant."""
    return np.hstack([np.log2(1 + np.asarray(counts, dtype=np.float64)), np.ones((len(counts), 1))])


def prior_weights() -> np.ndarray:
    return np.array([PRIOR[x[0]] + sum(PRIOR[c] for c in x[1:]) for x in MARKED] + [PRIOR["base"]])


def fit_weights(counts: np.ndarray, y: np.ndarray, draw: float = 1.0) -> np.ndarray:
    """Logistic regression drawn to the prior weights (Newton steps)."""
    x, w0 = _features(counts), prior_weights()
    w = w0.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + draw * (w - w0)
        h = (x * (p * (1 - p))[:, None]).T @ x + draw * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def patterns(text: str) -> set[str]:
    """Words of a text, and their beginnings of STEM to STEM + 3 letters."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in range(STEM, STEM + 4) if len(w) > k}


def _kin(p: str, q: str) -> bool:
    """Whether two patterns match a word in common by construction."""
    a, b = p.rstrip("*"), q.rstrip("*")
    return a == b or (p.endswith("*") and b.startswith(a)) or (q.endswith("*") and a.startswith(b))


def learn_insults(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, str]:
    """Patterns that explain the toxic texts of ``sample`` (text, y), with their
    symbols: each is in enough of those that no earlier pattern explains, an insult
    in hardly any clean one and a weak insult in few."""
    support = max(3, n_toxic // 500)
    rate = n_toxic / max(1, n_clean)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: list[Counter] = [Counter(), Counter()]

        def given() -> pa.RecordBatch:
            names = list(by[1].keys() | by[0].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][p] for p in names], pa.int64()),
                                              pa.array([by[0][p] for p in names], pa.int64())], names=["pattern", "toxic", "clean"])
            by[0].clear()
            by[1].clear()
            return out

        for batch in batches:
            for part in by_size(batch, 0):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by[y].update(patterns(t))
                    if len(by[0]) + len(by[1]) > COUNTED:
                        yield given()
        yield given()

    counts = (sample.select("text", "y").mapInArrow(count, "pattern string, toxic long, clean long").groupBy("pattern")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .filter((F.col("toxic") >= support) & (F.col("clean") * rate <= F.col("toxic") * WEAK_IMPURITY)))
    kept = counts.orderBy(F.desc("toxic"), "pattern").limit(CANDIDATES).collect()
    index = {r["pattern"]: i for i, r in enumerate(kept)}
    pure = {r["pattern"] for r in kept if r["clean"] * rate <= r["toxic"] * IMPURITY}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[index[p] for p in patterns(t) if p in index] for part in by_size(batch, 0) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["found"])

    rows_of: dict[str, set[int]] = {p: set() for p in index}
    names = list(index)
    for row, r in enumerate(sample.filter("y = 1").select("text").mapInArrow(present, "found array<long>").collect()):
        for i in r["found"]:
            rows_of[names[i]].add(row)
    chosen: dict[str, str] = {}
    explained: set[int] = set()
    for symbol, allowed in (("i", pure), ("w", set(index) - pure)):
        left = {p: r for p in allowed if len(r := rows_of[p] - explained) >= support}
        while left:
            # a word before a beginning that finds no more, the longer beginning before the shorter
            best = max(left, key=lambda p: (len(left[p]), not p.endswith("*"), len(p), p))
            rows = left.pop(best)
            chosen[best] = symbol
            explained |= rows
            left = {p: r for p, rs in left.items() if len(r := rs - rows) >= support}
        if symbol == "i":
            # insults that mostly keep company with another one: a second explanation, for many more texts
            times = Counter(i for p in chosen for i in rows_of[p])
            left = {p: r for p in allowed if not any(_kin(p, c) for c in chosen)
                    and len(r := {i for i in rows_of[p] if times[i] < 2}) >= 5 * support}
            while left:
                best = max(left, key=lambda p: (len(left[p]), not p.endswith("*"), len(p), p))
                del left[best]
                chosen[best] = symbol
                times.update(rows_of[best])
                left = {p: r for p, rs in left.items() if not _kin(p, best) and len(r := {i for i in rs if times[i] < 2}) >= 5 * support}
    return chosen


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: Column | None = None, sample: int = SAMPLE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every text; labels of ``held_out`` ids are never read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows, labels, label=label, held_out=held_out, sample=sample)
    return rows.mapInArrow(scorer(*model), "doc_id long, score double")


def fit(rows: DataFrame, labels: DataFrame, *, label: str = "toxic", held_out: Column | None = None,
        sample: int = SAMPLE) -> tuple[dict[str, str], np.ndarray]:
    """(insult patterns, weights) from at most ``sample`` labelled texts of each
    class, each text once."""
    seen = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    train = (seen.filter(~held_out) if held_out is not None else seen).groupBy("doc_id").agg(F.max("y").alias("y"))
    # ids are drawn before their texts are read: at most 2 * sample rows
    drawn = [train.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11))).limit(sample) for y in (1, 0)]
    ids = F.broadcast(materialise(drawn[0].unionByName(drawn[1]), "toxic-sample"))
    texts = materialise(rows.filter("text is not null").join(ids, "doc_id").select("text", "y").distinct(), "toxic-sample")
    size = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    insults = learn_insults(texts, size.get(1, 0), size.get(0, 0)) if size.get(1) else {}
    insults |= dict.fromkeys(INSULTS, "i")
    if not size:
        return insults, prior_weights()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(insults)
        for batch in batches:
            x = [found.counts(t) for part in by_size(batch, 0) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int64())), batch.column(1)], names=["x", "y"])

    seen_rows = texts.select("text", "y").mapInArrow(counted, "x array<long>, y int").collect()  # at most 2 * sample short rows
    return insults, fit_weights(np.array([r["x"] for r in seen_rows]), np.array([r["y"] for r in seen_rows], dtype=np.float64))


def _scores(found: Matcher, texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    x = np.array([found.counts(t or "") for t in texts.to_pylist()], dtype=np.int64).reshape(len(texts), len(MARKED))
    return 1 / (1 + np.exp(-np.clip(_features(x) @ weights, -30, 30)))


def scorer(insults: dict[str, str], weights: np.ndarray):
    """Arrow batches of (doc_id, text) to (doc_id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(insults)
        for batch in batches:
            for part in by_size(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scores(found, part.column(1), weights))], names=["doc_id", "score"])
    return run


def keep_below(docs: DataFrame, insults: dict[str, str], weights: np.ndarray, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, whole; a null text counts as an empty one."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Matcher(insults)
        for batch in batches:
            for part in by_size(batch, at):
                yield part.filter(pa.array(_scores(found, part.column(at), weights) < threshold))

    return docs.mapInArrow(run, docs.schema)
