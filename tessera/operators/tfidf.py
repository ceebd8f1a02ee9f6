"""Relational bag-of-words features.

Documents are cleaned and tokenised by native expressions; their n-grams are
counted inside the row by Arrow functions over word numbers, and only counted
terms become strings.  The vocabulary cap and document frequencies are grouped
aggregates, from which terms that cannot be among the most frequent are kept
away by bounds.  Weights
follow the reference's vectoriser: sublinear tf 1 + ln(tf), smooth idf
ln((1 + n) / (1 + df)) + 1, L2-normalised per document.  Spark ML's ``IDF``
uses ln((n + 1) / (df + 1)) without the +1 and does not normalise, so it is
not a drop-in.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import clean_text, for_splitter, ngrams, remove_stop_words, tokens, word_splitter
from tessera.session import cut_lineage, spread

VOCAB_BROADCAST_LIMIT = 1_000_000
#: One in so many ids suggests the terms whose totals bound the vocabulary from below.
SUGGESTING = 64
#: Terms suggested for each one kept, and groups of the other terms by hash.
SUGGESTED, TERM_GROUPS = 4, 1 << 20
#: Words that one step of an Arrow function takes (a longer document alone).
WORDS = 200_000
#: Letters that a word and the space after it have, about.
LETTERS = 6
#: Words among which a task looks for frequent n-grams at once (or up to twice as many), distinct words that it
#: holds and adds up, and words or n-grams suspected to be frequent that go to the driver at most.
CHUNK, SUMMED, SUSPECTS = 1_000_000, 500_000, 500_000
#: Tasks that each send the most frequent terms they know to the driver.
SENDERS = 16


def effective_max_features(max_features: int, n_text_cols: int) -> int:
    """5000 by default; at most 3000 with 2-3 text columns, 2000 with more."""
    if n_text_cols > 3:
        return min(max_features, 2000)
    if n_text_cols > 1:
        return min(max_features, 3000)
    return max_features


def _words(text_col: str, stop_words=None, clean: bool = True, mode: str = "standard"):
    text = clean_text(text_col, mode) if clean else F.coalesce(F.col(text_col), F.lit(""))
    return remove_stop_words(tokens(text), stop_words)


def _word_source(text_col: str, stop_words=None, clean: bool = True, mode: str = "standard"):
    """A column, and a function that makes of its Arrow arrays, a range of rows after the other,
    the first row and the list of each row's words; a range has about ``WORDS`` words, or one row."""
    if clean and mode == "standard" and not stop_words:
        steps, split = _stepper(LETTERS * WORDS), word_splitter()

        def pieces(text):
            for a, b in steps(np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy(), dtype=np.int64)])):
                yield a, split(text.slice(a, b - a))

        return for_splitter(text_col), pieces
    steps = _stepper(WORDS)

    def ready(tok):
        for a, b in steps(tok.offsets.to_numpy().astype(np.int64)):
            yield a, tok.slice(a, b - a)

    return _words(text_col, stop_words, clean, mode), ready


def doc_words(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(id, _tok): the words of each document, in order."""
    # rows are dealt round: one id may hold many of them
    return spread(docs.select(F.col(id_col), F.col(text_col))).select(F.col(id_col), _words(text_col, **kw).alias("_tok"))


def doc_grams(docs: DataFrame, id_col: str, text_col: str, ngram_range=(1, 3), **kw) -> DataFrame:
    """(id, _grams): the n-grams of each document, one per occurrence."""
    d = doc_words(docs, id_col, text_col, **kw)
    return d.select(F.col(id_col), ngrams(F.col("_tok"), ngram_range[0], ngram_range[1]).alias("_grams"))


def doc_terms(docs: DataFrame, id_col: str, text_col: str, **kw) -> DataFrame:
    """(id, term) rows, one per n-gram occurrence."""
    return doc_grams(docs, id_col, text_col, **kw).select(F.col(id_col), F.explode("_grams").alias("term"))


def _stepper(most: int):
    def steps(offsets: np.ndarray):
        """Row ranges of about ``most`` words, a longer row alone."""
        a, n = 0, len(offsets) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
            yield a, b
            a = b

    return steps  # a closure travels to the tasks by value


def _gram_counter(n_min: int, n_max: int):
    """Arrow batches of (id, words) to rows (id, term, tf): a row's distinct n-grams and their counts.

    Words are numbered, an n-gram is the number of its first n - 1 words with the last
    word's, and a row's equal numbers are counted; a distinct n-gram is written once."""
    steps = _stepper(WORDS)

    def count(batches):
        for batch in batches:
            ids, tok = batch.column(0), batch.column(1)
            offsets = tok.offsets.to_numpy().astype(np.int64)
            for a, b in steps(offsets):
                flat = tok.values.slice(offsets[a], offsets[b] - offsets[a]).dictionary_encode()
                words, w = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
                row, size = np.repeat(np.arange(a, b), np.diff(offsets[a: b + 1])), max(len(words), 1)
                at, gram, names = np.arange(len(w)), w, words  # where n-grams begin, their numbers and texts
                for n in range(1, n_max + 1):
                    if n > 1:
                        on = at + n - 1 < len(w)
                        at, gram = at[on], gram[on]
                        on = row[at] == row[at + n - 1]
                        at, gram = at[on], gram[on]
                        gram, found = pd.factorize(gram * size + w[at + n - 1])
                        names = pc.binary_join_element_wise(names.take(pa.array(found // size)), words.take(pa.array(found % size)), " ")
                    if n >= n_min and len(at):
                        cell, found = pd.factorize(row[at] * len(names) + gram)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(found // len(names))), names.take(pa.array(found % len(names))).cast(pa.string()),
                             pa.array(np.bincount(cell, minlength=len(found)).astype(np.int64))], names=["id", "term", "tf"])

    return count


def term_counts(docs: DataFrame, id_col: str, text_col: str, ngram_range=(1, 3), **kw) -> DataFrame:
    """Long count vectors (id, term, tf).

    A document is one row, so its terms are counted inside the row; nothing is shuffled."""
    d = doc_words(docs, id_col, text_col, **kw)
    schema = T.StructType([d.schema[0], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return d.mapInArrow(_gram_counter(*ngram_range), schema)


def _word_summer(pieces):
    """Arrow batches of (source) to rows (term, total, df): words with their sums over many rows."""
    most = SUMMED

    def add(parts):
        names, total, df = (pa.concat_arrays([p[i] for p in parts]) for i in range(3))
        found = names.dictionary_encode()
        at, n = found.indices.to_numpy(), len(found.dictionary)
        sums = [pa.array(np.bincount(at, x.to_numpy(), n).astype(np.int64)) for x in (total, df)]
        return [found.dictionary, *sums]

    def count(batches):
        held, size = [], 0
        for _, tok in (piece for batch in batches for piece in pieces(batch.column(0))):
            offsets = tok.offsets.to_numpy().astype(np.int64)
            flat = tok.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            if not len(flat):
                continue
            n, w = len(flat.dictionary), flat.indices.to_numpy().astype(np.int64)
            cells = pd.unique(np.repeat(np.arange(len(tok)), np.diff(offsets)) * n + w)
            held.append([flat.dictionary.cast(pa.string()), pa.array(np.bincount(w, minlength=n)), pa.array(np.bincount(cells % n, minlength=n))])
            size += n
            if size > 2 * most:
                held = [add(held)]
                if len(held[0][0]) > most:
                    yield pa.RecordBatch.from_arrays(held.pop(), names=["term", "total", "df"])
                size = len(held[0][0]) if held else 0
        if held:
            yield pa.RecordBatch.from_arrays(add(held), names=["term", "total", "df"])

    return count


def _suspector(pieces, words: list[str], least: int, n_words: int, n_max: int):
    """Arrow batches of (source) to rows (term, held, spare): n-grams of two or more of ``words`` that
    come in a chunk of the rows at least as often as one does, in some chunk, that comes
    ``least`` times in all; ``held`` says how often, ``spare`` how often any other comes in that chunk
    at most.  ``n_words`` are the words of all chunks.  A row without a term stands for a
    chunk; its ``held`` is negative if the chunk has too many such n-grams."""
    size, most, limit = max(len(words), 1), CHUNK, SUSPECTS

    def rows(names, held, spare):
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.int64()), pa.array(np.full(len(names), spare))], names=["term", "held", "spare"])

    def frequent(w):
        share = -(-least * int(np.count_nonzero(w != -2)) // n_words)
        yield rows([None], [0], max(share - 1, 0))
        at, gram, names = np.arange(len(w)), w.astype(np.int64), words
        on = gram >= 0
        at, gram = at[on], gram[on]
        for _ in range(2, n_max + 1):
            on = at + 1 < len(w)
            at, gram = at[on] + 1, gram[on]  # where n-grams end
            on = w[at] >= 0
            at, gram = at[on], gram[on]
            code, found = pd.factorize(gram * size + w[at])
            held = np.bincount(code, minlength=len(found))
            often = held >= share
            if np.count_nonzero(often) > limit:
                yield rows([None], [-1], 0)
                break
            number = np.cumsum(often) - 1  # a frequent n-gram holds frequent ones only
            at, gram, found = at[often[code]], number[code[often[code]]], found[often]
            names = [f"{names[f // size]} {words[f % size]}" for f in found.tolist()]
            yield rows(names, held[often], share - 1)

    def suspect(batches):
        known, held, n = pa.array(words, pa.string()), [], 0
        for _, tok in (piece for batch in batches for piece in pieces(batch.column(0))):
            offsets = tok.offsets.to_numpy().astype(np.int64)
            flat = tok.values.slice(offsets[0], offsets[-1] - offsets[0])
            w = pc.fill_null(pc.index_in(flat.cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int32)
            held.append(np.insert(w, offsets[1:] - offsets[0], -2))  # no n-gram goes past the end of a row
            n += len(held[-1])
            if n > 2 * most:  # what is left for the last chunk is not a small one
                w = np.concatenate(held)
                end = most + int(np.flatnonzero(w[most:] == -2)[0]) + 1
                yield from frequent(w[:end])
                held, n = [w[end:]], len(w) - end
        if n:
            yield from frequent(np.concatenate(held))

    return suspect


def _term_summer(pieces, terms: list[str], n_min: int, n_max: int):
    """Arrow batches of (source) to one row (term, total, df) for each of ``terms``, by number."""
    counts = _term_counter(terms, n_min, n_max)

    def count(batches):
        total, df = np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        for _, tok in (piece for batch in batches for piece in pieces(batch.column(0))):
            _, term, n = counts(tok)
            total += np.bincount(term, n, len(terms)).astype(np.int64)
            df += np.bincount(term, minlength=len(terms))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(df[at])], names=["term", "total", "df"])

    return count


def frequent_terms(docs: DataFrame, text_col: str, max_features: int = 5000, ngram_range=(1, 3), **kw) -> list[tuple[str, int, int]]:
    """What ``vocabulary`` finds of the ``term_counts`` of all rows, most frequent first: (term, total, df).

    N-grams stay numbers of words, in the task that reads them.  The words are
    counted first; the last of the ``max_features`` most frequent bounds the totals of the
    vocabulary from below.  An n-gram of it has only words that reach the bound, and in some chunk
    of the rows it reaches the chunk's share of the bound: else its total would not.  What the
    chunks tell of the n-grams that do bounds each total from both sides, and the few that can still be
    in the vocabulary are counted exactly.  Where words are no terms, or as many n-grams
    are suspected as in a text without frequent words, ``vocabulary`` counts all."""
    plain = lambda: _vocabulary_rows(docs, text_col, max_features, ngram_range, **kw)
    if ngram_range[0] != 1 or not max_features:
        return plain()
    source, pieces = _word_source(text_col, **kw)
    rows = spread(docs.select(text_col)).select(source.alias("_source"))
    sums = "term string, total long, df long"
    totals = cut_lineage(rows.mapInArrow(_word_summer(pieces), sums).groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df")))
    n_words = totals.agg(F.sum("total")).first()[0] or 0
    # each task sends its first rows to the driver
    found = [tuple(r) for r in totals.coalesce(SENDERS).orderBy(F.desc("total"), "term").limit(max_features).collect()]
    if n_words == 0 or ngram_range[1] == 1:
        return found
    least = found[-1][1] if len(found) == max_features else 1
    reach = totals.where(F.col("total") >= F.lit(least)).select("term")
    if reach.count() > SUSPECTS:
        return plain()
    words = sorted(r[0] for r in reach.collect())  # at most SUSPECTS
    seen = rows.coalesce(-(-n_words // CHUNK)).mapInArrow(_suspector(pieces, words, least, n_words, ngram_range[1]), "term string, held long, spare long")
    seen = cut_lineage(seen.groupBy("term").agg(F.sum("held").alias("held"), F.sum("spare").alias("spare")))
    chunks, grams = seen.where("term IS NULL").first(), seen.where("term IS NOT NULL")
    if chunks["held"] < 0:
        return plain()
    # chunks that did not suspect an n-gram hold it ``spare`` times at most
    totals_at_least = sorted([r[1] for r in found] + [r[0] for r in grams.select("held").coalesce(SENDERS).orderBy(F.desc("held")).limit(max_features).collect()], reverse=True)
    bound = totals_at_least[max_features - 1] if len(totals_at_least) >= max_features else 1
    suspects = grams.where(F.col("held") - F.col("spare") + F.lit(chunks["spare"]) >= F.lit(bound)).select("term")
    if suspects.count() > SUSPECTS:
        return plain()
    terms = sorted(r[0] for r in suspects.collect())  # at most SUSPECTS
    if terms:
        parts = rows.mapInArrow(_term_summer(pieces, terms, 2, ngram_range[1]), "term long, total long, df long")
        counted = parts.groupBy("term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
        found += [(terms[r["term"]], r["total"], r["df"]) for r in counted.collect()]  # at most one row for each of ``terms``
    return sorted(found, key=lambda r: (-r[1], r[0]))[:max_features]


def _vocabulary_rows(docs: DataFrame, text_col: str, max_features: int | None, ngram_range, **kw) -> list[tuple[str, int, int]]:
    rows = docs.select(F.xxhash64(text_col).alias("_id"), text_col)
    some = term_counts(suggesting(rows, "_id"), "_id", text_col, ngram_range, **kw)
    found = vocabulary(term_counts(rows, "_id", text_col, ngram_range, **kw), "_id", max_features, some)
    return [tuple(r) for r in found.orderBy(F.desc("total"), "term").collect()]


def suggesting(docs: DataFrame, id_col: str) -> DataFrame:
    """The rows of one in ``SUGGESTING`` ids."""
    return docs.where(F.pmod(F.xxhash64(id_col), F.lit(SUGGESTING)) == 0)


def vocabulary(tf: DataFrame, id_col: str, max_features: int | None = 5000, some: DataFrame | None = None) -> DataFrame:
    """(term, total, df) -- the ``max_features`` terms with the largest
    corpus frequency, ties by term.  ``some`` are the counts of the ``suggesting`` rows, where
    they are had for less than from ``tf``.

    Most n-grams are rare, and shuffling each of them would cost more than the text.  The
    terms most frequent among the rows of some ids are counted exactly, and the last
    of the kept ones bounds the vocabulary from below; the totals of all other terms are
    added up in groups by hash, in the same pass.  A term of a group below the bound is not
    in the vocabulary, so only the groups that reach it are counted by term.  The terms
    found are those of a plain count whatever is suggested."""
    plain = lambda t: t.groupBy("term").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    if not max_features:
        return plain(tf)
    first = lambda v, n: v.orderBy(F.col("total").desc(), F.col("term").asc()).limit(n)
    suggested = cut_lineage(first(plain(suggesting(tf, id_col) if some is None else some).where("term IS NOT NULL"), SUGGESTED * max_features).select("term"))
    if max_features > VOCAB_BROADCAST_LIMIT // SUGGESTED or suggested.count() < max_features:
        return first(plain(tf), max_features)
    # at most SUGGESTED * max_features terms, and TERM_GROUPS groups
    named = F.broadcast(suggested.select("term", F.col("term").alias("_named")))
    group = F.when(F.col("_named").isNull(), F.pmod(F.xxhash64("term"), F.lit(TERM_GROUPS)).cast("int"))
    told = tf.join(named, "term", "left").withColumn("_group", group)
    sums = cut_lineage(told.groupBy("_named", "_group").agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df")))
    exact = sums.where("_named IS NOT NULL").select(F.col("_named").alias("term"), "total", "df")
    least = first(exact, max_features).agg(F.min("total")).first()[0]
    heavy = cut_lineage(sums.where((F.col("_group") >= 0) & (F.col("total") >= F.lit(least))).select("_group"))
    if not heavy.isEmpty():
        others = told.join(F.broadcast(heavy), "_group", "left_semi").select("term", "tf")
        exact = exact.unionByName(plain(others))
    return first(exact, max_features)


def _term_counter(terms: list[str], n_min: int, n_max: int):
    """Function of an Arrow array of the words of each row: the rows and the numbers of the
    ``terms`` they hold, ascending, and how often.  Every beginning of a term has a number, found
    from that of one word less and the next word."""
    parts = [tuple(t.split(" ")) for t in terms]
    words = sorted({w for t in parts for w in t})
    number = {w: i for i, w in enumerate(words)}
    size = max(len(words), 1)
    levels, before = [], {(w,): i for w, i in number.items()}
    for n in range(1, n_max + 1):
        if n > 1:
            keys = sorted({before[t[: n - 1]] * size + number[t[n - 1]]: t[:n] for t in parts if len(t) >= n}.items())
            now = {t: i for i, (_, t) in enumerate(keys)}
            known = np.array([k for k, _ in keys], np.int64)
            before = now
        else:
            known = np.zeros(0, np.int64)
        term = np.full(len(before) + 1, -1, np.int64)
        for i, t in enumerate(parts):
            if len(t) == n >= n_min:
                term[before[t]] = i
        levels.append((known, term))
    total = max(len(terms), 1)

    def find(tok):
        offsets = tok.offsets.to_numpy().astype(np.int64)
        flat = tok.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.string())
        w = pc.fill_null(pc.index_in(flat, value_set=pa.array(words, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(tok)), np.diff(offsets))
        at, gram, pairs = np.flatnonzero(w >= 0), w[w >= 0], []
        for n, (known, term) in enumerate(levels, 1):
            if n > 1:
                on = at + n - 1 < len(w)
                at, gram = at[on], gram[on]
                on = (row[at] == row[at + n - 1]) & (w[at + n - 1] >= 0)
                at, gram = at[on], gram[on]
                key = gram * size + w[at + n - 1]
                place = np.searchsorted(known, key)
                on = place < len(known)
                on[on] = known[place[on]] == key[on]
                at, gram = at[on], place[on]
            is_term = term[gram] >= 0
            pairs.append(row[at[is_term]] * total + term[gram[is_term]])
        found, counts = np.unique(np.concatenate(pairs), return_counts=True)
        return found // total, found % total, counts.astype(np.float64)

    return find


@dataclass
class TermModel:
    """A fitted vocabulary with its idf, applied inside each row.

    Terms (at most ``max_features``) are looked up by the numbers of their words and weighed
    in an Arrow function: applying it shuffles nothing."""
    terms: list[str]
    idf: list[float]
    ngram_range: tuple[int, int] = (1, 3)
    stop_words: list[str] | None = None
    clean: bool = True
    mode: str = "standard"
    weighting: str = "tfidf"
    sublinear_tf: bool = True

    def _weigher(self):
        """What ``_term_counter`` yields, with weights for counts."""
        counts, weighting, sublinear, idf = _term_counter(self.terms, *self.ngram_range), self.weighting, self.sublinear_tf, np.array(self.idf)

        def weigh(tok):
            row, term, x = counts(tok)
            if weighting != "count":
                x = (1.0 + np.log(x) if sublinear else x) * idf[term]
                x = x / np.sqrt(np.bincount(row, x * x, len(tok)))[row]
            return row, term, x

        return weigh

    def _lists(self, pieces):
        """Arrow function: texts to the lists of their terms' numbers and weights."""
        weigh = self._weigher()

        def lists(text):
            parts = [[], []]
            for _, tok in pieces(text):
                row, term, x = weigh(tok)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(tok)))]), pa.int32())
                for part, values in zip(parts, (pa.array(term, pa.int32()), pa.array(x))):
                    part.append(pa.ListArray.from_arrays(ends, values))
            return [pa.concat_arrays(p) if p else pa.array([], pa.list_(t)) for p, t in zip(parts, (pa.int32(), pa.float64()))]

        return lists

    def _source(self, text_col: str):
        return _word_source(text_col, self.stop_words, self.clean, self.mode)

    def sparse(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        """``df`` with ``out``: struct(indices, values), indices ascending."""
        if not self.terms:
            return df.withColumn(out, F.struct(F.array().cast("array<int>").alias("indices"), F.array().cast("array<double>").alias("values")))
        source, pieces = self._source(text_col)
        lists = self._lists(pieces)

        def find(text: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(lists(text), names=["indices", "values"])

        return df.withColumn(out, F.arrow_udf(find, "struct<indices: array<int>, values: array<double>>")(source))

    def vectors(self, df: DataFrame, text_col: str, out: str) -> DataFrame:
        """``df`` with the weights as an ML sparse vector."""
        from pyspark.ml.linalg import VectorUDT
        source, pieces = self._source(text_col)
        size, lists = max(1, len(self.terms)), self._lists(pieces)

        def vector(text: pa.Array) -> pa.Array:
            plain = [np.zeros(len(text), np.int8), np.full(len(text), size, np.int32)]  # the vector type's own layout: sparse, its size
            return pa.StructArray.from_arrays([*map(pa.array, plain), *lists(text)], names=["type", "size", "indices", "values"])

        return df.withColumn(out, F.arrow_udf(vector, VectorUDT())(source))

    def rows(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, term, weight): the entries of ``sparse`` one by one."""
        (source, pieces), weigh = self._source(text_col), self._weigher()
        d = df.select(F.col(id_col), source.alias("_source"))

        def entries(batches):
            for batch in batches:
                ids = batch.column(0)
                for a, tok in pieces(batch.column(1)):
                    row, term, x = weigh(tok)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + a)), pa.array(term, pa.int32()), pa.array(x)], names=[id_col, "_term", "weight"])

        found = d.mapInArrow(entries, T.StructType([d.schema[0], T.StructField("_term", T.IntegerType()), T.StructField("weight", T.DoubleType())]))
        # one constant array, folded when planned
        name = F.split(F.lit("\x01".join(self.terms)), "\x01")
        return found.select(F.col(id_col), F.get(name, F.col("_term")).alias("term"), "weight")


def fit_terms(docs: DataFrame, text_col: str, max_features: int = 5000, weighting: str = "tfidf", sublinear_tf: bool = True,
              ngram_range=(1, 3), stop_words=None, clean: bool = True, mode: str = "standard") -> TermModel:
    """The vocabulary of a text column with its smooth idf: passes that count inside
    the task (``frequent_terms``); at most ``SUSPECTS`` rows reach the driver, of which ``max_features`` stay."""
    kw = dict(ngram_range=ngram_range, stop_words=stop_words, clean=clean, mode=mode)
    n_docs = docs.count()
    found = frequent_terms(docs, text_col, max_features, **kw)
    idf = [math.log((1.0 + n_docs) / (1.0 + df)) + 1.0 for _, _, df in found]
    return TermModel([t for t, _, _ in found], idf, tuple(ngram_range), stop_words, clean, mode, weighting, sublinear_tf)


def tfidf(docs: DataFrame, id_col: str, text_col: str, ngram_range=(1, 3), max_features: int | None = 5000,
          stop_words=None, sublinear_tf: bool = True, clean: bool = True, mode: str = "standard") -> DataFrame:
    """(id, term, weight) for the vocabulary terms present in each doc.

    Passes over the text that count inside the task fix the vocabulary (top
    ``max_features`` terms with their document frequency, a bounded table); the last
    looks terms up and weighs them in the row (``TermModel``).  Without a bound on the vocabulary the second pass is a
    join on the term and a window on the id."""
    kw = dict(ngram_range=ngram_range, stop_words=stop_words, clean=clean, mode=mode)
    if max_features and max_features <= VOCAB_BROADCAST_LIMIT:
        model = fit_terms(docs, text_col, max_features, "tfidf", sublinear_tf, **kw)
        return model.rows(spread(docs.select(id_col, text_col)), id_col, text_col)
    from pyspark.sql import Window
    n_docs = docs.select(id_col).count()
    vocab = vocabulary(term_counts(docs, id_col, text_col, **kw), id_col, max_features).select("term", "df")
    t = term_counts(docs, id_col, text_col, **kw).join(vocab, "term")
    tfw = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear_tf else F.col("tf").cast("double")
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    t = t.withColumn("_w", tfw * idf)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
    return t.select(id_col, "term", (F.col("_w") / norm).alias("weight"))
