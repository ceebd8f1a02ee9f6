import math

import numpy as np

import pytest

from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators.timeseries import ts_features
from tessera.operators.tfidf import tfidf


def test_auc_with_ties(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    got = M.roc_auc(df, "y", "s").collect()[0]["roc_auc"]
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    expect = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(expect)


def test_classification_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    m = M.classification_metrics(spark.createDataFrame(rows, "y string, p string"), "y", "p").collect()[0]
    assert m["accuracy"] == pytest.approx(3 / 5)
    # recall: a 1/2, b 2/2, c 0/1 -> balanced (0.5 + 1 + 0) / 3
    assert m["balanced_accuracy"] == pytest.approx(0.5)


def test_ndcg_tie_average(spark):
    # one query, two tied scores: gains averaged over positions 1-2
    rows = [(0, 3.0, 1.0), (0, 1.0, 1.0), (0, 0.0, 0.5)]
    df = spark.createDataFrame(rows, "q int, rel double, s double")
    got = M.ndcg(df, "rel", "s", query_cols=["q"]).collect()[0]["ndcg"]
    d = lambda p: 1 / math.log2(p + 1)
    dcg = (3.0 + 1.0) / 2 * (d(1) + d(2)) + 0.0 * d(3)
    idcg = 3.0 * d(1) + 1.0 * d(2) + 0.0 * d(3)
    assert got == pytest.approx(dcg / idcg)


def test_regression_metrics(spark):
    rows = [(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)]
    m = M.regression_metrics(spark.createDataFrame(rows, "y double, p double"), "y", "p").collect()[0]
    assert m["mae"] == pytest.approx(0.5)
    assert m["rmse"] == pytest.approx(math.sqrt((0.25 + 1) / 3))


def test_silhouette_matches_spark_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    rows = [(i, [float(i % 3) + (i % 7) * 0.01, float(i % 5) * 0.1], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x array<double>, c int")
    ours = M.silhouette_sqeuclidean(df, "x", "c", "id").collect()[0][0]
    vec = df.withColumn("features", array_to_vector("x")).withColumn("prediction", F.col("c").cast("double"))
    theirs = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vec)
    assert ours == pytest.approx(theirs, rel=1e-9)


def test_tfidf_formula(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry")], "id long, text string")
    w = {(r["id"], r["term"]): r["weight"] for r in tfidf(docs, "id", "text", ngram_range=(1, 1)).collect()}
    idf = lambda df_: math.log(3 / (1 + df_)) + 1
    a = (1 + math.log(2)) * idf(1)
    b = 1 * idf(2)
    assert w[(1, "apple")] == pytest.approx(a / math.sqrt(a * a + b * b))


def test_rolling_std_and_lags(spark):
    rows = [(i, float(v)) for i, v in enumerate([1, 4, 2, 8, 5, 7, 3, 9])]
    df = spark.createDataFrame(rows, "t long, y double")
    out = {r["t"]: r for r in ts_features(df, "t", "y", id_col="t", horizon=1, with_calendar=False,
                                          drop_incomplete=False, block=3).collect()}
    assert out[5]["lag_1"] == 5.0 and out[5]["lag_5"] == 1.0
    vals = [2.0, 8.0, 5.0]  # y[2..4] for t = 5, h = 1
    mean = sum(vals) / 3
    assert out[5]["rolling_mean_1"] == pytest.approx(mean)
    assert out[5]["rolling_std_1"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in vals) / 2))
    assert out[2]["rolling_mean_1"] is None


def test_text_columns_are_features(spark):
    from pyspark.ml.functions import vector_to_array

    from tessera.operators.features import FeaturePipeline
    rows = [(1, "Red apple, red pie", 2.0, "x"), (2, "green apple", 4.0, "y"), (3, None, None, "x"), (4, "", 6.0, "y")]
    df = spark.createDataFrame(rows, "id long, text string, size double, kind string")
    fitted = FeaturePipeline(text_cols=["text"], id_col="id", ngram_range=(1, 1)).fit(df)
    assert fitted.feature_names() == ["size", "kind_x", "kind_y", "text__apple", "text__red", "text__green", "text__pie"]
    got = {r[0]: r[1] for r in fitted.transform(df).select("id", vector_to_array("features")).collect()}
    idf = {"apple": np.log(5 / 3) + 1, "red": np.log(5 / 2) + 1, "green": np.log(5 / 2) + 1, "pie": np.log(5 / 2) + 1}
    one = np.array([idf["apple"], (1 + np.log(2)) * idf["red"], 0, idf["pie"]])
    assert np.allclose(got[1][3:], one / np.linalg.norm(one))
    assert got[3][3:] == [0, 0, 0, 0] and got[4][3:] == [0, 0, 0, 0]
    unseen = spark.createDataFrame([(9, "blue apple", 1.0, "z")], df.schema)
    assert np.allclose(fitted.transform(unseen).select(vector_to_array("features")).first()[0][1:], [0, 0, 1, 0, 0, 0])
    counts = FeaturePipeline(text_cols=["text"], id_col="id", vectorizer="count", ngram_range=(1, 1)).fit(df).transform(df)
    assert counts.where("id = 1").select(vector_to_array("features")).first()[0][3:] == [1, 2, 0, 1]
    plain = FeaturePipeline(text_cols=["text"], id_col="id", vectorizer="passthrough").fit(df)
    assert plain.feature_names() == ["size", "kind_x", "kind_y"] and "text" in plain.transform(df).columns


def test_more_text_columns_keep_fewer_terms():
    from tessera.operators.tfidf import effective_max_features
    assert [effective_max_features(5000, n) for n in (1, 2, 3, 4)] == [5000, 3000, 3000, 2000]
    assert effective_max_features(100, 4) == 100


def test_empty_vocabulary(spark):
    from pyspark.ml.functions import vector_to_array

    from tessera.operators.features import FeaturePipeline
    df = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0)], "id long, text string, size double")
    out = FeaturePipeline(text_cols=["text"], id_col="id").fit(df).transform(df)
    assert [r[0][1:] for r in out.select(vector_to_array("features")).collect()] == [[0.0], [0.0]]


def test_word2vec_trains_in_shares(spark, monkeypatch):
    """Every document gets a vector, and no task trains on more than a share of them."""
    from tessera.plans import q_text
    monkeypatch.setattr(q_text, "WORD2VEC_ROWS", 8)
    d = spark.createDataFrame([(i, ["red", "green", "blue"] * 5) for i in range(20)], "doc_id long, tokens array<string>")
    est = q_text.word2vec(d, vectorSize=4, minCount=2, seed=42, inputCol="tokens", outputCol="embedding", maxIter=1)
    assert est.getNumPartitions() == 3
    assert est.fit(d).transform(d).where("embedding is not null").count() == 20
    assert q_text.word2vec(d.limit(8)).getNumPartitions() == 1


def test_stop_words_are_looked_up_in_a_set(spark):
    from pyspark.sql import functions as F
    from tessera.functions.text import default_stop_words, remove_stop_words
    d = spark.createDataFrame([(["the", "cat", "and", "mouse", "the"],), ([],), (None,)], "tok array<string>")
    out = d.select(remove_stop_words(F.col("tok"), default_stop_words("english")).alias("t"))
    assert [r["t"] for r in out.collect()] == [["cat", "mouse"], [], None]
    assert "INSET" in out._jdf.queryExecution().optimizedPlan().toString()


def _plain_counts(rows, n_min, n_max):
    """term -> (total, df) by plain loops, and the counts of each row."""
    from collections import Counter
    each = []
    for words in rows:
        each.append(Counter(" ".join(words[i: i + n]) for n in range(n_min, n_max + 1) for i in range(len(words) - n + 1)))
    total, df = Counter(), Counter()
    for c in each:
        total.update(c)
        df.update(c.keys())
    return each, {t: (total[t], df[t]) for t in total}


@pytest.mark.parametrize("suggesting,groups,words,n_min,n_max", [(64, 1 << 20, 200_000, 1, 3), (2, 64, 7, 2, 2), (1, 1, 1, 1, 3), (1, 100_000, 50, 1, 1)])
def test_vocabulary_equals_plain_counts(spark, monkeypatch, suggesting, groups, words, n_min, n_max):
    """Bounds leave out no term, whatever ids suggest terms and however few groups there are."""
    import random

    from tessera.operators import tfidf as TF
    monkeypatch.setattr(TF, "SUGGESTING", suggesting)
    monkeypatch.setattr(TF, "TERM_GROUPS", groups)
    monkeypatch.setattr(TF, "WORDS", words)
    rng = random.Random(7)
    names = [f"{a}{b}" for a in "abcdefg" for b in "hijkl"]
    texts = [[rng.choice(names[: rng.choice([3, 35])]) for _ in range(rng.randrange(30))] for _ in range(40)]
    rows = [(i // 2, " ".join(t)) for i, t in enumerate(texts)] + [(None, None), (50, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    each, counts = _plain_counts(texts, n_min, n_max)
    got = TF.term_counts(docs, "id", "text", ngram_range=(n_min, n_max))
    want = sorted((i // 2, t, n) for i, c in enumerate(each) for t, n in c.items())
    assert sorted(map(tuple, got.collect())) == want
    kept = sorted(((t, *n) for t, n in counts.items()), key=lambda r: (-r[1], r[0]))[:20]
    assert [tuple(r) for r in TF.vocabulary(got, "id", 20).orderBy(F.desc("total"), "term").collect()] == kept
    model = TF.fit_terms(docs, "text", 20, "count", ngram_range=(n_min, n_max))
    assert model.terms == [r[0] for r in kept]
    at = {t: i for i, t in enumerate(model.terms)}
    found = sorted((r["id"], [(i, n) for i, n in zip(r["x"]["indices"], r["x"]["values"])])
                   for r in model.sparse(docs.where("id < 50"), "text", "x").collect())
    assert found == sorted((i // 2, sorted((at[t], float(n)) for t, n in c.items() if t in at)) for i, c in enumerate(each))


def test_rare_terms_are_not_shuffled(spark, monkeypatch):
    """Terms that occur once are counted in groups, not one by one."""
    from tessera.operators import tfidf as TF
    docs = spark.createDataFrame([(i, f"common words {'x' * (i % 26 + 2)}{chr(97 + i // 26)}q") for i in range(400)], "id long, text string")
    monkeypatch.setattr(TF, "SUGGESTING", 4)
    tf = TF.term_counts(docs, "id", "text", ngram_range=(1, 1))
    plain = []
    joined = type(tf).join
    monkeypatch.setattr(type(tf), "join", lambda *a, **k: plain.append(joined(*a, **k)) or plain[-1])
    got = TF.vocabulary(tf, "id", 2)
    assert [(r.term, r.total) for r in got.orderBy("term").collect()] == [("common", 400), ("words", 400)]
    assert len(plain) == 1  # no group reaches the bound: none is counted by term


def test_fitted_rows_are_dealt_round(spark):
    """Rows of one id are spread over the tasks."""
    from pyspark.sql import functions as F
    from tessera.operators.tfidf import doc_words
    docs = spark.createDataFrame([(0, "same words")] * 40, "id long, text string").coalesce(1)
    parts = doc_words(docs, "id", "text").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == spark.sparkContext.defaultParallelism


def test_one_row_group_is_spread(spark, tmp_path):
    """Splits without rows do not count as partitions."""
    from tessera.session import spread
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "one"))
        df = spark.read.parquet(str(tmp_path / "one"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        most = lambda d: max(len(p) for p in d.rdd.glom().collect())
        assert most(df) == 40_000 and most(spread(df)) < 20_000 and spread(df).count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    even = spark.range(0, 400, 1, 8)
    assert spread(even) is even


def test_splitter_finds_the_words_of_the_cleaned_text(spark):
    """Letters of new alphabets, mentions, addresses that begin in a word, and white space of every kind."""
    from pyspark.sql import functions as F
    from tessera.functions.text import clean_text, for_splitter, tokens, word_splitter
    texts = ["", None, "a", "Ab  cd ef\x0bgh\x1cij\tk", "a@ࡰbb c@dࡰ see #tag ht#tp www #www. x", "shttp://x.y/z\x0bwwwWWW İstanbul Kelvin",
             "me@http://there now", "don't stop-now 3rd \U0001d400ab힣cd", "at @www and www@at http@ www"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    words = F.arrow_udf(word_splitter(), "array<string>")(for_splitter("text"))
    for r in d.select(tokens(clean_text("text")).alias("a"), words.alias("b")).collect():
        assert r["a"] == r["b"]


@pytest.mark.parametrize("chunk,summed,words,n_max,most", [(1_000_000, 500_000, 200_000, 3, 20), (40, 10, 7, 3, 20), (1, 1, 1, 2, 5), (60, 500, 50, 1, 9), (30, 500, 50, 3, 100_000)])
def test_frequent_terms_equal_plain_counts(spark, monkeypatch, chunk, summed, words, n_max, most):
    """Bounds by chunk leave out no term, and not every n-gram is counted."""
    import random

    from tessera.operators import tfidf as TF

    def too_many(*_, **__):
        raise AssertionError("all n-grams are counted")
    for name, value in (("CHUNK", chunk), ("SUMMED", summed), ("WORDS", words), ("vocabulary", too_many)):
        monkeypatch.setattr(TF, name, value)
    rng = random.Random(3)
    names = [f"{a}{b}" for a in "abcdefg" for b in "hijkl"]
    texts = [[rng.choice(names[: rng.choice([2, 5, 35])]) for _ in range(rng.randrange(40))] for _ in range(60)]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts] + [(None,), ("",)], "text string").repartition(6)
    _, counts = _plain_counts(texts, 1, n_max)
    kept = sorted(((t, *n) for t, n in counts.items()), key=lambda r: (-r[1], r[0]))[:most]
    assert TF.frequent_terms(docs, "text", most, (1, n_max)) == kept
    assert TF.frequent_terms(docs, "text", most, (1, n_max), clean=False) == kept
    one = [[w for w in t if w != "ah"] for t in texts]
    assert dict((t, n) for t, n, _ in TF.frequent_terms(docs, "text", 100_000, (1, n_max), stop_words=["ah"])) == {t: n[0] for t, n in _plain_counts(one, 1, n_max)[1].items()}


@pytest.mark.parametrize("suspects", [0, 3, 30])
def test_texts_without_frequent_words_are_counted_in_full(spark, monkeypatch, suspects):
    """Where a task or the driver would hold too many n-grams, the terms are the same."""
    from tessera.operators import tfidf as TF
    monkeypatch.setattr(TF, "SUSPECTS", suspects)
    monkeypatch.setattr(TF, "CHUNK", 10)
    texts = [[f"{a}{b}" for a in "abcd" for b in "efg"[: i % 3 + 1]] for i in range(12)]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(3)
    kept = sorted(((t, *n) for t, n in _plain_counts(texts, 1, 3)[1].items()), key=lambda r: (-r[1], r[0]))
    assert TF.frequent_terms(docs, "text", 6) == kept[:6]
    assert TF.frequent_terms(docs, "text", 6, (2, 3)) == [r for r in kept if " " in r[0]][:6]


def test_weights_are_not_made_for_each_term(spark):
    """The length of a row's vector is found once, not once for each of its terms."""
    from tessera.operators import tfidf as TF
    docs = spark.createDataFrame([(1, "red apple red pie"), (None, "green apple"), (1, None)], "id long, text string")
    out = TF.tfidf(docs, "id", "text", ngram_range=(1, 2))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    model = TF.fit_terms(docs, "text", ngram_range=(1, 2))
    lists = {r["id"]: r["x"] for r in model.sparse(docs.where("text is not null"), "text", "x").collect()}
    rows = sorted((r["id"] or 0, r["term"], r["weight"]) for r in out.collect())
    assert rows == sorted((i or 0, model.terms[at], w) for i, x in lists.items() for at, w in zip(x["indices"], x["values"]))
    idf = lambda n: math.log(4 / (1 + n)) + 1
    plain = {"red": (1 + math.log(2)) * idf(1), "apple": idf(2), "pie": idf(1), "red apple": idf(1), "apple red": idf(1), "red pie": idf(1)}
    norm = math.sqrt(sum(w * w for w in plain.values()))
    assert {t: w for i, t, w in rows if i == 1} == pytest.approx({t: w / norm for t, w in plain.items()})


def _documents(spark, tmp_path):
    """Rows with long texts of many different words, and a folder with them as a table."""
    import random
    rng = random.Random(5)
    names = [f"{a}{b}{c}" for a in "abcde" for b in "fghij" for c in "klmno"]
    rows = [(i, ("en", "de", "fr")[i % 3], 10 * i, " ".join(rng.choice(names) for _ in range(3 + i * 4))) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, lang string, n_chars int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def _plain_features(rows, train):
    """What ``H09_assemble_text`` and ``H11_text_fit_transform`` return, by plain loops."""
    fitted = [r for r in rows if r[0] in train]
    each, counts = _plain_counts([r[3].split(" ") for r in fitted], 1, 3)
    terms = {t: math.log((1 + len(fitted)) / (1 + n[1])) + 1 for t, n in sorted(counts.items(), key=lambda r: (-r[1][0], r[0]))[:5000]}
    chars = np.array([r[2] for r in fitted], float)
    for r in rows:
        found = _plain_counts([r[3].split(" ")], 1, 3)[0][0]
        weights = {t: (1 + math.log(n)) * terms[t] for t, n in found.items() if t in terms}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out = {f"text__{t}": w / norm for t, w in weights.items()} | {f"lang_{r[1]}": 1.0, "n_chars": (r[2] - chars.mean()) / chars.std()}
        yield from ((r[0], f, v) for f, v in out.items() if v)


@pytest.mark.parametrize("query", ["H09_assemble_text", "H11_text_fit_transform"])
def test_features_of_long_texts(spark, tmp_path, query):
    """Text, numbers and categories in one vector, whose entries are not made again for each term."""
    import __spark_entry__ as entry
    from tessera.functions.hashing import hash_below, hash_hex
    rows = _documents(spark, tmp_path)
    train = {r[0] for r in rows}
    if query.startswith("H11"):
        ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
        train = {r[0] for r in ids.where(hash_below(hash_hex("doc_id", seed=42, salt="split"), 0.8)).collect()}
        assert 0 < len(train) < len(rows)
    out = entry.queries()[query](spark, str(tmp_path))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["doc_id"], r["feature"]): r["value"] for r in out.collect()}
    want = {(i, f): v for i, f, v in _plain_features(rows, train)}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1.1e-6 for k in want)


def test_entries_of_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors
    from tessera.plans.q_features import vector_rows
    rows = [(1, Vectors.sparse(4, [1, 3], [0.5, 2.0])), (1, Vectors.dense([1.0, 0.0, 0.0, 3.0])), (None, Vectors.sparse(4, [2], [0.0])), (2, Vectors.sparse(4, [], []))]
    d = spark.createDataFrame(rows, ["doc_id", "features"])
    got = sorted(map(tuple, vector_rows(d, list("abcd"), "doc_id").collect()))
    assert got == [(1, "a", 1.0), (1, "b", 0.5), (1, "d", 2.0), (1, "d", 3.0)]
