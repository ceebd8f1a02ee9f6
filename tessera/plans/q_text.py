"""Text and scalar-function queries (I01-I24) on whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions import text as T
from tessera.operators import tfidf as TF
from tessera.operators.ordering import top_k_per_group
from tessera.plans.registry import register
from tessera.session import spread, table


def _r6(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


def clean_sql(col):
    t = f"lower(coalesce(CAST({col} AS VARCHAR), ''))"
    t = f"regexp_replace({t}, '{T.URL_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{T.MENTION_PATTERN}', '', 'g')"
    t = f"regexp_replace({t}, '{T.KEEP_STANDARD}', '', 'g')"
    t = f"regexp_replace({t}, '{T.WS}+', ' ', 'g')"
    return f"trim({t})"


def tokens_sql(col):
    return f"regexp_extract_all({clean_sql(col)}, '{T.TOKEN_PATTERN}')"


def grams_sql(src, id_cols, n_max):
    """(ids..., term) rows: unnest tokens with their position, n-grams by
    lead() over the position (linear in the text length)."""
    ids = ", ".join(id_cols)
    leads = [f"lead(w, {j}) OVER (PARTITION BY {ids} ORDER BY pos)" for j in range(1, n_max)]
    grams = ["w"]
    for n in range(2, n_max + 1):
        grams.append(" || ' ' || ".join(["w"] + [f"w{j}" for j in range(1, n)]))
    lead_cols = ", ".join(f"{e} AS w{j + 1}" for j, e in enumerate(leads))
    sel = "\n  UNION ALL ".join(
        f"SELECT {ids}, {g} AS term FROM p" + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "")
        for n, g in enumerate(grams, start=1))
    return (f"p AS (SELECT {ids}, w, pos" + (f", {lead_cols}" if lead_cols else "") +
            f" FROM (SELECT {ids}, unnest(tok) AS w, generate_subscripts(tok, 1) AS pos FROM {src}) u),\n"
            f"g AS ({sel})")


@register("I01_clean_text", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def i01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean"))


@register("I02_clean_text_god_mode")
def i02(spark, sf):
    """Back-references (run collapsing) are not expressible in the oracle's regex engine."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.clean_text("text", mode="god_mode").alias("clean"))


@register("I03_null_text", f"""
SELECT doc_id, {clean_sql("CASE WHEN doc_id % 9 = 0 THEN NULL ELSE text END")} AS clean FROM documents""")
def i03(spark, sf):
    d = table(spark, sf, "documents")
    t = F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("text"))
    return d.select("doc_id", T.clean_text(t).alias("clean"))


@register("I04_ngram_counts", f"""
WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tok FROM documents),
{grams_sql('t', ['doc_id'], 3)},
c AS (SELECT doc_id, count(*) AS n_terms FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n1, CAST(greatest(len(tok) - 1, 0) AS BIGINT) AS n2,
       CAST(greatest(len(tok) - 2, 0) AS BIGINT) AS n3, CAST(coalesce(c.n_terms, 0) AS BIGINT) AS n_terms
FROM t LEFT JOIN c USING (doc_id)""")
def i04(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.tokens(T.clean_text("text")).alias("tok"))
    tok = F.col("tok")
    return d.select("doc_id", F.size(tok).cast("long").alias("n1"),
                    F.greatest(F.size(tok) - 1, F.lit(0)).cast("long").alias("n2"),
                    F.greatest(F.size(tok) - 2, F.lit(0)).cast("long").alias("n3"),
                    F.size(T.ngrams(tok, 1, 3)).cast("long").alias("n_terms"))


@register("I05_stop_words")
def i05(spark, sf):
    """Term counts after removing Spark's default stop words per language."""
    d = table(spark, sf, "documents")
    out = None
    for lang, name in [("en", "english"), ("fr", "french"), ("de", "german"), ("es", "spanish")]:
        sw = T.default_stop_words(name)
        part = TF.term_counts(d.where(F.col("lang") == lang), "doc_id", "text", ngram_range=(1, 1), stop_words=sw)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("term").agg(F.sum("tf").alias("total"))


@register("I06_count_vectors", f"""
WITH t AS (SELECT conv_id, turn, {tokens_sql('text')} AS tok FROM conversations),
{grams_sql('t', ['conv_id', 'turn'], 2)}
SELECT conv_id, turn, term, CAST(count(*) AS BIGINT) AS tf FROM g GROUP BY ALL""")
def i06(spark, sf):
    c = table(spark, sf, "conversations").withColumn("_id", F.struct("conv_id", "turn"))
    tc = TF.term_counts(c, "_id", "text", ngram_range=(1, 2))
    return tc.select("_id.conv_id", "_id.turn", "term", F.col("tf").cast("long"))


_TFIDF_SQL = f"""
WITH d AS (SELECT doc_id, {tokens_sql('text')} AS tok FROM documents),
{grams_sql('d', ['doc_id'], 3)},
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
v AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000),
n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT tf.doc_id, tf.term, (1 + ln(tf.tf)) * (ln((1 + n.n) / (1 + v.df)) + 1) AS w
      FROM tf JOIN v USING (term), n)
"""


@register("I07_tfidf", _TFIDF_SQL + """
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def i07(spark, sf):
    w = TF.tfidf(table(spark, sf, "documents"), "doc_id", "text", ngram_range=(1, 3), max_features=5000)
    return w.select("doc_id", "term", _r6("weight"))


@register("I08_vocabulary", _TFIDF_SQL + "SELECT term, CAST(total AS BIGINT) AS total, CAST(df AS BIGINT) AS df FROM v")
def i08(spark, sf):
    docs = table(spark, sf, "documents")
    tf = TF.term_counts(docs, "doc_id", "text", ngram_range=(1, 3))
    some = TF.term_counts(TF.suggesting(docs, "doc_id"), "doc_id", "text", ngram_range=(1, 3))
    v = TF.vocabulary(tf, "doc_id", 5000, some)
    return v.select("term", F.col("total").cast("long"), F.col("df").cast("long"))


@register("I09_strip_accents", "SELECT doc_id, strip_accents(text) AS folded FROM documents")
def i09(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.strip_accents("text").alias("folded"))


#: Documents that one task trains on; by default all of them would pass through one.
WORD2VEC_ROWS = 10_000


def word2vec(docs, **kw):
    """An estimator whose tasks train on shares of the documents; the vectors of their words
    are averaged, so with more than one share they differ from those of a single task."""
    from pyspark.ml.feature import Word2Vec
    return Word2Vec(numPartitions=max(1, -(-docs.count() // WORD2VEC_ROWS)), **kw)


@register("I10_word2vec_docs")
def i10(spark, sf):
    """Sentence-embedding feature re-aimed: Word2Vec document averages."""
    d = table(spark, sf, "documents").select("doc_id", T.tokens(T.clean_text("text")).alias("tokens"))
    model = word2vec(d, vectorSize=16, minCount=2, seed=42, inputCol="tokens", outputCol="embedding", maxIter=1).fit(d)
    return model.transform(d).select("doc_id", "embedding")


@register("I11_text_passthrough", "SELECT doc_id, coalesce(text, '') AS text FROM documents")
def i11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@register("I12_calendar_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek,
       CAST(quarter(ts) AS INTEGER) AS quarter, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year,
       CAST(dayofyear(ts) AS INTEGER) AS dayofyear, CAST(day(ts) AS INTEGER) AS dayofmonth,
       CAST(weekofyear(ts) AS INTEGER) AS weekofyear FROM events""")
def i12(spark, sf):
    e = table(spark, sf, "events")
    parts = X.calendar_parts("ts")
    return e.select("event_id", *[v.cast("int").alias(k) for k, v in parts.items()])


@register("I13_numeric_coercion", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
       TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def i13(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.to_number(F.get_json_object("props", "$.k")).alias("k"),
                    X.to_number("event_type").alias("bad"))


@register("I14_slugify", r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^\p{L}\p{N}_-]', '_', 'g'), '^_+|_+$', '', 'g'), ''),
                         'dataset') AS slug FROM pages""")
def i14(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.slugify("url").alias("slug"))


@register("I15_artifact_name", """
SELECT p_partkey, replace(replace(replace(p_name, ' ', '_'), '-', '_'), '__', '_') AS artifact FROM part""")
def i15(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.artifact_name("p_name").alias("artifact"))


@register("I16_ascii_only", r"""
SELECT doc_id, coalesce(nullif(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), ''), 'AutoML_Experiment') AS name
FROM documents""")
def i16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ascii_only("text").alias("name"))


def trial_labels(spark, sf):
    e = table(spark, sf, "events")
    lab = F.when(F.col("event_id") % 9 == 0, F.col("event_type")).otherwise(
        F.concat(F.col("event_type"), F.lit(" - Trial "), (F.col("event_id") % 50).cast("string")))
    return e.select("event_id", lab.alias("label"))


@register("I17_trial_label", """
WITH l AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN event_type
                                 ELSE event_type || ' - Trial ' || CAST(event_id % 50 AS VARCHAR) END AS label FROM events),
p AS (SELECT event_id, label, TRY_CAST(replace(string_split(label, ' - ')[2], 'Trial ', '') AS INTEGER) AS trial FROM l)
SELECT event_id, CASE WHEN trial IS NULL THEN label ELSE string_split(label, ' - ')[1] END AS model, trial FROM p""")
def i17(spark, sf):
    t = trial_labels(spark, sf)
    p = X.parse_trial_label("label")
    return t.select("event_id", p["model"].alias("model"), p["trial"].alias("trial"))


_SECS = "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"


@register("I18_duration", """
WITH s AS (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS st FROM events e),
d AS (SELECT s.event_id, CAST(floor((st + value * 37.0) - st) AS BIGINT) AS secs FROM s JOIN events USING (event_id))
SELECT event_id, printf('%02d:%02d:%02d', secs // 3600, (secs % 3600) // 60, secs % 60) AS duration FROM d""")
def i18(spark, sf):
    e = table(spark, sf, "events")
    st = F.expr(_SECS)
    return e.select("event_id", X.duration_hms(st, st + F.col("value") * 37.0).alias("duration"))


@register("I19_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CAST(json_extract_string(CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR), '$.event_type') AS VARCHAR) AS decoded_type
FROM events""")
def i19(spark, sf):
    e = table(spark, sf, "events")
    enc = X.encode_json("event_id", "event_type")
    return e.select("event_id", X.decode_json_field("props", "$.k").cast("int").alias("k"),
                    X.decode_json_field(enc, "$.event_type").alias("decoded_type"))


@register("I20_math_helpers", """
SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 6) AS log1p_qty,
       round(greatest(l_discount - 0.05, 0), 6) AS clipped, round(sqrt(l_extendedprice), 6) AS root FROM lineitem""")
def i20(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", _r6(F.log1p("l_quantity"), "log1p_qty"),
                     _r6(F.greatest(F.col("l_discount") - 0.05, F.lit(0.0)), "clipped"),
                     _r6(F.sqrt("l_extendedprice"), "root"))


def _canon_sql(m):
    return f"array_to_string(list_sort(list_transform(map_entries({m}), lambda e: e.key || '=' || e.value)), ';')"


def _canon(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@register("I21_prefix_params", f"""
WITH m AS (SELECT event_id, MAP {{'score': CAST(value AS VARCHAR), 'user_id': CAST(user_id AS VARCHAR)}} AS metrics,
                  MAP {{'user_id': CAST(user_id % 3 AS VARCHAR), 'kind': event_type}} AS params FROM events),
a AS (SELECT event_id, metrics, map_from_entries(list_transform(
        list_filter(map_entries(params), lambda e: NOT list_contains(map_keys(metrics), e.key)),
        lambda e: {{'key': 'param_' || e.key, 'value': e.value}})) AS added FROM m)
SELECT event_id, {_canon_sql("map_concat(metrics, added)")} AS merged FROM a""")
def i21(spark, sf):
    e = spread(table(spark, sf, "events").select("event_id", "value", "user_id", "event_type"))
    metrics = F.create_map(F.lit("score"), F.col("value").cast("string"), F.lit("user_id"), F.col("user_id").cast("string"))
    params = F.create_map(F.lit("user_id"), (F.col("user_id") % 3).cast("string"), F.lit("kind"), F.col("event_type"))
    return e.select("event_id", _canon(X.prefix_params(metrics, params)).alias("merged"))


@register("I22_filter_map", f"""
WITH m AS (SELECT event_id, MAP {{'mlflow.user': CAST(user_id AS VARCHAR), 'event_type': event_type,
                                 'k': json_extract_string(props, '$.k')}} AS tags FROM events)
SELECT event_id, {_canon_sql("map_from_entries(list_filter(map_entries(tags), lambda e: NOT starts_with(e.key, 'mlflow.') AND TRY_CAST(e.value AS DOUBLE) IS NOT NULL))")} AS kept
FROM m""")
def i22(spark, sf):
    e = table(spark, sf, "events")
    tags = F.create_map(F.lit("mlflow.user"), F.col("user_id").cast("string"), F.lit("event_type"), F.col("event_type"),
                        F.lit("k"), F.get_json_object("props", "$.k"))
    return e.select("event_id", _canon(X.numeric_entries(X.drop_prefixed_keys(tags))).alias("kept"))


_LINES = ["INFO start", "warning: slow", "Trial complete", "exception raised", "plain line", "[job] queued",
          "best score", "preprocessing features", "report ready"]


def log_lines(spark, sf):
    e = table(spark, sf, "events")
    arr = F.array(*[F.lit(x) for x in _LINES])
    line = F.concat_ws(" ", F.element_at(arr, (F.col("event_id") % len(_LINES) + 1).cast("int")), F.col("event_type"))
    return e.select("event_id", "user_id", line.alias("line"))


def _lines_sql():
    arr = "[" + ", ".join(f"'{x}'" for x in _LINES) + "]"
    return f"SELECT event_id, user_id, {arr}[event_id % {len(_LINES)} + 1] || ' ' || event_type AS line FROM events"


def _contains_any(u, words):
    return " OR ".join(f"contains({u}, '{w}')" for w in words)


def _severity_sql(u):
    parts = [f"WHEN {_contains_any(u, words)} THEN '{label}'" for label, words in X.SEVERITY_RULES]
    return "CASE " + " ".join(parts) + " ELSE 'default' END"


@register("I23_severity", f"SELECT event_id, {_severity_sql('upper(line)')} AS severity FROM ({_lines_sql()}) l")
def i23(spark, sf):
    return log_lines(spark, sf).select("event_id", X.severity("line").alias("severity"))


def _stage_sql(u, status):
    parts = [f"WHEN {status} = 'completed' OR contains({u}, '{X.STAGE_COMPLETE_KEYWORD}') THEN 4"]
    parts += [f"WHEN {_contains_any(u, words)} THEN {idx}" for idx, words in X.STAGE_RULES]
    return "CASE " + " ".join(parts) + f" WHEN {u} IS NULL OR {u} = '' THEN -1 ELSE 0 END"


@register("I24_training_stage", f"""
WITH l AS ({_lines_sql()}),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rk FROM l),
j AS (SELECT user_id, upper(string_agg(line, ' ' ORDER BY event_id)) AS u,
             CASE WHEN user_id % 5 = 0 THEN 'completed' ELSE 'running' END AS status
      FROM r WHERE rk <= 30 GROUP BY user_id)
SELECT user_id, CAST({_stage_sql('u', 'status')} AS INTEGER) AS stage FROM j""")
def i24(spark, sf):
    last = top_k_per_group(log_lines(spark, sf), ["user_id"], [F.col("event_id").desc()], 30, "event_id")
    j = last.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "line"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda x: x["line"]), " ")
    status = F.when(F.col("user_id") % 5 == 0, F.lit("completed")).otherwise(F.lit("running"))
    return j.select("user_id", X.stage_from_text(text, status).cast("int").alias("stage"))
