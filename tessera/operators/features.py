"""Feature pipeline: fit on train, apply to any frame.

Fitting produces small statistic tables -- one row per column for medians,
means, scales; one row per category for encoders -- with exact aggregates
(exact medians by bucketed prefix sums, not ``Imputer``'s approximation).
Per-column numbers (bounded by the column count) are inlined as literals;
category dictionaries of high-cardinality columns stay DataFrames and are
joined (broadcast only under a checked size).  ``assemble`` turns the result
into an ML vector with ``VectorAssembler`` for the estimators.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import default_stop_words
from tessera.operators.aggregates import exact_quantiles
from tessera.operators.joins import checked_broadcast
from tessera.operators.ordering import range_rank
from tessera.operators.profile import NUMERIC, distinct_counts
from tessera.operators.tfidf import TermModel, effective_max_features, fit_terms

DICT_BROADCAST_LIMIT = 1_000_000


def _long_numeric(df: DataFrame, cols) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.inline(arr))


def fit_medians(df: DataFrame, cols) -> dict[str, float | None]:
    """Exact (interpolated) median per column, all columns in one job."""
    if not cols:
        return {}
    q = exact_quantiles(_long_numeric(df, cols), "v", [0.5], ["column"])
    got = {r["column"]: r["value"] for r in q.collect()}  # one row per column
    return {c: got.get(c) for c in cols}


def impute(df: DataFrame, fills: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double") if isinstance(v, float) else F.col(c), F.lit(v))
                           for c, v in fills.items() if v is not None})


def fit_modes(df: DataFrame, cols) -> dict[str, object]:
    """Most frequent non-null value per column, ties -> smallest."""
    if not cols:
        return {}
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    long = df.select(F.inline(arr)).where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("column").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("mode"))
    got = {r["column"]: r["mode"] for r in modes.collect()}  # one row per column
    return {c: got.get(c) for c in cols}


@dataclass
class ScalerStats:
    kind: str
    center: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)


def fit_scaler(df: DataFrame, cols, kind: str = "standard") -> ScalerStats:
    """H02 standard (population std, 0 -> 1), H03 min-max (range 0 -> 1),
    H04 robust (median / IQR, 0 -> 1)."""
    if not cols:
        return ScalerStats(kind)
    if kind == "robust":
        q = exact_quantiles(_long_numeric(df, cols), "v", [0.25, 0.5, 0.75], ["column"]).collect()
        by = {}
        for r in q:
            by.setdefault(r["column"], {})[round(r["p"], 2)] = r["value"]
        center = {c: by.get(c, {}).get(0.5) for c in cols}
        scale = {c: (by[c][0.75] - by[c][0.25]) if c in by else None for c in cols}
    else:
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            if kind == "minmax":
                aggs += [F.min(x).alias(f"a_{c}"), F.max(x).alias(f"b_{c}")]
            else:
                aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_pop(x).alias(f"b_{c}")]
        row = df.agg(*aggs).first()
        center = {c: row[f"a_{c}"] for c in cols}
        scale = {c: (row[f"b_{c}"] - row[f"a_{c}"]) if kind == "minmax" and row[f"a_{c}"] is not None
                 else row[f"b_{c}"] for c in cols}
    scale = {c: (1.0 if (s is None or s == 0) else float(s)) for c, s in scale.items()}
    center = {c: (0.0 if v is None else float(v)) for c, v in center.items()}
    return ScalerStats(kind, center, scale)


def scale(df: DataFrame, stats: ScalerStats) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(stats.center[c])) / F.lit(stats.scale[c])
                           for c in stats.center})


def category_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, index): sorted distinct non-null values, 0-based.
    Indexes come from ``range_rank`` so a large dictionary is ranked across
    tasks."""
    vals = df.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    return range_rank(vals, ["value"], name="_r").select("value", (F.col("_r") - 1).cast("int").alias("index"))


def _join_dict(df: DataFrame, col: str, dictionary: DataFrame, out: str, size: int | None = None) -> DataFrame:
    d = dictionary.select(F.col("value").alias("_dv"), F.col("index").alias(out))
    if size is not None and size <= DICT_BROADCAST_LIMIT:
        d = F.broadcast(d)
    return df.join(d, F.col(col).cast("string") == F.col("_dv"), "left").drop("_dv")


def ordinal_encode(df: DataFrame, col: str, dictionary: DataFrame, out: str | None = None,
                   unknown: int = -1, size: int | None = None) -> DataFrame:
    """Index in the fitted sorted categories; unseen or null -> ``unknown``."""
    out = out or col
    j = _join_dict(df, col, dictionary, "_idx", size)
    return j.withColumn(out, F.coalesce(F.col("_idx"), F.lit(unknown))).drop("_idx", *([] if out == col else []))


def one_hot(df: DataFrame, col: str, categories: list[str], prefix: str | None = None) -> DataFrame:
    """One 0/1 column per fitted category in sorted order; unseen -> all zeros."""
    prefix = prefix or col
    v = F.col(col).cast("string")
    return df.withColumns({f"{prefix}_{c}": F.when(v == F.lit(c), 1.0).otherwise(0.0) for c in categories})


def label_encode(df: DataFrame, col: str, dictionary: DataFrame, out: str = "label",
                 size: int | None = None) -> DataFrame:
    """Sorted class index; unseen -> null."""
    j = _join_dict(df, col, dictionary, out, size)
    return j


def label_decode(df: DataFrame, col: str, dictionary: DataFrame, out: str) -> DataFrame:
    """H08 inverse."""
    d = checked_broadcast(dictionary.select(F.col("index").alias("_i"), F.col("value").alias(out)), DICT_BROADCAST_LIMIT)
    return df.join(d, F.col(col).cast("int") == F.col("_i"), "left").drop("_i")


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (k * n_c) as a column (classes are a small table)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k")).first()
    w = counts.select(label, (F.lit(float(tot["_n"])) / (F.lit(float(tot["_k"])) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w) if tot["_k"] <= DICT_BROADCAST_LIMIT else w, label, "left")


@dataclass
class FittedFeatures:
    """Output of ``FeaturePipeline.fit``: every statistic needed by ``transform``."""
    numeric: list
    low_card: dict
    high_card: dict
    high_sizes: dict
    text_cols: list
    medians: dict
    modes: dict
    scaler: ScalerStats
    target: str | None
    label_dict: DataFrame | None
    label_size: int | None = None
    text_models: dict = field(default_factory=dict)

    def feature_names(self) -> list[str]:
        """Names in assembly order: numeric, one-hot, ordinal, text terms."""
        names = list(self.numeric)
        for c, cats in self.low_card.items():
            names += [f"{c}_{v}" for v in cats]
        names += list(self.high_card)
        for c, model in self.text_models.items():
            names += [f"{c}__{t}" for t in model.terms] or [f"{c}__"]
        return names

    def transform(self, df: DataFrame, assemble_vector: bool = True) -> DataFrame:
        """The same steps as fit, applied to any frame."""
        d = impute(df, {c: self.medians[c] for c in self.numeric})
        d = scale(d, self.scaler)
        d = d.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c)))
                           for c in [*self.low_card, *self.high_card] if self.modes.get(c) is not None})
        for c, cats in self.low_card.items():
            d = one_hot(d, c, cats)
        for c, dic in self.high_card.items():
            d = ordinal_encode(d, c, dic, out=f"{c}__ord", size=self.high_sizes.get(c))
            d = d.withColumn(c, F.col(f"{c}__ord").cast("double")).drop(f"{c}__ord")
        if self.target and self.label_dict is not None:
            d = label_encode(d, self.target, self.label_dict, "label", self.label_size)
        elif self.target:
            d = d.withColumn("label", F.col(self.target).cast("double"))
        for c, model in self.text_models.items():
            d = model.vectors(d, c, f"{c}__terms")
        if assemble_vector:
            d = assemble(d, self).drop(*[f"{c}__terms" for c in self.text_models])
        return d


    def save(self, path: str) -> None:
        """The statistics as one JSON row, each dictionary as a table."""
        from dataclasses import asdict
        spark = (self.label_dict or next(iter(self.high_card.values()), None))
        spark = spark.sparkSession if spark is not None else SparkSession.getActiveSession()
        plain = {f: getattr(self, f) for f in ("numeric", "low_card", "high_sizes", "text_cols", "medians", "modes", "target", "label_size")}
        plain |= {"scaler": asdict(self.scaler), "text_models": {c: asdict(m) for c, m in self.text_models.items()},
                  "high_card": list(self.high_card), "label": self.label_dict is not None}
        spark.createDataFrame([(json.dumps(plain),)], "facts string").write.parquet(f"{path}/facts")
        for n, d in enumerate(self.high_card.values()):
            d.write.parquet(f"{path}/dictionary-{n}")
        if self.label_dict is not None:
            self.label_dict.write.parquet(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedFeatures:
        """What ``save`` wrote."""
        plain = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        plain["scaler"] = ScalerStats(**plain["scaler"])
        plain["text_models"] = {c: TermModel(**m) for c, m in plain["text_models"].items()}
        plain["high_card"] = {c: spark.read.parquet(f"{path}/dictionary-{n}") for n, c in enumerate(plain["high_card"])}
        plain["label_dict"] = spark.read.parquet(f"{path}/labels") if plain.pop("label") else None
        return cls(**plain)


def assemble(df: DataFrame, fitted: FittedFeatures, out: str = "features") -> DataFrame:
    """``VectorAssembler`` over numeric, one-hot and ordinal columns and the
    sparse term vectors of the text columns, in that order; sparse where that is shorter."""
    from pyspark.ml.feature import VectorAssembler, VectorSizeHint
    cols = list(fitted.numeric)
    for c, cats in fitted.low_card.items():
        cols += [f"{c}_{v}" for v in cats]
    cols += list(fitted.high_card)
    for c, model in fitted.text_models.items():
        cols.append(f"{c}__terms")
        df = VectorSizeHint(inputCol=cols[-1], size=max(1, len(model.terms)), handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


class FeaturePipeline:
    """H11 entry: ``FeaturePipeline(target, text_cols, date_col, scaler).fit(df)``.
    Column kinds: numeric types -> median + scaler; strings with at most
    ``low_card`` distinct values -> mode + one-hot; other strings -> mode +
    ordinal; constant columns dropped; booleans and datetimes dropped (as in
    the reference); the date column, the target and row ids (``id_col``) are never features.

    Each of ``text_cols`` is cleaned (null: empty) and becomes a sparse vector of the
    terms that the training rows hold: ``vectorizer`` "tfidf" or "count", or
    "passthrough", which leaves the column as it is.  With more text columns each keeps
    fewer terms (``effective_max_features``).  ``stop_words`` names a language or is None."""

    def __init__(self, target: str | None = None, text_cols=(), date_col: str | None = None,
                 scaler: str = "standard", low_card: int = 15, encode_target: bool | None = None,
                 id_col: str | tuple[str, ...] = (), vectorizer: str = "tfidf", ngram_range=(1, 3), max_features: int = 5000,
                 stop_words: str | None = None, sublinear_tf: bool = True, cleaning_mode: str = "standard"):
        if vectorizer not in ("tfidf", "count", "passthrough"):
            raise ValueError(f"unknown vectorizer {vectorizer!r}")
        self.target, self.text_cols, self.date_col = target, list(text_cols), date_col
        self.id_cols = [id_col] if isinstance(id_col, str) else list(id_col)
        self.scaler_kind, self.low_card = scaler, low_card
        self.encode_target = encode_target
        self.vectorizer, self.max_features = vectorizer, max_features
        self.text_options = dict(ngram_range=ngram_range, stop_words=default_stop_words(stop_words) if stop_words else None,
                                 sublinear_tf=sublinear_tf, mode=cleaning_mode)

    def fit_text(self, df: DataFrame) -> dict:
        """A fitted vocabulary for each text column."""
        if self.vectorizer == "passthrough":
            return {}
        most = effective_max_features(self.max_features, len(self.text_cols))
        return {c: fit_terms(df, c, most, self.vectorizer, **self.text_options) for c in self.text_cols}

    def fit(self, df: DataFrame) -> FittedFeatures:
        types = {f.name: f.dataType for f in df.schema.fields}
        skip = {self.target, self.date_col, *self.text_cols, *self.id_cols}
        cand = [c for c in df.columns if c not in skip]
        num = [c for c in cand if isinstance(types[c], NUMERIC)]
        cat = [c for c in cand if isinstance(types[c], T.StringType)]
        dc = {r["column"]: r["distinct_count"] for r in distinct_counts(df, num + cat).collect()} if num + cat else {}
        num = [c for c in num if dc.get(c, 0) > 1]
        cat = [c for c in cat if dc.get(c, 0) > 1]
        low = [c for c in cat if dc[c] <= self.low_card]
        high = [c for c in cat if dc[c] > self.low_card]
        medians = fit_medians(df, num)
        imputed = impute(df, medians)
        sc = fit_scaler(imputed, num, self.scaler_kind)
        modes = fit_modes(df, cat)
        filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(modes[c])) for c in cat if modes.get(c) is not None})
        low_cats = {}
        for c in low:  # at most ``low_card`` values each
            low_cats[c] = sorted(r[0] for r in filled.select(F.col(c).cast("string")).distinct().collect()
                                 if r[0] is not None)
        high_dicts = {c: category_dictionary(filled, c) for c in high}
        label_dict = label_size = None
        if self.target:
            enc = self.encode_target
            if enc is None:
                enc = isinstance(types[self.target], T.StringType)
            if enc:
                label_dict = category_dictionary(df, self.target)
                label_size = label_dict.count()
        return FittedFeatures(num, low_cats, high_dicts, {c: dc[c] for c in high}, self.text_cols, medians, modes,
                              sc, self.target, label_dict, label_size, self.fit_text(df))
