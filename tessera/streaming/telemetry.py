"""Scoring and telemetry as Structured Streaming jobs.

Every windowed aggregate is one function used by both a batch DataFrame and
a streaming one (``withWatermark`` bounds the state).  Stream tests run with
``trigger(availableNow=True)`` and a checkpoint in the shared folder, so a
restarted query resumes exactly where the commit log says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.joins import checked_broadcast
from tessera.session import cut_lineage, shared_dir


def score(df: DataFrame, model, label_dict: DataFrame | None = None, keep=()) -> DataFrame:
    """Frame -> frame + prediction (decoded to the original label when a
    label dictionary is given).  One output row per input row."""
    out = model.transform(df)
    if label_dict is not None:
        d = checked_broadcast(label_dict.select(F.col("index").cast("double").alias("prediction"),
                                                F.col("value").alias("predicted_label")))
        out = out.join(d, "prediction", "left")
    return out


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(col: str):
    """Wall-clock (UTC) timestamp_ntz -> timestamp instant, independent of the
    session time zone (watermarks need instants)."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, `{col}`)"))


def event_time(df: DataFrame, ts_col: str, name: str = "_et") -> DataFrame:
    """Add an instant column usable by ``withWatermark`` and ``window``."""
    from pyspark.sql import types as T
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        return df.withColumn(name, ntz_to_instant(ts_col))
    return df.withColumn(name, F.col(ts_col))


def _to_ntz(c: str):
    return F.expr(f"timestampadd(MICROSECOND, unix_micros({c}), {_EPOCH_NTZ})")


def telemetry_windows(df: DataFrame, ts_col: str, version_col: str, value_col: str,
                      window: str = "1 day", slide: str | None = None, watermark: str | None = None) -> DataFrame:
    """Per window and model version: requests, rows and mean value.
    ``slide`` gives the sliding N-day view.  Windows are aligned to UTC days
    and reported as wall-clock (timestamp_ntz) bounds."""
    d = event_time(df, ts_col)
    d = d.withWatermark("_et", watermark) if watermark else d
    w = F.window("_et", window, slide) if slide else F.window("_et", window)
    out = d.groupBy(w.alias("w"), F.col(version_col)).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.lit(1)).alias("rows"),
        F.avg(value_col).alias("mean_value"))
    return out.select(_to_ntz("w.start").alias("window_start"), _to_ntz("w.end").alias("window_end"), version_col,
                      "requests", "rows", "mean_value")


def window_category_counts(df: DataFrame, ts_col: str, cat_col: str, window: str = "1 day",
                           watermark: str | None = None) -> DataFrame:
    """K04 state: category counts per window (bounded by windows x categories)."""
    d = event_time(df, ts_col)
    d = d.withWatermark("_et", watermark) if watermark else d
    return d.groupBy(F.window("_et", window).alias("w"),
                     F.coalesce(F.col(cat_col).cast("string"), F.lit("__nan__")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_cur")).select(_to_ntz("w.start").alias("window_start"), "category", "n_cur")


def windowed_chi2(counts: DataFrame, baseline: DataFrame, cat_col: str) -> DataFrame:
    """Chi-square of each window's category counts against a fixed
    baseline (Yates with two categories), the same statistic as C06."""
    base = baseline.groupBy(F.coalesce(F.col(cat_col).cast("string"), F.lit("__nan__")).alias("category")).agg(
        F.count(F.lit(1)).alias("n_ref"))
    return chi2_by_window(counts, base)


def chi2_by_window(counts: DataFrame, base: DataFrame) -> DataFrame:
    """``windowed_chi2`` of (window_start, category, n_cur) and (category, n_ref).

    A category of the baseline that a window lacks adds n_ref * r2 / r1 to the sum
    (r1, r2: rows of baseline and window), so absent categories are added up from the
    totals and no grid of windows and categories is made."""
    base, counts = cut_lineage(base), cut_lineage(counts)
    total = base.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n_ref"), F.lit(0)).alias("n")).first()
    r1 = F.lit(float(total["n"]))
    cc = counts.join(checked_broadcast(base), "category", "left").select(
        "window_start", F.coalesce("n_ref", F.lit(0)).alias("o1"), F.col("n_cur").alias("o2"))
    per = cc.groupBy("window_start").agg(F.sum("o2").alias("r2"), F.sum("o1").alias("s1"), F.count(F.lit(1)).alias("present"),
                                         F.count_if(F.col("o1") > 0).alias("shared"))
    per = per.select("window_start", "r2", (r1 - F.col("s1")).alias("a1"), (F.lit(total["k"]) - F.col("shared")).alias("absent"),
                     (F.lit(total["k"]) + F.col("present") - F.col("shared")).alias("k"))

    def term(o1, o2):
        n = r1 + F.col("r2")
        out = F.lit(0.0)
        for obs, rowsum in ((o1, r1), (o2, F.col("r2"))):
            e = rowsum * (o1 + o2) / n
            diff = e - obs
            adj = F.when(F.col("k") == 2, obs + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))).otherwise(obs)
            out = out + (adj - e) * (adj - e) / e
        return out

    d = cc.join(per, "window_start").withColumn("_t", term(F.col("o1"), F.col("o2")))
    s = d.groupBy("window_start").agg(F.sum("_t").alias("_t"), F.first("r2").alias("r2"), F.first("a1").alias("a1"),
                                      F.first("absent").alias("absent"), F.first("k").alias("k"))
    # with two categories at most one is absent, and its correction is its own
    rest = F.when(F.col("absent") == 0, 0.0).when(F.col("k") == 2, term(F.col("a1"), F.lit(0.0))).otherwise(F.col("a1") * F.col("r2") / r1)
    degenerate = (F.col("k") < 2) | (r1 == 0)
    return s.select("window_start", F.when(degenerate, F.lit(0.0)).otherwise(F.col("_t") + rest).alias("statistic"),
                    F.col("k").cast("long").alias("categories"), F.col("r2").cast("long").alias("n_cur"))


def bin_of(col: str, low: float, high: float, bins: int):
    """Fixed bins of equal width from ``low`` to ``high``; -1 and ``bins`` hold what lies
    outside, null what is null or not a number."""
    v = F.col(col).cast("double")
    width = (high - low) / bins or 1.0
    at = F.floor((v - F.lit(low)) / F.lit(width))
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(-1), F.least(F.lit(bins), at)).cast("int"))


class DriftMonitor:
    """Drift of each time window against a fixed baseline, kept as a stream runs.

    What is kept of a window are counts: of fixed bins for each numeric column and of
    categories for the others.  Counts add up, so each micro-batch writes its own under
    its batch number (a batch that is run again overwrites them), late rows just add to
    their window, and ``report`` of what is there equals the batch computation."""

    def __init__(self, baseline: DataFrame, ts_col: str, numeric=(), categorical=(), window: str = "1 day", bins: int = 30):
        self.spark, self.ts_col, self.window, self.bins = baseline.sparkSession, ts_col, window, bins
        self.numeric, self.categorical = list(numeric), list(categorical)
        finite = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in self.numeric}
        row = baseline.agg(F.count(F.lit(1)), *[f(x).alias(f"{n}_{c}") for c, x in finite.items() for n, f in (("low", F.min), ("high", F.max))]).first()
        self.range = {c: (row[f"low_{c}"] or 0.0, row[f"high_{c}"] or 0.0) for c in self.numeric}
        self.base = cut_lineage(self._long(baseline).groupBy("column", "bin", "category").agg(F.count(F.lit(1)).alias("n_ref")))

    def _long(self, df: DataFrame, *keep) -> DataFrame:
        none_bin, none_cat = F.lit(None).cast("int"), F.lit(None).cast("string")
        cells = [F.struct(F.lit(c).alias("column"), bin_of(c, *self.range[c], self.bins).alias("bin"), none_cat.alias("category")) for c in self.numeric]
        cells += [F.struct(F.lit(c).alias("column"), none_bin.alias("bin"), F.coalesce(F.col(c).cast("string"), F.lit("__nan__")).alias("category"))
                  for c in self.categorical]
        return df.select(*keep, F.inline(F.array(*cells))).where("bin is not null or category is not null")

    def counts(self, df: DataFrame) -> DataFrame:
        """(window_start, column, bin, category, n_cur) of some rows."""
        d = event_time(df, self.ts_col).withColumn("_w", F.window("_et", self.window))
        return (self._long(d.withColumn("window_start", _to_ntz("_w.start")), "window_start")
                .groupBy("window_start", "column", "bin", "category").agg(F.count(F.lit(1)).alias("n_cur")))

    def run(self, stream: DataFrame, state: str, checkpoint: str) -> None:
        """Add everything that is available in ``stream`` to the counts under ``state``."""
        def add(batch: DataFrame, number: int) -> None:
            self.counts(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")
        q = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    def state(self, path: str) -> DataFrame:
        return (self.spark.read.parquet(path).groupBy("window_start", "column", "bin", "category")
                .agg(F.sum("n_cur").alias("n_cur")))

    def report(self, counts: DataFrame) -> DataFrame:
        """(window_start, column, test, statistic, n_cur): the Kolmogorov-Smirnov distance
        over the bins, or chi-square over the categories."""
        counts = cut_lineage(counts)
        out = None
        for c in self.categorical:
            base = self.base.where(F.col("column") == c).select("category", "n_ref")
            found = chi2_by_window(counts.where(F.col("column") == c).select("window_start", "category", "n_cur"), base)
            part = found.select("window_start", F.lit(c).alias("column"), F.lit("chi2").alias("test"), "statistic", "n_cur")
            out = part if out is None else out.unionByName(part)
        if self.numeric:
            found = self._ks(counts)
            out = found if out is None else out.unionByName(found)
        return out

    def _ks(self, counts: DataFrame) -> DataFrame:
        """The largest gap of the cumulated shares, from one array of bins for each window."""
        edge = F.sequence(F.lit(-1), F.lit(self.bins))

        def cumulated(df: DataFrame, n: str, *keys: str) -> DataFrame:
            of = F.map_from_entries(F.collect_list(F.struct("bin", n)))  # at most bins + 2 entries
            g = df.where("bin is not null").groupBy(*keys).agg(of.alias("_m"), F.sum(n).cast("double").alias(f"{n}_sum"))
            per_bin = F.transform(edge, lambda b: F.coalesce(F.element_at("_m", b), F.lit(0)))
            g = g.withColumn("_m", per_bin)
            # shares up to each bin
            upto = F.transform(F.sequence(F.lit(1), F.lit(self.bins + 2)),
                               lambda k: F.aggregate(F.slice("_m", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x) / F.col(f"{n}_sum"))
            return g.select(*keys, upto.alias(f"{n}_cum"), f"{n}_sum")

        base = cumulated(self.base, "n_ref", "column")  # a row for each column
        cur = cumulated(counts, "n_cur", "window_start", "column")
        gap = F.array_max(F.transform(F.arrays_zip("n_ref_cum", "n_cur_cum"), lambda z: F.abs(z["n_ref_cum"] - z["n_cur_cum"])))
        return cur.join(F.broadcast(base), "column").select("window_start", "column", F.lit("ks").alias("test"), gap.alias("statistic"),
                                                            F.col("n_cur_sum").cast("long").alias("n_cur"))


def run_available_now(stream_df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
                      mode: str = "append", partition_by=()) -> None:
    """Drive a streaming query over everything available, then stop."""
    w = stream_df.writeStream.format(fmt).option("path", sink_path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    q = w.outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def score_stream(spark: SparkSession, source_dir: str, schema, transform, sink_path: str, checkpoint: str,
                 partition_by=("date",)) -> None:
    """Files arriving in ``source_dir`` -> ``transform`` (scoring and log
    shaping) -> appended to the telemetry table, exactly once by checkpoint."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    run_available_now(transform(src), sink_path, checkpoint, partition_by=partition_by)


def dedupe_stream(stream_df: DataFrame, key: str, ts_col: str, watermark: str = "1 day") -> DataFrame:
    """Drop repeated deliveries of the same event id within the watermark."""
    d = event_time(stream_df, ts_col)
    return d.withWatermark("_et", watermark).dropDuplicatesWithinWatermark([key]).drop("_et")


def stream_scratch(spark: SparkSession, name: str) -> dict:
    root = shared_dir(spark, name)
    return {"source": f"{root}/source", "sink": f"{root}/sink", "checkpoint": f"{root}/checkpoint"}
