"""Rows with null keys, long chains, late versions and array documents are kept."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics, neighbors, ordering, split
from tessera.operators.aggregates import exact_quantiles
from tessera.operators.features import FeaturePipeline
from tessera.operators.graph import connected_components
from tessera.session import shared_dir
from tessera.sources.lake import Lake


@pytest.fixture
def with_nulls(spark):
    return spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 3}", float(i % 17)) for i in range(100)], "id long, g string, v double").repartition(4)


def test_null_groups_are_ranked(with_nulls):
    d = with_nulls.withColumn("h", F.md5(F.col("id").cast("string")))
    for ranked in (ordering.hash_rank(d, "h", ["id"], ["g"]), ordering.range_rank(d, ["v", "id"], ["g"])):
        rows = ranked.collect()
        assert len(rows) == 100
        assert sorted(r["rank"] for r in rows if r["g"] is None) == list(range(1, 21))
    assert ordering.group_count(with_nulls, ["g"]).where("g is null").first()["_group_n"] == 20


def test_null_groups_keep_running_values_and_quantiles(with_nulls):
    ranked = ordering.range_rank(with_nulls, ["id"], ["g"])
    run = ordering.running_agg(ranked, ["g"], "rank", "v", "max", "best", block=7)
    assert run.count() == 100 and run.where("g is null").agg(F.max("best")).first()[0] == with_nulls.where("g is null").agg(F.max("v")).first()[0]
    q = {r["g"]: r["q"] for r in exact_quantiles(with_nulls, "v", [0.5], ["g"], "q").collect()}
    assert set(q) == {None, "g0", "g1", "g2"}


def test_null_strata_are_split(with_nulls):
    out = split.stratified_kfold(with_nulls, 4, "id", "g")
    assert out.count() == 100


def test_dbscan_chain_is_one_cluster(spark):
    points = spark.createDataFrame([(i, float(i), 0.0) for i in range(500)], "id long, x double, y double")
    out = neighbors.dbscan(points, "id", ["x", "y"], eps=1.1, min_samples=2)
    assert [r["cluster"] for r in out.select("cluster").distinct().collect()] == [0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}


def test_discounts_of_long_ties_in_constant_memory(spark):
    import math
    cases = [(1, 5), (1, 3000), (900, 5000), (2000, 2001), (5000, 200_000), (1, 1_000_000)]
    df = spark.createDataFrame(cases, "a long, b long")
    for r in df.select("a", "b", metrics._discounts(F.col("a"), F.col("b")).alias("s")).collect():
        expected = math.fsum(1 / math.log2(i + 1) for i in range(r["a"], r["b"] + 1))
        assert abs(r["s"] - expected) < 1e-8 * max(1, expected)
    far = spark.createDataFrame([(1, 10**12)], "a long, b long").select(metrics._discounts(F.col("a"), F.col("b"))).first()[0]
    assert 2.4e10 < far < 2.7e10


def test_row_id_is_no_feature(spark):
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], str(i % 2)) for i in range(60)], "id long, v double, c string, y string")
    fitted = FeaturePipeline(target="y", id_col="id").fit(df)
    assert not any("id" == n for n in fitted.feature_names())
    assert "id" in fitted.transform(df).columns


def test_latest_version_after_ten_saves(spark):
    lake = Lake(spark, shared_dir(spark, "lake"))
    for i in range(11):
        lake.save(spark.range(i + 1), "x", version="v_20240101_000000")
    assert lake.load("x").count() == 11
    lake.save(spark.range(50), "x", version="v_20240101_000001")
    assert lake.load("x").count() == 50


def test_files_as_versions(spark, tmp_path):
    lake = Lake(spark, shared_dir(spark, "lake"))
    (tmp_path / "a.json").write_text('[\n {"a": 1,\n  "b": "x"},\n {"a": 2, "b": "y"}\n]\n')
    (tmp_path / "b.csv").write_text("a,b\n1,x\n2,y\n3,z\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("one.txt", "1")
        z.writestr("two.txt", "2")
    for i, (name, rows) in enumerate([("a.json", 2), ("b.csv", 3), ("c.zip", 2)]):
        v = lake.save_file(str(tmp_path / name), "files", f"v_20240101_00000{i}")
        assert lake.list_versions("files")[0] == v
        df = lake.load("files")
        assert df.count() == rows and "_corrupt_record" not in df.columns
    lines = spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "value string")
    lines.write.text(f"{lake.base}/lines/v_20240101_000000.json")
    assert lake.load("lines").count() == 2


def test_late_rows_are_all_rows_before_the_cut(spark, sf):
    import __spark_entry__ as entry
    got = entry.queries()["K05_late_rows"](spark, sf).first()
    late = spark.read.parquet(f"{sf}/events.parquet").where("ts < timestamp_ntz '2024-01-20'")
    assert got.late_rows == late.count()
    assert got.dropped_rows == got.late_rows  # row by row
