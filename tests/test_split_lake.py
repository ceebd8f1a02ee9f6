import pytest
from pyspark.sql import functions as F

from tessera.operators.split import chronological_split, exact_split, kfold, random_split, stratified_kfold
from tessera.session import shared_dir
from tessera.sources.lake import Lake, LakeError, slugify_name, version_key, zip_members


def _ids(df):
    return sorted(r[0] for r in df.collect())


def test_split_same_under_repartition(spark, sf):
    d = spark.read.parquet(f"{sf}/events.parquet")
    runs = [_ids(random_split(d.repartition(n), "event_id", 0.8).where("is_train").select("event_id"))
            for n in (1, 7, 200)]
    assert runs[0] == runs[1] == runs[2]
    e = [_ids(exact_split(d.repartition(n), "event_id", 0.8).where("is_train").select("event_id")) for n in (1, 7)]
    assert e[0] == e[1] and len(e[0]) == round(d.count() * 0.8)


def test_train_test_partition_input(spark, sf):
    d = spark.read.parquet(f"{sf}/orders.parquet")
    s = chronological_split(d, "o_orderdate", "o_orderkey", 0.7)
    tr, te = s.where("is_train"), s.where("NOT is_train")
    assert tr.count() + te.count() == d.count()
    assert tr.join(te, "o_orderkey").count() == 0
    assert tr.agg(F.max("o_orderdate")).first()[0] <= te.agg(F.min("o_orderdate")).first()[0]


def test_folds_partition(spark, sf):
    d = spark.read.parquet(f"{sf}/labels.parquet")
    f = kfold(d, 5, "doc_id")
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sum(sizes) == d.count() and sizes[-1] - sizes[0] <= 1
    s = stratified_kfold(d, 3, "doc_id", "quality")
    assert s.count() == d.count()


def test_lake_round_trip(spark):
    lake = Lake(spark, shared_dir(spark, "lake-test"))
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "feature int, target int")
    v1 = lake.save(df, "my data", version="v_20240101_000000")
    lake.save(df, "my data", version="v_20240102_000000", fmt="csv")
    assert lake.list_datasets() == ["my_data"]
    assert lake.list_versions("my data")[0].startswith("v_20240102")
    assert sorted(tuple(r) for r in lake.load("my data").collect()) == [(1, 0), (2, 1), (3, 0)]
    assert lake.load("my data", version=v1).count() == 3
    assert lake.delete("my data", v1)
    with pytest.raises(LakeError):
        lake.load("my data", version=v1)
    for bad in ("../escape", "a/b", "a\\b"):
        with pytest.raises(LakeError):
            lake.save(df, bad)


def test_zip_members(spark, tmp_path):
    import zipfile
    from tessera.sources.lake import zip_members
    p = tmp_path / "a.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("x.txt", "1")
        z.writestr("d/y.csv", "2")
    got = sorted(r["archive_member"] for r in zip_members(spark, str(tmp_path)).collect())
    assert got == ["d/y.csv", "x.txt"]


def _lake_of(spark, tmp_path, files):
    folder = tmp_path / "lake" / "mixed" / "v_20240101_000000.json"
    folder.mkdir(parents=True)
    for name, text in files.items():
        (folder / name).write_text(text)
    return Lake(spark, str(tmp_path / "lake"))


def test_json_keeps_every_line_beside_a_bad_one(spark, tmp_path):
    lines = [f'{{"a": {k}, "b": "x{k}"}}' for k in range(1000)]
    lines[500] = lines[500][:8]
    lake = _lake_of(spark, tmp_path, {"one.json": "\n".join(lines) + "\n", "two.json": '\n [{"a": 5000},\n{"a": 5001, "c": true}\n]\n',
                                      "three.json": '{\n  "a": 6000\n}\n', "blank.json": "\n\n"})
    rows = lake.load("mixed").collect()
    assert len(rows) == 1003
    assert sorted(r.a for r in rows if r.a is not None) == [*range(500), *range(501, 1000), 5000, 5001, 6000]
    assert [(r.a, r.b, r.c) for r in rows if r.a is None] == [(None, None, None)]
    assert {r.a: r.c for r in rows}[5001] is True


def test_json_can_raise_on_a_bad_line(spark, tmp_path):
    lake = _lake_of(spark, tmp_path, {"one.json": '{"a": 1}\n{"a": \n'})
    with pytest.raises(Exception, match="(?i)malformed"):
        lake.load("mixed", mode="FAILFAST").collect()


def test_broken_array_raises(spark, tmp_path):
    lake = _lake_of(spark, tmp_path, {"one.json": '[{"a": 1},\n{"a": 2'})
    with pytest.raises(Exception, match="(?i)malformed"):
        lake.load("mixed").collect()


def test_unreadable_zip_raises(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="not a zip archive"):
        zip_members(spark, str(tmp_path)).collect()


def test_encodings(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    for name, text in (("cp1252", "a,b\n1,€ “q”\n"), ("latin-1", "a,b\n1,é\n"), ("utf-16", "a,b\n1,é漢\n"), ("utf-8", "a,b\n1,é漢\n")):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
        lake.save_file(str(tmp_path / f"{name}.csv"), f"in {name}")
        assert [tuple(r) for r in lake.load(f"in {name}", encoding=name).collect()] == [(1, text.split(",")[-1].strip())]
    with pytest.raises(LakeError, match="unsupported encoding"):
        lake.load("in utf-8", encoding="klingon")


def test_version_info(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    name = lake.save(spark.range(3), "my data")
    info = lake.version_info("my data", name)
    assert (info["dataset"], info["version"], info["format"]) == ("my_data", name, "parquet")
    with pytest.raises(LakeError):
        lake.version_info("my data", "v_1")
