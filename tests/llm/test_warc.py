import hashlib
import re

import duckdb
import pytest

from tessera.llm import queries as Q
from tessera.llm import warc
from tessera.session import shared_dir


def brute(rows):
    out, first = [], {}
    for i, t in rows:
        p = (t or "").encode()
        if i is not None:
            first[p] = min(i, first.get(p, i))
    for i, t in rows:
        p = (t or "").encode()
        revisit = len(p) >= 100 and p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ROWS = [(3, "x" * 100), (1, "x" * 100), (2, "x" * 99), (9, "x" * 99), (4, None), (5, ""), (6, "é" * 50), (7, "é" * 50), (7, "é" * 50), (None, "é" * 50),
        (None, "y" * 200), (None, "y" * 200), (-8, "x" * 100), (10, "long " * 300_000), (11, "long " * 300_000)]


@pytest.fixture
def folder(spark, tmp_path):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", t) for i, t in ROWS], "page_id long, url string, html string").repartition(4)
    df.withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash")).write.parquet(f"{tmp_path}/w/pages.parquet")
    return str(tmp_path / "w")


def test_query_equals_brute_force(spark, folder):
    assert got(Q.queries()["op9_warc_archive"](spark, folder)) == brute(ROWS)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    expected = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({Q.oracle_sql()['op9_warc_archive']})").fetchall()
    assert got(Q.queries()["op9_warc_archive"](spark, sf)) == sorted(expected, key=str)


def test_records_are_reconstructed(spark, folder):
    path = shared_dir(spark, "test-warc")
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    records = warc.reconstruct(spark, path).collect()
    assert sorted((str(r.record_id), bytes(r.payload)) for r in records) == sorted((str(i), (t or "").encode()) for i, t in ROWS)
    assert spark.read.parquet(f"{path}/payloads").count() == len({t or "" for _, t in ROWS})  # payload bytes once
    for r in records:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head.decode() + "\r\n\r\n" == r.header and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[:-4]
        assert rest.endswith(b"\r\n\r\n") and int(fields["Content-Length"]) == len(body)
        assert "X" not in fields  # a line break in a url does not make a header
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= fields.keys()  # mandatory
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["Content-Type"] == "application/http;msgtype=response"
        http, _, payload = body.partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len(bytes(r.payload))}" in http.decode().split("\r\n")
        assert payload == (bytes(r.payload) if fields["WARC-Type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(bytes(r.payload)).hexdigest()


def test_a_changed_payload_is_found(spark, folder):
    path = shared_dir(spark, "test-warc")
    warc.write_archive(spark.read.parquet(f"{folder}/pages.parquet"), path)
    other = shared_dir(spark, "test-warc")
    spark.read.parquet(f"{path}/payloads").selectExpr("digest", "cast('changed' as binary) as payload").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_payloads(spark, other).collect()


def test_empty_table(spark):
    path = shared_dir(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.reconstruct(spark, path).count() == 0
