"""Operator 9: a content-addressed WARC archive.

``payloads``  digest, payload: every distinct payload once, under its SHA-256.
``records``   record_id, digest, header, http: the exact WARC header of every record
              and the HTTP response header that its block begins with.

Of the records that share a payload of at least ``min_revisit`` bytes the one
with the smallest id is the response and the others revisit it; records of
smaller payloads are all responses.  ``reconstruct`` joins headers and payloads
into whole records again.  A payload read back is digested anew and compared
with its address, and writing fails if two payloads share an address.

A null payload is empty; a null url is left out of the header; a null id comes
after all others (it revisits the smallest id, and is a response where there is
none) and is named ``none``; payloads of any length are stored whole; rows that repeat an id and payload are equal records, all of the same
type; an empty table gives an empty archive.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialise

MIN_REVISIT = 100
CRLF = "\r\n"


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def _http(size: Column) -> Column:
    """The HTTP header of a page, which a response holds before its payload and a revisit alone."""
    return F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
                    size.cast("string"), F.lit(CRLF * 2))


def _header(record_id: Column, url: Column, digest: Column, size: Column, kind: Column, refers_to: Column, date: Column) -> Column:
    """The mandatory fields (type, id, date, length) and those of a response or revisit.
    ``Content-Type`` and ``Content-Length`` are the block's: HTTP header and payload."""
    safe = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    block = F.length(_http(size)) + F.when(kind == "revisit", F.lit(0)).otherwise(size)
    return F.concat(
        F.lit("WARC/1.1" + CRLF), _field("WARC-Type", kind), _field("WARC-Record-ID", F.coalesce(urn(record_id), F.lit("<urn:record:none>"))),
        _field("WARC-Date", date), _field("WARC-Target-URI", safe), _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        _field("WARC-Refers-To", urn(refers_to)),
        _field("WARC-Profile", F.when(kind == "revisit", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF), _field("Content-Length", block.cast("string")), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: dt.datetime | None = None) -> None:
    """Write ``payloads`` and ``records`` below ``path``.  ``date`` is when the pages were
    fetched (now, if not given)."""
    fetched = F.lit((date or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"))
    rows = pages.select(F.col(id_col).alias("record_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    # the narrow facts are found once; payloads are not shuffled for them
    facts = materialise(rows.select("record_id", "url", F.sha2("payload", 256).alias("digest"), F.length("payload").alias("size"),
                                    F.xxhash64("payload").alias("check")), "warc-facts")
    stored = materialise(facts.groupBy("digest").agg(
        F.min("record_id").alias("first"), F.min("size").alias("size"),
        ((F.min("size") == F.max("size")) & (F.min("check") == F.max("check"))).alias("same")), "warc-stored")
    if not stored.filter(~F.col("same")).isEmpty():
        raise ValueError("two different payloads have the same digest")
    # equal addresses hold equal payloads, so any row's will do: copies go before the shuffle
    (rows.select(F.sha2("payload", 256).alias("digest"), "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads"))
    revisit = (F.col("size") >= min_revisit) & F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    (facts.join(stored.select("digest", "first"), "digest")
     .select("record_id", "digest", _header(F.col("record_id"), F.col("url"), F.col("digest"), F.col("size"), kind,
                                            F.when(revisit, F.col("first")), fetched).alias("header"), _http(F.col("size")).alias("http"))
     .write.parquet(f"{path}/records"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Records parsed from their headers: record_id, url, digest, payload_bytes, record_type, refers_to, header, http."""
    def field(name: str, of: str = "header") -> Column:
        found = F.regexp_extract(of, rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(found != "", found)

    urn = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    return spark.read.parquet(f"{path}/records").select(
        number(urn(field("WARC-Record-ID"))).alias("record_id"), field("WARC-Target-URI").alias("url"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"),
        field("Content-Length", "http").cast("long").alias("payload_bytes"),
        field("WARC-Type").alias("record_type"), number(urn(field("WARC-Refers-To"))).alias("refers_to"), "header", "http")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each verified against its address: digest, payload."""
    found = spark.read.parquet(f"{path}/payloads")
    return found.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload"))
                            .otherwise(F.raise_error(F.concat(F.lit("payload does not match "), F.col("digest"))).cast("binary")))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Whole records: headers joined with payloads; ``record`` holds the bytes of
    the record itself (a revisit has no payload), ``payload`` those of the page."""
    end = F.lit((CRLF * 2).encode())
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return (read_headers(spark, path).join(read_payloads(spark, path), "digest")
            .withColumn("record", F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, end)))
