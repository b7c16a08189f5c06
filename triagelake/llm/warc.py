"""WARC archives with revisit records for payloads that repeat.

Headers (page, SHA-256, length) are shuffled by payload digest: of the records with one payload of at least `least`
bytes the smallest page_id is the response, and the others revisit it. Counting by digest is aggregated before the
shuffle, and the join that brings the decision back runs over headers only; a digest held by many rows is salted, so a
payload that a third of the pages share is spread over `SALTS` keys. The payloads themselves are moved once, by page.

A response holds an HTTP head and the payload; a revisit holds no content and names the response, its URI and its date.
All records of a run bear the date of writing.

Archives are written by Spark's text sink (its committer makes a lost executor's files vanish): a record's text ends
with the blank lines that WARC asks for, and a file is gzip-compressed. They are read back as lines in file order and
framed again by Content-Length, so payloads may hold anything, blank lines and record heads included, and no file is
held in memory. gzip files are not split, so each is read by one task from its start.

Null html: an empty payload. Null page_id: counts as larger than any. Rows that repeat with one page_id and payload:
all responses or all revisits, alike. Empty table: no records. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, small_batches

SALTS = 32
CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}{CRLF}"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_digest string, payload string"


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, digest and length of each payload."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"), _clean(F.col("url")).alias("url"))


def revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, digest, refers_to and refers_url of the records that revisit another, once each."""
    h = headers(pages).filter(F.col("n") >= least)
    last = F.lit(2**63 - 1)
    first = h.groupBy("digest").agg(F.min(F.struct(F.coalesce("page_id", last).alias("page"), "url")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = h.withColumn("salt", F.pmod(F.hash("page_id"), F.lit(SALTS)))
    found = salted.join(first, ["digest", "salt"]).filter(F.coalesce("page_id", last) > F.col("first.page"))
    return found.select("page_id", "digest", F.col("first.page").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")


def records(pages: DataFrame, least: int = 100, date: str | None = None) -> DataFrame:
    """The text of each record, without the blank lines after it; date: of writing, now by default."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    h = pages.select(F.col("page_id").cast("long").alias("page_id"), _clean(F.col("url")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("body"))
    h = h.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256)).withColumn("n", F.octet_length("body"))
    found = revisits(pages, least).withColumnRenamed("page_id", "p").withColumnRenamed("digest", "d")
    h = h.join(found, h.page_id.eqNullSafe(found.p) & (h.digest == found.d), "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("body")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(again, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), name(F.col("refers_to")), F.lit(CRLF + "WARC-Refers-To-Target-URI: "), F.col("refers_url"), F.lit(CRLF + f"WARC-Refers-To-Date: {date}" + CRLF))).otherwise(F.lit(""))
    return h.select(
        F.concat(
            F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")), F.lit(CRLF + "WARC-Record-ID: "), name(F.col("page_id")),
            F.lit(CRLF + f"WARC-Date: {date}" + CRLF + "WARC-Target-URI: "), F.col("url"), F.lit(CRLF), refers, F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"),
            F.lit(CRLF + "X-Payload-Length: "), F.col("n").cast("string"), F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF + CRLF), body,
        ).alias("value")
    )


def write(pages: DataFrame, path: str, least: int = 100, date: str | None = None) -> None:
    records(pages, least, date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


class Framer:
    """Records from lines (without their \\n) in file order."""

    def __init__(self):
        self.head: list[bytes] | None = None
        self.fields: dict[bytes, bytes] = {}
        self.body: list[bytes] = []
        self.missing = 0

    def feed(self, line: bytes) -> tuple[dict[bytes, bytes], bytes] | None:
        if self.head is None:
            if line in (b"\r", b""):
                return None  # the blank lines after a record
            if line != b"WARC/1.1\r":
                raise ValueError(f"a record must begin here, not {line[:60]!r}")
            self.head = []
        elif self.missing <= 0 and line == b"\r" and not self.body:
            self.fields = dict(x.rstrip(b"\r").split(b": ", 1) for x in self.head if b": " in x)
            self.missing = int(self.fields[b"Content-Length"]) + 2  # and the line end after it
            self.body = [b""]
        elif not self.body:
            self.head.append(line)
        else:
            self.body.append(line)
            self.missing -= len(line) + 1
            if self.missing <= 0:
                n = int(self.fields[b"Content-Length"])
                payload = b"\n".join(self.body[1:])[:n]
                done = (self.fields, payload)
                self.__init__()
                return done
        return None


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. payload_digest is the header's; stored_digest that of the stored payload, null for revisits."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        framer, rows, size = Framer(), [], 0

        def flush():
            page, url, kind, refers, n, digest, stored, payload = zip(*rows, strict=True)
            rows.clear()
            return batch(page_id=pa.array(page, pa.int64()), url=pa.array(url, pa.string()), record_type=pa.array(kind, pa.string()), refers_to=pa.array(refers, pa.int64()), payload_bytes=pa.array(n, pa.int64()), payload_digest=pa.array(digest, pa.string()), stored_digest=pa.array(stored, pa.string()), payload=pa.array(payload, pa.string()))

        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None
        for b in batches:
            column = b.column(0).cast(pa.binary())
            for line in column.to_pylist():
                if (got := framer.feed(line)) is None:
                    continue
                f, payload = got
                kind = f[b"WARC-Type"].decode()
                payload = payload.partition(b"\r\n\r\n")[2]
                stored = hashlib.sha256(payload).hexdigest() if kind == "response" else None
                rows.append((number(f[b"WARC-Record-ID"]), f.get(b"WARC-Target-URI", b"").decode(), kind, number(f.get(b"WARC-Refers-To")), int(f[b"X-Payload-Length"]), f[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), stored, payload if kind == "response" else None))
                size += len(payload)
                if size > 4 << 20 or len(rows) >= 5000:
                    yield flush()
                    size = 0
        if framer.head is not None:
            raise ValueError("an archive ends within a record")
        if rows:
            yield flush()

    return spark.read.option("lineSep", "\n").text(path).mapInArrow(run, RECORDS)


def resolved(spark: SparkSession, path: str) -> DataFrame:
    """What the archives say of each page: payload_bytes, payload_digest, record_type and refers_to.

    A response's digest and length are those of the payload read; a mismatch with its headers is an error.
    """
    r = read(spark, path)
    good = (F.col("record_type") == "revisit") | ((F.col("stored_digest") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes")))
    digest = F.when(good, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a payload differs from its header")))
    return r.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
