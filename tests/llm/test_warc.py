import hashlib

from triagelake.llm import warc
from triagelake.llm.common import scratch

BIG = "x" * 100
ODD = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
ROWS = [
    (5, "u5", BIG), (3, "u3", BIG), (9, None, BIG), (None, "n", BIG), (3, "u3", BIG), (1, "a\r\nb", "x" * 99), (2, "", "x" * 99), (4, "e", ""), (6, "e", None),
    (7, "o", ODD), (8, "o", ODD), (10, "t", "a\n" * 80), (11, "t", "a\r" * 80), (12, "t", "a\r\n" * 80), (13, "é", "é" * 60), (14, "é", "é" * 60), (15, "n", "\n"), (16, "n", "\r"), (17, "L", "long " * 500_000),
]


def want(rows):
    out = []
    for p, _, t in rows:
        b = (t or "").encode()
        same = [q for q, _, u in rows if (u or "").encode() == b and q is not None]
        again = len(b) >= 100 and min(same) != p
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", warc.F.lit(1)).withColumn("salt", warc.F.lit("s"))
    path = scratch(spark, "warc")
    warc.write(df, path)
    assert sorted((tuple(r) for r in warc.resolved(spark, path).collect()), key=str) == want(ROWS)
    texts = {r.page_id: r.payload for r in warc.read(spark, path).filter("record_type = 'response'").collect()}
    assert all(texts[p] == (t or "") for p, _, t in ROWS if p in texts)


def test_empty(spark):
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(spark, path).count() == 0


def test_headers(spark):
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame([(2, "http://b", BIG), (1, "http://a", BIG)], "page_id long, url string, html string"), path, date="2025-02-03T04:05:06Z")
    raw = "\n".join(r.value for r in spark.read.option("lineSep", "\n").text(path).collect())
    one, two = sorted(raw.split("WARC/1.1\r")[1:])
    assert "WARC-Type: response" in one and "HTTP/1.1 200 OK" in one and "Content-Type: application/http; msgtype=response" in one and f"Content-Length: {len(warc.HTTP) + 100}\r" in one
    assert "WARC-Refers-To: <urn:page:1>" in two and "WARC-Refers-To-Target-URI: http://a" in two and "WARC-Refers-To-Date: 2025-02-03T04:05:06Z" in two and "Content-Length: 0\r" in two
