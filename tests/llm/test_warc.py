import hashlib

from pyspark.sql import functions as F

from tablewright.llm import warc

SCHEMA = "page_id long, url string, html string, file string, n int"
FAKE = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc"


def expected(rows):
    out = []
    for k, _, h, *_ in rows:
        b = (h or "").encode()
        top = max([x[0] for x in rows if (x[2] or "").encode() == b and x[0] is not None], default=None)
        again = len(b) >= 1000 and k != top
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def found(spark, rows, parts=1):
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    assert got.where(~F.col("intact")).isEmpty()
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str)


def test_payloads_that_look_like_archives(spark):
    big = "é" * 600
    rows = [(1, "http://a/", "x" + FAKE * 3 + "y", "", 1), (2, None, None, "", 1), (3, "http://b/ c\r\nd", "\r\n\r\n", "", 1), (4, "u", FAKE, "", 1), (5, "u", "x\r\n", "", 1), (6, "u", big, "", 1), (7, "u", big, "", 1), (8, "u", big + "z", "", 1),
            (None, "u", big, "", 1), (10, "u", "WARC/1.0\r\n" * 3 + "\r\n\r\nWARC/1.0\r\n" * 5, "", 1), (11, "u", "q" * 70000 + FAKE + "é" * 9, "", 1), (12, "u", "tail", "", 1)]
    for parts in (1, 3):
        assert found(spark, rows, parts) == expected(rows)


def test_splits_inside_records(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = [(i, "u", ("z%d" % i) * (i * 37 % 900) + FAKE * (i % 3), "", 1) for i in range(60)]
        assert found(spark, rows, 2) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_no_pages(spark):
    assert found(spark, []) == []
