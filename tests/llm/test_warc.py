import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from logsluice.llm import warc as W
from logsluice.llm.common import scratch
from helpers import rows_of

FAKE = W.MAGIC + "WARC-Type: response\r\nWARC-Page-Id: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [
    (1, "http://a/", "plain"), (2, None, None), (3, "u", FAKE + FAKE), (4, "u", "x" + FAKE + "y"), (5, "u", W.MAGIC), (6, "u", ""),
    (7, "u", "plain"), (8, "u\r\nX: 1", "zz" * 70000 + W.MAGIC + "q" * 50), (None, "u", "plain"), (9, "u", FAKE[:-4]),
    (10, "u", "é\u0000\r\n\r\n"), (3, "u", FAKE + FAKE), (11, "u", "\r\n\r\n" + FAKE), (None, "u", "only null ids"), (None, "u", "only null ids"),
]


def expected(rows, min_bytes=0):
    first, out = {}, []
    for i, _, h in rows:
        key = (h or "").encode()
        if i is not None and len(key) >= min_bytes:
            first[key] = min(first.get(key, i), i)
    for i, _, h in rows:
        key = (h or "").encode()
        again = key in first and i != first[key]
        digest = base64.b32encode(hashlib.sha1(key).digest()).decode()
        out.append((i, len(key), digest, "revisit" if again else "response", first[key] if again else None))
    return sorted(out, key=repr)


def read_back(df):
    return rows_of(df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


@pytest.fixture(params=["128m", "64k", "700"])
def split(request, spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_magic_in_payloads(spark, split):
    rows = ROWS if split != "700" else [r for r in ROWS if r[0] != 8]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumns({"bytes": F.lit("x"), "first": F.lit(1)})
    assert read_back(W.round_trip(df)) == expected(rows)


def test_payloads_and_least_size(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    folder = scratch(spark, "warc-test")
    W.write_archives(df, folder, min_bytes=6)
    out = W.read_archives(spark, folder, with_payload=True)
    assert read_back(out) == expected(ROWS, 6)
    texts = {(r[0], (r[2] or "").encode()) for r in ROWS}
    for r in out.where("record_type = 'response'").collect():
        assert (r.page_id, bytes(r.payload)) in texts


def test_foreign_archive_and_broken_chain(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Type: response\r\ncontent-length:  3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((good + "junk" + good).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + good).encode())
    (tmp_path / "c.warc").write_bytes((good + good).encode())
    out = W.read_archives(spark, f"file://{tmp_path}").collect()
    assert sorted((r.file[-6:], r.offset, r.payload_bytes) for r in out) == [("a.warc", 0, 3), ("c.warc", 0, 3), ("c.warc", len(good), 3)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_back(W.round_trip(empty)) == []
