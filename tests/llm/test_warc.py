import gzip
import hashlib
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

PAGES = "page_id long, url string, html string, extra string"


def test_read_range_owns_each_record_once():
    rng = __import__("random").Random(5)
    members = [warc._record(k, "http://x", rng.randbytes(rng.choice((0, 10, 3000))), "0", None) for k in range(40)]
    # a member whose stored block holds a whole other member, bytes that look like a start
    tricky = zlib.compressobj(0, zlib.DEFLATED, 31)
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n" + members[3] + b"\x1f\x8b\x08junk"
    tricky = tricky.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n") + tricky.flush()
    members.insert(7, tricky)
    data = b"".join(members)
    starts = [sum(map(len, members[:k])) for k in range(len(members))]
    for step in (1, 7, 100, 5000, len(data) + 5):
        if step == 1:
            ranges = [(s, s + 1) for s in range(starts[5], starts[9])]
            want = starts[5:9]
        else:
            ranges, want = [(s, min(s + step, len(data))) for s in range(0, len(data), step)], starts
        got = [at for a, b in ranges for at, _, _ in warc.read_range(io.BytesIO(data), a, b)]
        assert got == want, step
    assert len(gzip.decompress(data)) > 0


def test_round_trip(spark):
    big, twice = "é" * 700, "t" * 2000
    rows = [
        (1, "http://a/1", big, "x"), (2, "http://a/ 2\r\nX: y", big, None), (3, None, "short", "x"), (4, "u", "short", "x"), (5, "u", None, "x"), (6, "u", "", "x"),
        (7, "u", twice, "x"), (9, "u", twice, "x"), (8, "u", twice, "x"), (8, "u", twice, "x"), (None, "u", twice, "x"), (10, "u", "ab\r\n\r\ncd" * 300, "x"),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    out = warc.round_trip(spark, pages).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.record_id, []).append(r)
    html = {str(p) if p is not None else "": (h or "").encode() for p, _, h, _ in rows}
    for k, some in by.items():
        for r in some:
            assert r.payload_bytes == len(html[k]) and r.payload_digest == hashlib.sha1(html[k]).hexdigest()
            assert r.payload == (None if r.record_type == "revisit" else html[k])
    kinds = {k: (some[0].record_type, some[0].refers_to) for k, some in by.items()}
    assert kinds["1"] == ("revisit", "2") and kinds["2"] == ("response", None)
    assert kinds["3"] == kinds["4"] == kinds["9"] == ("response", None)
    assert kinds["7"] == kinds["8"] == ("revisit", "9") and len(by["8"]) == 2
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    assert warc.round_trip(spark, pages.select("html", "page_id")).count() == len(rows)


def test_many_splits_and_files(spark):
    pages = spark.createDataFrame([(k, "u", os.urandom(900).hex()) for k in range(200)], "page_id long, url string, html string")
    folder = f"{warc.shared_dir(spark)}/many-warcs"
    manifest = warc.write_archives(warc.plan_revisits(pages), folder, max_bytes=20_000)
    assert manifest.count() > 4
    got = warc.read_archives(manifest, split_bytes=3_000)
    assert sorted(int(r.record_id) for r in got.collect()) == list(range(200))
    assert got.select("warc_path", "warc_offset").distinct().count() == 200


def test_query_with_null_ids_reads_in_many_tasks(spark, tmp_path):
    from tidemark.llm.queries import op7_warc

    rows = [(1, "u", "a" * 1500), (None, "u", "b" * 1500), (None, None, None), (7, "u", "a" * 1500)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in op7_warc(spark, str(tmp_path)).collect()))
    assert got == [(0, 0, "response", None), (0, 1500, "response", None), (1, 1500, "revisit", 7), (7, 1500, "response", None)]
    pages = spark.createDataFrame([(k, "u", os.urandom(900).hex()) for k in range(100)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.plan_revisits(pages), f"{warc.shared_dir(spark)}/split-warcs")
    tasks = warc.read_archives(manifest, split_bytes=10_000).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 3
