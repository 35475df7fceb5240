"""Archives written and read back, whole and in small ranges."""

import base64
import gzip
import hashlib
import io
import zlib

import pytest

from sweepframe.llm import warc

PAGES = [
    (1, "http://a.example/x y\n", "<p>one</p>"),
    (2, "http://a.example/é", "<p>one</p>"),
    (3, None, None),
    (4, "u", ""),
    (5, "u", "<p>unique é 中</p>" * 50000),
    (6, "u", "WARC/1.1\r\n\r\n\x1f\r\n\r\n"),
    (7, "u", "<p>one</p>"),
    (7, "u", "<p>one</p>"),
    (0, "u", "<p>two</p>"),
    (0, "u", "<p>two</p>"),
    (None, "u", "<p>two</p>"),
    (None, "u", "no other"),
]


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, same string"
    )


def expected(rows, least=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [k for k, _, h in rows if (h or "") == (html or "") and k is not None]
        first = min(ids, default=None)
        revisit = len(data) >= least and first is not None and i != first
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((str(i) if i is not None else None, len(data), sha, "revisit" if revisit else "response",
                    str(first) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,range_bytes,file_bytes", [(0, 1 << 20, 1 << 30), (0, 97, 900), (5, 50, 1), (20, 4096, 1 << 30)])
def test_round_trip(spark, tmp_path, least, range_bytes, file_bytes):
    manifest = warc.write(pages(spark, PAGES), f"{tmp_path}/w", least=least, file_bytes=file_bytes)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    got = warc.read(manifest, range_bytes).collect()
    found = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(found, key=str) == expected(PAGES, least)
    texts = {(p, r) for p, r, _, k in ((str(i) if i is not None else None, (h or "").encode(), u, h) for i, u, h in PAGES)}
    assert all((r.page, bytes(r.payload)) in texts for r in got if r.record_type == "response")


def test_ranges_are_read_by_as_many_tasks_as_asked_for(spark, tmp_path):
    manifest = warc.write(pages(spark, [(k, "u", f"page {k} " * 40) for k in range(600)]), f"{tmp_path}/w")
    total = manifest.agg({"bytes": "sum"}).first()[0]
    ranges = warc.read(manifest, total // 1000, tasks=300)
    assert ranges.rdd.getNumPartitions() == 300
    spread = ranges.selectExpr("spark_partition_id() p").groupBy("p").count().collect()
    assert len(spread) > 200 and sum(r["count"] for r in spread) == 600
    assert warc.read(manifest).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_files_are_plain_gzip(spark, tmp_path):
    manifest = warc.write(pages(spark, PAGES).coalesce(1), f"{tmp_path}/w")
    for row in manifest.collect():
        data = gzip.open(row.file).read()
        assert data.count(b"WARC/1.1\r\nWARC-Type") == row.records


def test_orphans_are_not_read(spark, tmp_path):
    manifest = warc.write(pages(spark, PAGES), f"{tmp_path}/w")
    (tmp_path / "w" / "left.warc.gz").write_bytes(warc.record("99", None, b"lost", None))
    assert warc.read(manifest).where("page = '99'").count() == 0


def test_magic_that_is_no_record():
    class File(io.BytesIO):
        def read_at(self, n, start):
            return self.getvalue()[start : start + n]

    other = zlib.compressobj(6, zlib.DEFLATED, 31)
    other = other.compress(b"not a record") + other.flush()
    inside = warc.record("1", None, b"a", None)
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = stored.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" + warc.MAGIC) + stored.flush()
    data = warc.MAGIC + b"junk" + inside + warc.MAGIC + other + stored + inside[:40] + inside
    for step in (1, 3, 7, 64, 4096):
        for piece in (8, 1 << 20):
            found = []
            for start in range(0, len(data), step):
                found += warc.records(warc.Source(File(data), len(data), piece), start, min(start + step, len(data)))
            assert len(found) == 3, (step, piece)


def test_empty(spark, tmp_path):
    manifest = warc.write(pages(spark, []), f"{tmp_path}/w")
    assert warc.read(manifest).collect() == []
