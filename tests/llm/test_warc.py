import collections
import gzip
import hashlib
import random
import re
import time

from echosieve.llm.common import Scratch
from echosieve.llm.warc import _headers, archive_pages, read_archives


def brute(rows):
    body = {i: (h or "").encode() for i, h in rows}
    keeper = {}
    for i, b in body.items():
        if len(b) >= 1000:
            keeper[b] = max(keeper.get(b, i), i)
    out = {}
    for i, b in body.items():
        k = keeper.get(b, i)
        out[i] = (len(b), hashlib.sha1(b).hexdigest(), "response" if k == i else "revisit", None if k == i else k)
    return out


def got(df):
    rows = df.collect()
    out = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == len(out)
    return out


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    assert got(archive_pages(pages)) == brute([(r["page_id"], r["html"]) for r in pages.collect()])


def test_edges(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big = "é" * 700
    rows = [(1, None), (2, ""), (3, fake * 3), (4, fake[:-1]), (5, big), (6, big), (7, big), (8, "a" * 999), (9, "a" * 999), (10, "WARC/1.1\r\n" * 50), (11, "z" * 3_000_000), (12, "\r\n\r\n" + fake), (13, "WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n")]
    rows += [(20 + k, f"<p>{k}</p>" * 300) for k in range(2500)]
    df = spark.createDataFrame([(i, h, "http://x/\r\ny" if i % 2 else None, "d", 3) for i, h in rows], "page_id long, html string, url string, digest string, size int").repartition(2)
    assert got(archive_pages(df)) == brute(rows)
    assert got(archive_pages(df.where("false"))) == {}


def test_foreign_archive_in_small_chunks(spark, tmp_path):
    record = lambda i, b: b"WARC/1.0\r\nWARC-Type: response\r\nX-Page-ID: %d\r\nContent-Length: %d\r\n\r\n" % (i, len(b)) + b + b"\r\n\r\n"
    inner = record(77, b"inner")
    data = b"".join(record(i, inner * (i % 4)) for i in range(200))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data + record(500, b"x")[:-2]))  # the last one is cut short
    rows = read_archives(spark, str(tmp_path), Scratch(spark, "t"), chunk=700).collect()
    assert collections.Counter(r["page"] for r in rows) == {i: 2 for i in range(200)}


def test_header_of_any_length(spark):
    rows = [(k, f"<p>{k}</p>", "http://x/" + "a" * (3 << 20 if k == 4 else 5)) for k in range(12)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string").coalesce(1)
    assert got(archive_pages(df)) == brute([r[:2] for r in rows])


def test_magic_lines_by_the_million(spark):
    lines = "WARC/1.1\r\n" * 1_000_000  # 10 MB that are one long header
    rows = [(1, lines), (2, lines + "Content-Length: 3\r\n\r\nabc\r\n\r\n"), (3, "x: WARC/1.1\r\n" * 50_000), (4, "plain")]
    df = spark.createDataFrame([(i, h, "u") for i, h in rows], "page_id long, html string, url string")
    began = time.time()
    assert got(archive_pages(df)) == brute(rows)
    assert time.time() - began < 60


def test_headers_equal_a_plain_reading():
    rng = random.Random(3)
    pieces = [b"WARC/1.1\r\n", b"WARC/1.0\r\n", b"Content-Length: 4\r\n", b"content-length:  12 \r\n", b"X-Page-ID: 7\r\n", b"X-Page-ID: 8\r\n", b"\r\n", b"\r", b"a: b\r\n", b"x", b"WARC-Type: WARC/1.1\r\n"]
    for _ in range(400):
        data = b"".join(rng.choices(pieces, k=40))
        want = []
        for m in re.finditer(rb"WARC/1\.[01]\r\n", data):
            end = data.find(b"\r\n\r\n", m.start())
            raw = data[m.start() : end + 2]
            n = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*(?=\r\n)", raw)
            if end >= 0 and n:
                fields = {}
                for line in raw.split(b"\r\n")[1:]:
                    name, colon, value = line.partition(b":")
                    if colon and name.strip().lower() in (b"x-page-id", b"warc-type"):
                        fields[name.strip().lower().decode()] = value.strip().decode()
                want.append((m.start(), fields, end + 4, end + 8 + int(n[1])))
        assert _headers(data, 0, len(data)) == want
        half = len(data) // 2
        assert _headers(data, 0, half) + _headers(data, half, len(data)) == want
