import base64
import glob
import gzip
import hashlib
import time

from pyspark.sql import functions as F

from wordreel.llm import warc

SCHEMA = "page_id bigint, url string, html string, block string, total int, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "b", 1, 2) for i, u, h in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, "http://a/3", None),
    (4, None, ""), (5, "http://ü/5?x\r\ny: z", "été 😀 " * 5_000),
    (6, "http://a/6", "WARC/1.1\r\nWARC-Type: response\r\n\r\nWARC/1.1\r\n"),
    (7, "http://a/7", "line\r\n\r\nline\r\n0\r\n\r\n"), (8, "http://a/8", "x" * 4096),
    (9, "http://a/9", "WARC/1.WARC/1.1\r\nWARC/1.1" * 900), (1, "http://a/1", "<p>one</p>"),
    (10, "http://a/WARC/1.1", "a\u0000b"),
]


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(i, first.get(h or "", i))
    out = set()
    for i, _, h in pages:
        n = len((h or "").encode())
        again = n >= least and first[h or ""] != i
        out.add((i, n, digest(h), "revisit" if again else "response",
                 first[h or ""] if again else None))
    return out


def found(rows):
    return {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"],
             r["refers_to"]) for r in rows}


def test_odd_pages(spark, tmp_path):
    rows = warc.archive(frame(spark, PAGES).repartition(3), str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES) and all(r["complete"] for r in rows)
    assert found(rows) == expected(PAGES)
    text = {i: h for i, _, h in PAGES}
    for r in rows:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == (text[r["page_id"]] or "")


def test_small_segments_and_chunks(spark, tmp_path):
    rows = warc.archive(frame(spark, PAGES), str(tmp_path / "w"), segment=61, chunk=7,
                        least_revisit=5).collect()
    assert all(r["complete"] for r in rows)
    assert found(rows) == expected(PAGES, 5)


def test_very_long_page(spark, tmp_path):
    """A page of 32 MB: every byte is copied a few times, not once per chunk or segment."""
    text = "".join(f"line {i} of a long page\r\n" for i in range(1_200_000))
    pages = [(1, "http://a/1", text), (2, "http://a/2", "short")]
    start = time.time()
    rows = warc.archive(frame(spark, pages), str(tmp_path / "w")).drop("payload").collect()
    assert all(r["complete"] for r in rows)
    assert found(rows) == expected(pages)
    assert time.time() - start < 120


def test_payload_of_other_writers():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n"
    assert warc.payload_of(head + b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\n\r\n") == b"abc0123456789"
    assert warc.payload_of(head + b"3\r\nabc\r\nzz") == b"abc"
    assert warc.payload_of(head) == b"" and warc.payload_of(b"") == b""
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n3\r\nabc\r\n") == b"3\r\nabc\r\n"


def test_no_pages(spark, tmp_path):
    assert warc.archive(frame(spark, []), str(tmp_path / "w")).count() == 0


def test_files_hold_whole_records(spark, tmp_path):
    warc.write(frame(spark, PAGES).coalesce(1), str(tmp_path / "w"), segment=500)
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    n = 0
    while data:         # a reader that trusts nothing but Content-Length
        head, _, data = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert data[length:length + 4] == b"\r\n\r\n"
        data = data[length + 4:]
        n += 1
    assert n > len(PAGES)


def test_missing_segment_shows(spark, tmp_path):
    warc.write(frame(spark, PAGES[4:5]), str(tmp_path / "w"), segment=1_000)
    records = warc.read_records(spark, str(tmp_path / "w"))
    number = F.coalesce(F.col("header")["warc-segment-number"].cast("int"), F.lit(0))
    assert [r["complete"] for r in warc.reassembled(records).collect()] == [True]
    assert [r["complete"] for r in warc.reassembled(records.filter(number != 3)).collect()] == [False]
    last = records.agg(F.max(number)).first()[0]
    assert [r["complete"] for r in
            warc.reassembled(records.filter(number != last)).collect()] == [False]


def test_digest_is_base32(spark):
    df = spark.createDataFrame([("",), ("abc",), ("é" * 99,)], "t string")
    for r in df.select("t", warc.payload_digest(F.col("t")).alias("d")).collect():
        assert r["d"] == digest(r["t"])
