"""WARC archives: records written in segments, read back and put together.

A page is an HTTP response in chunked framing. Of equal payloads one page is
archived and the others refer to it. A block longer than `SEGMENT` bytes is cut
into a first record and continuation records that carry the origin's id, their
number and, at last, the total length.

Archives are written and read by Spark's own text source: each record is one
value and the two line ends after a record are the line separator, so any store
that Spark can reach will do, and writing takes one pass in as many tasks as
there are partitions. The first line of a record separates records when they are
read; the writer sees to it that no block contains one by ending a chunk or a
segment inside of it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from wordreel.llm.base import attach
from wordreel.session import run_folder

SEGMENT = 16_384            # bytes of a block in one record
CHUNK = 4_096               # bytes of one chunk of the body
LEAST_REVISIT = 0           # bytes from which an equal payload becomes a revisit
VERSION = "WARC/1.1\r\n"    # fixed value: first line of a record
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: four groups of five bytes, eight digits each."""
    hexed = F.sha1(payload)
    parts = [F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0"),
                         "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
             for i in range(4)]
    return F.concat(*parts)


def _length(of: Column) -> Column:
    return F.octet_length(of).cast("bigint")


def _bytes(text: str | Column) -> Column:
    return (F.lit(text) if isinstance(text, str) else text).cast("binary")


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit("\r\n")),
                                 F.lit("")) for k, v in pairs])


def record_id(page: Column, digest: Column, number: Column | None = None) -> Column:
    """A name-based id, so that a task that is run again writes the same."""
    parts = [page.cast("string"), digest] + ([] if number is None else [number.cast("string")])
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
        F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _joined(pieces: Column) -> Column:
    """All binary pieces of an array in one; a fold that appends would copy them again and again."""
    return F.array_join(F.transform(pieces, lambda x: x.cast("string")), "").cast("binary")


def _cut(of: Column, size: int) -> Column:
    """A binary in pieces of `size` bytes; an empty one has one empty piece.

    It is handed on as an element of an array: a column that a function refers to
    would be copied whole for every piece.
    """
    def pieces(data: Column) -> Column:
        ends = F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0)), F.lit(size))
        return F.transform(ends, lambda at: F.substring(data, at + 1, F.lit(size)))

    return F.transform(F.array(of), pieces)[0]


def chunked(payload: Column, size: int = CHUNK) -> Column:
    """The body in chunked transfer framing.

    Chunks have `size` bytes, but one ends inside every `WARC/1.1` that the
    payload contains, which so never stands whole in a block.
    """
    marked = F.split(payload.cast("string"), r"(?<=WARC/1)(?=\.1)")
    chunks = F.flatten(F.transform(marked, lambda part: F.filter(
        _cut(part.cast("binary"), size), lambda x: F.octet_length(x) > 0)))
    framed = F.transform(chunks, lambda x: F.concat(
        _bytes(F.concat(F.lower(F.hex(F.octet_length(x))), F.lit("\r\n"))), x, _bytes("\r\n")))
    return F.concat(_joined(framed), _bytes("0\r\n\r\n"))


def records(pages: DataFrame, least_revisit: int = LEAST_REVISIT, segment: int = SEGMENT,
            chunk: int = CHUNK) -> DataFrame:
    """(value) of every record of (page_id, url, html), without the line ends after it.

    A null html is an empty payload, a null url an empty one; line ends in a url
    are percent-encoded, and so is the stroke of a `WARC/1.1` in it. Pages without an id are archived as null, their id being
    written as an empty one. Rows that repeat an id are archived each, and read each; with equal
    payloads all of them are responses.
    """
    clean = F.coalesce("url", F.lit(""))
    for plain, coded in (("\r", "%0D"), ("\n", "%0A"), ("WARC/1.1", "WARC%2F1.1")):
        clean = F.replace(clean, F.lit(plain), F.lit(coded))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), clean.alias("url"),
                        payload.alias("html"), payload_digest(payload).alias("digest"),
                        _length(payload).alias("n"))
    # one short row per payload, counted in the tasks first; the join may split a hot payload
    origin = (rows.filter(F.col("n") >= least_revisit).groupBy("digest", "n")
              .agg(F.min("page_id").alias("origin")))
    short = rows.select("page_id", "digest", "n").join(origin, ["digest", "n"], "left")
    refers = short.filter(F.col("origin") < F.col("page_id")).select(
        "page_id", "digest", "origin").distinct()
    rows = rows.join(refers, ["page_id", "digest"], "left")

    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                          "Transfer-Encoding: chunked\r\n\r\n"))
    block = F.when(F.col("origin").isNull(), F.concat(_bytes(head), chunked(F.col("html"), chunk))
                   ).otherwise(_bytes(head))
    rows = rows.withColumn("block", block)
    # the length is taken first: beside `posexplode` every segment would carry the whole block
    rows = rows.withColumn("total", F.octet_length("block"))
    rows = rows.select("page_id", "url", "digest", "n", "origin", "total",
                       F.posexplode(_cut(F.col("block"), segment)).alias("at", "part"))
    number = F.col("at") + 1
    several = F.col("total") > segment
    of_page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    header = F.concat(F.lit(VERSION), _lines(
        ("WARC-Type", F.when(number > 1, F.lit("continuation"))
         .when(F.col("origin").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.when(number > 1, record_id(of_page, F.col("digest"), number))
         .otherwise(record_id(of_page, F.col("digest")))),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url")),
        ("X-Page", of_page), ("X-Payload-Length", F.when(number == 1, F.col("n"))),
        ("WARC-Payload-Digest", F.when(number == 1, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Refers-To", F.when(F.col("origin").isNotNull(),
                                  record_id(F.col("origin"), F.col("digest")))),
        ("X-Refers-To-Page", F.col("origin")),
        ("WARC-Profile", F.when(F.col("origin").isNotNull(), F.lit(PROFILE))),
        ("WARC-Segment-Number", F.when(several, number)),
        ("WARC-Segment-Origin-ID", F.when(
            several & (number > 1), record_id(of_page, F.col("digest")))),
        ("WARC-Segment-Total-Length", F.when(
            several & (F.col("at") * segment + F.octet_length("part") == F.col("total")),
            F.col("total"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("part"))), F.lit("\r\n"))
    return rows.select(F.concat(_bytes(header), F.col("part")).cast("string").alias("value"))


def write(pages: DataFrame, path: str, **options: int) -> None:
    """Archives of all pages, one gzip file per task."""
    records(pages, **options).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").text(path)


# --- reading --------------------------------------------------------------

def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its header fields by lower-case name, and its block.

    `complete` is false where the block is not as long as its header says; such
    records are kept, so that a damaged archive shows.
    """
    raw = (spark.read.option("lineSep", VERSION).text(path)
           .filter(F.col("value") != "")
           .select(F.col("value").cast("binary").alias("raw"),
                   F.instr("value", "\r\n\r\n").alias("chars"), "value"))
    # header fields are ASCII but for the target, so the place is counted in bytes
    head = F.substring(F.col("value"), F.lit(1), F.col("chars") - 1)
    raw = raw.select("raw", head.alias("head"), (F.octet_length(head) + 4).alias("from"))
    fields = F.transform(F.split("head", "\r\n"), lambda x: F.struct(
        F.lower(F.substring_index(x, ":", 1)).alias("key"),
        F.ltrim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    raw = raw.withColumn("header", F.map_from_entries(F.filter(
        fields, lambda x: x["key"] != "")))
    length = F.col("header")["content-length"].cast("int")
    block = F.substring(F.col("raw"), F.col("from") + 1, length)
    return raw.select("header", block.alias("block"),
                      (F.octet_length(block) == length).alias("complete"))


def reassembled(records: DataFrame) -> DataFrame:
    """One row per response or revisit, with the block of all its segments and `complete`.

    Segments meet by the id of their first record and are put in the order of
    their numbers; they are complete if none is missing and their length is the
    total that the last one states. Records of one segment are not shuffled.
    """
    h = F.col("header")
    number = h["warc-segment-number"].cast("int")
    whole = records.filter(number.isNull()).select("header", "block", "complete")
    parts = records.filter(number.isNotNull()).select(
        F.coalesce(h["warc-segment-origin-id"], h["warc-record-id"]).alias("origin"),
        number.alias("number"), "header", "block", "complete",
        h["warc-segment-total-length"].cast("bigint").alias("total"))
    joined = parts.groupBy("origin").agg(
        F.array_sort(F.array_distinct(F.collect_list(F.struct("number", "block"))))
        .alias("parts"), F.max("total").alias("total"), F.min("complete").alias("complete"),
        F.max("number").alias("last"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("number") == 1).alias("copies"))
    headers = F.first(F.when(F.col("number") == 1, F.col("header")), ignorenulls=True)
    joined = joined.join(parts.groupBy("origin").agg(headers.alias("header")), "origin")
    block = _joined(F.col("parts")["block"])
    # a record that was written several times comes out as often
    joined = joined.withColumn("block", block).withColumn(
        "copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    joined = joined.select(
        "header", "block", (F.col("complete") & (F.size("parts") == F.col("last"))
                            & (F.col("last") * F.col("copies") == F.col("n"))
                            & F.coalesce(_length(F.col("block")) == F.col("total"), F.lit(False)))
        .alias("complete"))
    return whole.unionByName(joined.filter(F.col("header").isNotNull()))


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP response block; null for null, empty without a body.

    A body in chunked framing is put together from its chunks, up to the first
    that is no chunk; any other body is the payload as it stands.
    """
    if block is None:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    if not re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
        return body
    view, chunks, at = memoryview(body), [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = re.match(rb"[0-9A-Fa-f]+", body[at:end]) if end >= 0 else None
        size = int(size[0], 16) if size else 0
        if not size:
            return b"".join(chunks)
        chunks.append(view[end + 2: end + 2 + size])
        at = end + 2 + size + 2


def _payloads():
    return lambda blocks: [[payload_of(b) for b in blocks]]


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, complete.

    A revisit has no payload of its own; its length and digest are those that the
    writer stated, as are none of a response's: they are taken from what was read.
    """
    h = F.col("header")
    rows = reassembled(read_records(spark, path))
    revisit = h["warc-type"] == "revisit"
    rows = rows.select(
        h["x-page"].cast("bigint").alias("page_id"), h["warc-target-uri"].alias("url"),
        h["warc-type"].alias("record_type"), h["x-refers-to-page"].cast("bigint").alias("refers_to"),
        F.when(~revisit, F.col("block")).alias("block"), "complete",
        h["x-payload-length"].cast("bigint").alias("stated_bytes"),
        F.substring_index(h["warc-payload-digest"], ":", -1).alias("stated_digest"))
    rows = attach(rows, "block", _payloads, [T.StructField("payload", T.BinaryType())])
    return rows.select(
        "page_id", "url", "payload",
        F.coalesce(_length(F.col("payload")), F.col("stated_bytes")).alias("payload_bytes"),
        F.coalesce(payload_digest(F.col("payload")), F.col("stated_digest"))
        .alias("payload_digest"), "record_type", "refers_to", "complete")


def archive(pages: DataFrame, path: str | None = None, **options: int) -> DataFrame:
    """Write all pages to archives and read them back; see `records` and `pages_of`."""
    spark = pages.sparkSession
    path = path or run_folder(spark, "warc")
    write(pages, path, **options)
    return pages_of(spark, path)
