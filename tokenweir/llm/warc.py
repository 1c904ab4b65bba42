"""WARC archives: writing pages, reading records, assembling transactions.

A page becomes three records: request, response (or revisit, where an earlier page has
the same payload) and metadata; request and metadata name the capture they belong to in
WARC-Concurrent-To. Records are built by DataFrame expressions and written by Spark's text
sink with the record separator CR LF CR LF as line separator, so archives land in any
store that Spark writes. Reading unpacks a file piece by piece, takes records by their
Content-Length and passes them on in batches of bounded size; Spark hands a file over in
one value, so a file may have 2 GB at most.

Defined cases: a null page is an empty payload; a very long page is one record; null or
repeated page ids are pages of their own (nulls first, then by id and the digest of the
html); of equal payloads the first page is the response; line breaks in urls are
percent-encoded; a record that the end of its file cuts off is left out, one without a
readable Content-Length is empty; an empty table gives no archive records; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tokenweir.llm.common import materialize, new_path, with_row_key

SEPARATOR = "\r\n\r\n"
#: Uncompressed bytes that a file should hold; readers take a file at a time.
FILE_BYTES = 8 << 20
#: Pairs of page keys (16 bytes each) that are broadcast at most.
BROADCAST_REVISITS = 1_000_000
#: Records and bytes of blocks in a batch that a reader passes on.
BATCH_RECORDS, BATCH_BYTES = 1000, 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(value: Column) -> Column:
    """Upper-case base32 of the SHA-1, five hex digits (20 bits, four base32 digits) at a time."""
    digest = F.sha1(value)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut]), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """Header lines with a value, a blank line and the block; the separator comes from the sink."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in headers]
    length = F.octet_length(block).cast("string")
    return F.concat(
        F.lit("WARC/1.1\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("Content-Length: "), length, F.lit(SEPARATOR), block
    )


def planned_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages with key, payload digest, size, and the key of the page they revisit (or null).

    Digests and keys alone find the revisits: the first page of each payload comes from a
    partial aggregate, and a payload that a third of all pages share is a hot key of narrow
    rows only. Up to BROADCAST_REVISITS of them are broadcast; beyond that the pages are
    joined by their own, unique key.
    """
    keyed = with_row_key(pages, "page_id", "html")
    html = F.coalesce(F.col("__row.html"), F.lit(""))
    narrow = keyed.select(F.col("__key").alias("k"), F.unhex(F.sha1(html.cast("binary"))).alias("d"), F.octet_length(html).alias("b"))
    first = narrow.groupBy(F.col("d").alias("of")).agg(F.min("k").alias("first"))
    revisits = narrow.filter(F.col("b") >= min_revisit_bytes).join(first, F.col("d") == F.col("of")).filter("k <> first").select("k", "first")
    revisits = materialize(revisits, "revisits")
    few = revisits.count() <= BROADCAST_REVISITS
    p = keyed.join(F.broadcast(revisits) if few else revisits, F.col("__key") == F.col("k"), "left").select(
        F.col("__key").alias("key"),
        F.col("__row.page_id").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col("__row.url"), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        html.alias("html"),
        F.col("first").alias("refers"),
    )
    return p.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html").cast("binary")))


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Writes the archives of `pages` to the folder `path` (gzip files)."""
    size = pages.agg(F.count("*").alias("n"), F.sum(F.octet_length("html")).alias("b")).first()
    per_page = (size["b"] or 0) / max(1, size["n"]) + 1200
    p = planned_pages(pages, min_revisit_bytes)
    capture, host = record_id("capture", F.col("key")), F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(SEPARATOR)
    )
    common = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", record_id("request", F.col("key"))), ("WARC-Concurrent-To", capture), *common,
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(target), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(SEPARATOR)),
    )
    is_revisit = F.col("refers").isNotNull()
    response = _record(
        [("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))), ("WARC-Record-ID", capture), *common,
         ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
         ("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
         ("WARC-Refers-To", F.when(is_revisit, record_id("capture", F.col("refers")))),
         ("Content-Type", F.lit("application/http; msgtype=response"))],
        F.when(is_revisit, http).otherwise(F.concat(http, F.col("html"))),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", record_id("metadata", F.col("key"))), ("WARC-Concurrent-To", capture), *common,
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("via: tokenweir\r\n"), F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))),
    )
    rows = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.option("lineSep", SEPARATOR).option("compression", "gzip").option(
        "maxRecordsPerFile", 3 * max(1, int(file_bytes / per_page))
    ).text(path)


def unpacked(data: bytes | memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of a file piece by piece: gzip members one after another, or the file as it is."""
    view, at = memoryview(data), 0
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    member = zlib.decompressobj(31)
    while at < len(view):
        piece = view[at : at + step]
        yield member.decompress(piece)
        at += len(piece) - len(member.unused_data)
        if member.eof:
            if bytes(view[at : at + 2]) != b"\x1f\x8b":
                return
            member = zlib.decompressobj(31)


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(headers with lower-case names, block) of each record; lengths come from Content-Length."""
    held, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:at]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        headers: dict[str, list[str]] = {}
        for line in held[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = headers.get("content-length", ["0"])[0]
        stop = end + 4 + (int(size) if size.isdecimal() else 0)
        while len(held) < stop:
            if not more():
                return
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]


SCHEMA = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "content_type string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def _row(h: dict[str, list[str]], block: bytes, payloads: bool) -> tuple:
    one = lambda name: h.get(name, [None])[0]
    kind, content = one("warc-type"), one("content-type") or ""
    body = block.partition(b"\r\n\r\n")[2] if content.startswith("application/http") else block
    fields = None
    if content == "application/warc-fields":
        lines = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if ":" in x)
        fields = [(k.strip(), v.strip()) for k, _, v in lines]
    whole = kind == "response"
    return (
        one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), h.get("warc-concurrent-to"), one("warc-refers-to"), content,
        len(body) if whole else None, base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else None, fields, body if payloads else None,
    )


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record. `payload` is the HTTP body, or the block of other records."""
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    names = [x.split(" ")[0] for x in SCHEMA.replace("map<string,string>", "m").split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for value in batch.column(0):
                rows, size = [], 0
                for h, block in parse(unpacked(value.as_buffer())):
                    rows.append(_row(h, block, payloads))
                    size += len(block)
                    if len(rows) >= BATCH_RECORDS or size >= BATCH_BYTES:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, type, target_uri, date, refers_to, response, request, metadata.

    Any record may name the other in WARC-Concurrent-To. A capture's own request and
    metadata records are few; of several, the one with the smallest id is taken.
    """
    captures = records.filter(F.col("type").isin("response", "revisit"))
    others = records.filter(F.col("type").isin("request", "metadata"))
    links = (
        others.select(F.explode("concurrent_to").alias("capture"), F.col("record_id").alias("other"))
        .union(captures.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other")))
        .distinct()
    )
    side = others.select("record_id", "type", F.struct("record_id", "date", "fields", "payload").alias("r"))
    grouped = links.join(side, links["other"] == side["record_id"]).groupBy("capture").agg(
        F.min_by(F.when(F.col("type") == "request", F.col("r")), F.when(F.col("type") == "request", F.col("other"))).alias("request"),
        F.min_by(F.when(F.col("type") == "metadata", F.col("r")), F.when(F.col("type") == "metadata", F.col("other"))).alias("metadata"),
    )
    return captures.join(grouped, captures["record_id"] == grouped["capture"], "left").select(
        "record_id", "type", "target_uri", "date", "refers_to",
        F.struct("payload_bytes", "payload_digest", "payload").alias("response"), "request", "metadata",
    )


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type, refers_to (page id).

    Size and digest are those of the payload in the nested row; a revisit has those of its
    response. Only narrow rows are joined; a response that very many captures revisit makes
    a hot key on the larger side of an equi-join, which adaptive execution splits.
    """
    payload = F.col("response.payload")
    flat = materialize(
        captures.select(
            "record_id", "type", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"),
            base32_sha1(payload).alias("payload_digest"), F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        ),
        "captures",
    )
    full = flat.filter("type = 'response'").select(
        F.col("record_id").alias("of"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.col("page_id").alias("p")
    )
    revisits = flat.filter("type = 'revisit'").join(full, F.col("refers_to") == F.col("of"), "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return flat.filter("type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", F.col("type"), F.lit(None).cast("long")
    ).toDF(*names).union(revisits.select("page_id", "b", "d", "type", "p").toDF(*names))


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them again, assembles the captures with their payloads and gives a row per page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_revisit_bytes)
    return resolve_revisits(assemble(read_warc(spark, path)))
