"""10. WARC as a chunked record table.

A payload is a run of rows (record, chunk number), each with the running SHA-256 of what came up to its
end; nothing holds a whole record but the table's own cell. Archives are Spark text files whose line
separator is CRLF, so each row is one WARC record: a payload over one chunk goes on in continuation records
with WARC-Segment-Number, as the standard has it. A chunk never contains the version line, so readers can
stream record by record, and split files that are not compressed. By default files are gzipped, as WARC
archives mostly are; a file is what one task wrote.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

CHUNK = 256 << 10
#: Payloads under this many bytes are always stored again.
REVISIT_BYTES = 100
# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunks(payload: memoryview, size: int) -> Iterator[memoryview]:
    """Pieces of at most size bytes; none contains the version line or parts a UTF-8 character. Empty: one empty piece."""
    at = 0
    while True:
        to = min(len(payload), at + size)
        found = bytes(payload[at : to + len(VERSION)]).find(VERSION)
        if found >= 0 and at + found < to:
            to = at + found + 4  # inside the version line
        elif to < len(payload):
            back = to
            while back > at + 1 and to - back < 4 and payload[back] & 0xC0 == 0x80:
                back -= 1
            to = back if payload[back] & 0xC0 != 0x80 else to
        if payload[max(at, to - 8) : to] == VERSION[:8]:
            to -= 4  # a record ends with CRLF
        yield payload[at:to]
        at = to
        if at >= len(payload):
            return


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, out = [], []
            for cell in batch.column(1):
                view, running = memoryview(cell.as_buffer() or b""), hashlib.sha256()
                for piece in chunks(view, size):
                    running.update(piece)
                n.append(len(view)), out.append(running.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.string())], names=["id", "n", "digest"])

    return run


def _records(size: int):
    """(id, url, payload, first) to WARC records without their last CRLF, which the writer adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            out, held = [], 0
            for page, url, cell, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                k += 1
                name = b"<urn:page:%s:%d-%d>" % (str(page).encode(), part, k)
                view, running = memoryview(cell.as_buffer() or b""), hashlib.sha256()
                target = re.sub(r"[\r\n]+", " ", url or "").encode()
                if first is not None:
                    for piece in chunks(view, size):
                        running.update(piece)
                    out.append(b"".join([VERSION, b"WARC-Type: revisit\r\nWARC-Record-ID: ", name, b"\r\nWARC-Target-URI: ", target, b"\r\nWARC-Refers-To: <urn:page:%d>\r\nWARC-Profile: " % first, PROFILE, b"\r\nWARC-Payload-Digest: sha256:", running.hexdigest().encode(), b"\r\nContent-Length: 0", END, b"\r\n"]))
                    continue
                pieces = chunks(view, size)
                piece, number, done = next(pieces), 1, 0
                whole = len(piece) == len(view)
                while piece is not None:
                    running.update(piece)
                    done += len(piece)
                    after = None if done == len(view) else next(pieces)
                    head = [VERSION, b"WARC-Type: ", b"response" if number == 1 else b"continuation", b"\r\nWARC-Record-ID: ", name, b"\r\nWARC-Target-URI: ", target]
                    if not whole:
                        head.append(b"\r\nWARC-Segment-Number: %d" % number)
                    if after is None:  # digests cover the payload from its first chunk to here
                        head.append(b"\r\nWARC-Payload-Digest: sha256:" + running.hexdigest().encode())
                        head.append(b"" if whole else b"\r\nWARC-Segment-Total-Length: %d" % len(view))
                    http = HTTP % len(view) if number == 1 else b""
                    head.append(b"\r\nContent-Length: %d" % (len(http) + len(piece)))
                    out.append(b"".join([*head, END, http, piece, b"\r\n"]))
                    held += len(piece)
                    piece, number = after, number + 1
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", size: int = CHUNK, compression: str = "gzip") -> None:
    """Writes a record for each row of pages into WARC files under path, a file for each task.

    Of rows with equal payloads of at least REVISIT_BYTES the smallest id is a response and the others
    revisit it. Null payloads are empty, null URLs are empty, a null id is a response of its own; rows that
    repeat an id are records of their own, all responses if that id is the smallest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = Scratch(spark, "warc").put(rows.select("id", "payload").mapInArrow(_digests(size), "id long, n long, digest string").where(f"n >= {REVISIT_BYTES} and id is not null"), "digests")
    repeated = digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    revisits = digests.join(repeated, "digest").where("id <> first").groupBy("id", "digest").agg(F.min("first").alias("first"))
    one = revisits.groupBy("id").agg(F.min("first").alias("first"), F.count("*").alias("c")).where("c = 1").select("id", "first")  # an id with several payloads stays whole
    records = rows.join(one, "id", "left").select("id", "url", "payload", "first").mapInArrow(_records(size), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").text(path, compression=compression)


def _head_end(record: memoryview) -> int:
    """Where the header ends, looked for step by step: a URL in it may have any length."""
    step = 1 << 16
    for at in range(0, len(record), step):
        found = bytes(record[at : at + step + len(END) - 1]).find(END)
        if found >= 0:
            return at + found
    raise ValueError("a record has no end of its header")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record bytes after the version line: name, page, kind, refers_to, segment, content (of segmented payloads), n, digest."""
    field = {k: re.compile(rb"(?:^|\r\n)" + v + rb":[ ]*([^\r\n]*)", re.I) for k, v in (("kind", rb"WARC-Type"), ("name", rb"WARC-Record-ID"), ("first", rb"WARC-Refers-To"), ("segment", rb"WARC-Segment-Number"), ("length", rb"Content-Length"), ("digest", rb"WARC-Payload-Digest"))}
    names = ["name", "page", "kind", "refers_to", "segment", "content", "n", "digest"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string()]

    def number(value: bytes | None) -> int | None:
        found = re.match(rb"<urn:page:(-?\d+)", value or b"")
        return int(found[1]) if found else None

    for batch in batches:
        rows, held = [], 0
        for cell in batch.column(0):
            buffer = memoryview(cell.as_buffer())
            if not len(buffer):
                continue  # before a file's first record
            end = _head_end(buffer)
            head = bytes(buffer[:end])
            got = {k: (m[1] if (m := rx.search(head)) else None) for k, rx in field.items()}
            block = buffer[end + len(END) : end + len(END) + int(got["length"])]
            if len(block) != int(got["length"]):
                raise ValueError(f"a record of {got['name']} is cut short")
            kind, segment = got["kind"].decode(), got["segment"] and int(got["segment"])
            if kind == "response":
                block = block[bytes(block[:4096]).find(END) + len(END) :]
            digest = got["digest"].decode().removeprefix("sha256:") if got["digest"] else None
            if segment is None and kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                raise ValueError(f"the digest of {got['name']} does not fit")
            rows.append((got["name"].decode(), number(got["name"]), kind, number(got["first"]), segment, bytes(block) if segment else None, len(block), digest))
            held += len(block)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments sorted by name and number, digested one after the other; a row when the last, which has the digest, is met."""
    name, page, running, n, expected = None, None, None, 0, 1
    for batch in batches:
        out = []
        for row_name, row_page, segment, cell, digest in zip(*(batch.column(x).to_pylist() for x in ("name", "page", "segment")), batch.column("content"), batch.column("digest").to_pylist(), strict=True):
            if row_name != name:
                name, page, running, n, expected = row_name, row_page, hashlib.sha256(), 0, 1
            piece = memoryview(cell.as_buffer())
            running.update(piece)
            n += len(piece)
            if segment != expected or digest is not None and running.hexdigest() != digest:
                raise ValueError(f"segments of {name} do not fit")
            expected += 1
            if digest is not None:
                out.append((page, "response", None, n, digest))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page", "kind", "refers_to", "n", "digest"])


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    """The archives under path as rows of chunks: name, page, kind, refers_to, segment, content, n, digest (on last chunks).

    content is null for payloads of one chunk, whose digest is checked on the way.
    """
    text = spark.read.option("lineSep", VERSION.decode()).text(path).select(F.col("value").cast("binary").alias("record"))
    return text.mapInArrow(_parsed, "name string, page long, kind string, refers_to long, segment long, content binary, n long, digest string")


def read_archives(spark: SparkSession, path: str, id_col: str = "page_id") -> DataFrame:
    """Per record: id_col, payload_bytes, payload_digest, record_type, refers_to; digests recomputed from payloads.

    Chunks of long payloads are sorted by record and number, and their digest carried along from row to row.
    A revisit takes its size from the response that it refers to.
    """
    rows = chunk_table(spark, path)
    rows = Scratch(spark, "warc").put(rows, "chunks")
    long = rows.where("segment is not null").repartition("name").sortWithinPartitions("name", "segment")
    plain = rows.where("segment is null").select("page", "kind", "refers_to", "n", "digest")
    whole = plain.where("kind = 'response'").unionByName(long.mapInArrow(_joined, "page long, kind string, refers_to long, n long, digest string"))
    sizes = whole.where("page is not null").groupBy(F.col("page").alias("refers_to"), "digest").agg(F.max("n").alias("n"))
    visits = plain.where("kind = 'revisit'").drop("n").join(sizes, ["refers_to", "digest"], "left")
    return whole.unionByName(visits).select(F.col("page").alias(id_col), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op10_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d
"""
