"""WARC archives: a writer with revisit records and a splittable reader.

Archives are gzip files with one member per record. The reader cuts each file into
byte ranges; a task scans its range for the gzip magic, takes a candidate only if a
WARC header comes out of it, and owns the records that start inside its range, so a
file of any size is read by many tasks and every record exactly once.

Files are reached with pyarrow's filesystems (local and mounted paths, and the
object stores and HDFS that pyarrow knows by URI) from the executors.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

MAGIC = b"\x1f\x8b\x08"
CRLF = b"\r\n"
MOST_TASKS = 1 << 15
#: The most frequent payloads, whose revisits are decided from a list that goes to all tasks.
HOT = 1_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _record(kind: str, record_id: str, url: str, digest: str, payload: bytes, length: int, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http + (payload if kind == "response" else b"")
    url = "".join(c for c in url if c.isprintable()) or "urn:unknown"
    head = [f"WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = 1 << 28) -> DataFrame:
    """Writes (page_id, url, payload, payload_bytes, digest, kind, refers_to) rows
    as archives in a shared folder. Returns the manifest (path, size, records).

    A task names its files anew at each attempt and they count only by its rows of
    the manifest, so retried and speculative tasks leave no record twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, records, done = None, "", 0, 0, []
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(7)))
            for page, url, payload, length, digest, kind, refers in rows:
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, records = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                data = _member(_record(kind, "null" if page is None else str(page), url or "", digest, payload.encode() if payload else b"", length, None if refers is None else str(refers)))
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= roll_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "size", "records"])

    return pages.select("page_id", "url", "payload", "payload_bytes", "digest", "kind", "refers_to").mapInArrow(run, "path string, size long, records long")


class _Window:
    """A file's bytes from an offset on, fetched as needed and dropped when passed; in time that grows with their number."""

    def __init__(self, file, start: int, step: int = 1 << 22) -> None:
        self.file, self.base, self.step, self.data, self.ended = file, start, step, bytearray(), False
        file.seek(start)

    def upto(self, end: int) -> None:
        while not self.ended and self.base + len(self.data) < end:
            more = self.file.read(self.step)
            self.ended = len(more) < self.step
            self.data += more

    def drop(self, before: int) -> None:
        if before - self.base > self.step:
            del self.data[: before - self.base]
            self.base = before


def _decode(window: _Window, at: int) -> tuple[bytes, int] | None:
    """The record of the gzip member at an offset and where the member ends, or None
    if no whole member with a WARC header is there."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            window.upto(pos + (1 << 16))
            piece = window.data[pos - window.base : pos - window.base + (1 << 16)]
            if not piece:
                return None
            got = z.decompress(piece)
            if not out and got and not got.startswith(b"WARC/1."[: len(got)]):
                return None
            if got:
                out.append(got)
            pos += len(piece) - len(z.unused_data)
    except zlib.error:
        return None
    record = b"".join(out)
    return (record, pos) if record.startswith(b"WARC/1.") else None


def parse(record: bytes) -> dict | None:
    """Headers and block of a record, or None where its length or form is wrong."""
    head, found, rest = record.partition(CRLF * 2)
    if not found:
        return None
    headers = {}
    for line in head.split(CRLF)[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return {"headers": headers, "block": rest[: int(length)]}


def records_in(file, start: int, end: int) -> Iterator[dict]:
    """The records whose gzip member starts in [start, end) of an open file."""
    window, at = _Window(file, start), start
    while at < end:
        window.upto(min(end, at + (1 << 20)) + 2)
        found = window.data.find(MAGIC, at - window.base, min(end, at + (1 << 20)) + 2 - window.base)
        if found < 0:
            at = min(end, at + (1 << 20))
            window.drop(at)
            continue
        at = window.base + found
        if (got := _decode(window, at)) and (r := parse(got[0])):
            yield r
            at = got[1]
            window.drop(at)
        else:
            at += 1


def _bare(value: str | None) -> str | None:
    return None if value is None else value.strip("<>").removeprefix("urn:page:")


def read_warc(files: DataFrame, with_payload: bool = True, split_bytes: int = 1 << 24) -> DataFrame:
    """The response and revisit records of the archives (path, size), one row each:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload
    (null for revisits, and without with_payload).

    payload_bytes and payload_digest are those of the full payload: counted and
    hashed for a response, from the record's headers for a revisit. Empty files and
    an empty list give no rows; bytes that are no record are skipped.

    The ranges are dealt evenly to a stated number of tasks, one each up to MOST_TASKS:
    their rows are tiny, so adaptive execution would merge an unstated number into one.
    """
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"), "size")
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "size").alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 0
    ranges = ranges.repartition(int(min(max(n, 1), MOST_TASKS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start, end in zip(*(batch.column(k).to_pylist() for k in range(3))):
                fs, name = _filesystem(path)
                rows, held = [], 0
                with fs.open_input_file(name) as file:
                    for r in records_in(file, start, end):
                        h = r["headers"]
                        if h.get("warc-type") not in ("response", "revisit"):
                            continue
                        http, _, payload = r["block"].partition(CRLF * 2)
                        page, refers = _bare(h.get("warc-record-id")), _bare(h.get("warc-refers-to"))
                        if h["warc-type"] == "response":
                            length, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            sizes = [x.partition(b":")[2] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
                            length, digest, payload = int(sizes[0]) if sizes else None, h.get("warc-payload-digest", "").partition(":")[2] or None, None
                        number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
                        rows.append((number(page), h.get("warc-target-uri"), length, digest, h["warc-type"], number(refers), payload if with_payload else None))
                        held += len(payload or b"")
                        if len(rows) >= 5000 or held > 1 << 25:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return ranges.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and returns the manifest.

    Of pages with equal payloads of at least `least_bytes` bytes the one with the
    largest page_id is a response and the others revisit it. Defined cases: null
    html is an empty payload; a null page_id never is the one revisited; rows that
    repeat the largest page_id are responses each; extra columns aren't read.

    Revisits are decided on slim rows of ids and digests. Those of the most frequent
    payloads, a list of fixed length, are known before any page moves and lose their
    payload there; the others meet their pages by page, so no payload gathers its copies.
    """
    keys = ["digest", "x", "payload_bytes"]
    payload = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("digest"), F.xxhash64(payload).alias("x"))
    slim = written(base.where(F.col("payload_bytes") >= least_bytes).select("page_id", *keys), "slim")
    twins = written(slim.groupBy(*keys).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"), "twins")
    hot = F.broadcast(written(twins.orderBy(F.desc("n"), *keys).limit(HOT).select(*keys, F.col("first").alias("hot")), "hot"))
    others = slim.join(hot, keys, "left_anti").join(twins, keys).where(~F.col("page_id").eqNullSafe(F.col("first")))
    others = written(others.select(F.col("page_id").alias("__page"), *[F.col(c).alias(f"__{c}") for c in keys], "first").distinct(), "others")
    at = base.join(hot, keys, "left")
    hit = F.col("hot").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("hot"))
    at = at.withColumns({"payload": F.when(~hit, F.col("payload")), "hot": F.when(hit, F.col("hot"))})
    same = F.col("page_id").eqNullSafe(F.col("__page"))
    for c in keys:
        same &= F.col(c) == F.col(f"__{c}")
    at = at.join(others, same, "left").withColumn("refers_to", F.coalesce("hot", "first"))
    at = at.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return write_warc(at.withColumn("kind", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")), folder)


def round_trip(spark: SparkSession, pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """Archives pages in the shared folder and reads the archives back."""
    folder = f"{shared_dir(spark)}/gridmeld-warc-{uuid.uuid4().hex}"
    return read_warc(written(archive_pages(pages, folder), "manifest"), with_payload)
