"""WARC archives: a writer with one gzip member a record, and a splittable reader.

The reader's tasks get byte ranges. A task scans its range for the gzip magic, takes a candidate for a
member only if it decodes to a WARC header, reads members that start inside its range to their end (which
may lie beyond it), and leaves all others to their owners. Archives lie in the folder that all machines share,
by any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _bit_split, fresh_path, materialize, table

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 20
SPLIT = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, page_id string, record_type string, uri string, payload_digest string, "
    "payload_bytes long, refers_to string, path string, offset long, payload binary"
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text) -> str:
    return str(text).replace("\r", " ").replace("\n", " ")


def record(page_id, uri, payload: bytes, first_id=None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One WARC record as a gzip member; with first_id it revisits that page's record and has no payload."""
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first_id is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(uri)}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(first_id)}", f"X-Refers-To-Page: {_line(first_id)}"] if first_id is not None else []),
        *([f"X-Page-Id: {_line(page_id)}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _writer(base: str):
    def run(batches):
        fs, root = pafs.FileSystem.from_uri(base)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        path = f"{root}/part-{task.partitionId():06d}.warc.gz"
        mine, n, size = f"{root}/.attempt-{task.taskAttemptId()}", 0, 0
        with fs.open_output_stream(mine, compression=None) as out:
            for b in batches:
                for page_id, uri, payload, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    out.write(r := record(page_id, uri, payload or b"", first))
                    n, size = n + 1, size + len(r)
        if not n:
            fs.delete_file(mine)
            return
        if fs.get_file_info(path).type != pafs.FileType.NotFound:  # of an attempt whose result was lost
            fs.delete_file(path)
        fs.move(mine, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return run


def write_warc(
    pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0
) -> DataFrame:
    """Write a record for each row; returns the manifest (path, records, bytes), one row a file.

    Payload: the html in UTF-8, null as empty. Of rows with equal payloads (by SHA-1) of `revisit_from` bytes
    or more, those with the smallest id are responses and the others revisit it; rows without an id are
    responses where no row of the group has one. A null url gives no target URI. An empty table gives no files.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha")
    )
    first = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("sha", "first"), "first")
    # payloads that stand alone are written where they are read; only those that may repeat move
    lone, shared, _, _ = _bit_split(rows, first, [F.col("sha")], ["sha"])
    named = shared.join(first.select(F.col("sha").alias("_sha"), "first"), F.col("sha") == F.col("_sha"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= revisit_from)
    ready = lone.select(F.col("id").cast("string"), "url", "payload", F.lit(None).cast("string").alias("first"))
    ready = ready.unionByName(named.select(F.col("id").cast("string"), "url", "payload", F.when(revisit, F.col("first")).cast("string").alias("first")))
    return materialize(ready.mapInArrow(_writer(base), "path string, records long, bytes long"), "manifest")


class _Window:
    """A file seen through a buffer that slides forward."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, bytearray()
        self.size = file.size()

    def more(self) -> bool:
        start = self.at + len(self.data)
        got = self.file.read_at(min(BLOCK, self.size - start), start) if start < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.at]
        self.at = to

    def find(self, needle: bytes, start: int, end: int) -> int:
        """Where the needle next begins in [start, end), or -1; what lies before it is forgotten."""
        self.drop(start)
        while True:
            i = self.data.find(needle)
            if i >= 0:
                return self.at + i if self.at + i < end else -1
            self.drop(max(start, self.at + len(self.data) - len(needle) + 1))
            if self.at >= end or not self.more():
                return -1


def _member(win: _Window, at: int) -> tuple[bytes, int] | None:
    """The decoded member that begins at `at` and where it ends; None if it is no WARC record."""
    z, out, used = zlib.decompressobj(31), [], at
    try:
        seen = b""
        while not z.eof:
            if used >= win.at + len(win.data) and not win.more():
                break
            part = bytes(win.data[used - win.at : used - win.at + BLOCK])
            used += len(part)
            got = z.decompress(part)
            if len(seen) < 5:
                seen += got[:5]
                if not b"WARC/".startswith(seen[:5]) and not seen.startswith(b"WARC/"):
                    return None
            out.append(got)
    except zlib.error as e:
        if out and seen.startswith(b"WARC/"):
            raise ValueError(f"the record at byte {at} is damaged: {e}") from e
        return None
    if not z.eof:
        if seen.startswith(b"WARC/"):
            raise ValueError(f"the record at byte {at} is cut off")
        return None
    return (b"".join(out), used - len(z.unused_data)) if seen.startswith(b"WARC/") else None


def records(file, start: int, end: int) -> Iterator[tuple[int, dict, bytes]]:
    """(offset, headers, block) of the records that start in [start, end)."""
    win, at = _Window(file, start), start
    while (at := win.find(MAGIC, at, end)) >= 0:
        found = _member(win, at)
        if found is None:
            at += 1
            continue
        head, _, block = found[0].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        yield at, fields, block[: int(fields.get("Content-Length", 0))]
        at = found[1]


def _reader(with_payload: bool):
    schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "page_id", "record_type", "uri", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("payload", pa.binary())]
    )

    def row(path, at, head, block):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = head.get("WARC-Payload-Digest", "").removeprefix("sha1:")
        if head["WARC-Type"] == "revisit":
            length = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size, payload = (length or [None])[0], None
        else:
            size = len(payload)
            if said and said != digest(payload):
                raise ValueError(f"{path}: the payload at byte {at} doesn't match its digest")
            said = said or digest(payload)
        names = ("WARC-Record-ID", "X-Page-Id", "WARC-Type", "WARC-Target-URI")
        return (*(head.get(n) for n in names), said, size, head.get("X-Refers-To-Page"), path, at, payload if with_payload else None)

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches):
        rows, held = [], 0
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, root = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(root) as file:
                    for at, head, block in records(file, start, end):
                        rows.append(row(path, at, head, block))
                        held += len(block) if with_payload else 256
                        if held >= 8 << 20:
                            yield flush(rows)
                            rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def read_warc(spark: SparkSession, path: str, split: int = SPLIT, with_payload: bool = True) -> DataFrame:
    """All response and revisit records of the archives under `path`, with their file and offset.

    Files are listed by Spark and dealt out in ranges of `split` bytes. A record's payload is decoded in one
    piece, so memory is bounded by the longest record. Damaged or cut records raise an error. A payload that itself holds stored
    gzip members of WARC records gives records of its own where a range begins inside it: keep such archives in one range (`split`).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "length").where("length > 0")
    ranges = files.select(
        "path", F.explode(F.expr(f"sequence(0L, length - 1, {split}L)")).alias("start")
    ).selectExpr("path", "start", f"start + {split}L AS end")
    n = ranges.count()
    dealt = ranges.repartition(max(1, min(n, 20_000)), "path", "start")
    return dealt.mapInArrow(_reader(with_payload), RECORD)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    base = fresh_path(spark, "warc")
    empty = not write_warc(pages, base).take(1)
    kind = pages.schema["page_id"].dataType.simpleString()
    if empty:
        return spark.createDataFrame(
            [], f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}"
        )
    return read_warc(spark, base, with_payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS sha,
    min(page_id) OVER (PARTITION BY sha1(html)) AS first
  FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i:
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', sha[i + 1]) - 1) + 1, 4)), '') AS bits
  FROM s
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + 16 * bits[5 * j + 1]::INT + 8 * bits[5 * j + 2]::INT + 4 * bits[5 * j + 3]::INT + 2 * bits[5 * j + 4]::INT + bits[5 * j + 5]::INT]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
