"""WARC archives: one gzip member a record, and a splittable reader.

A reading task gets a byte range of a file. It looks for the gzip magic, takes a place as a member only if what it
decodes to starts with a WARC version line and the member is whole (its CRC holds), and owns the records that start
inside its range; the last of them may end beyond it. From a record's end the next is expected at once, so that bytes
inside a record are searched only before a range's first record and after damage.

Files are opened by the URI's file system (pyarrow.fs): local and shared folders, HDFS and object stores. A writing
task gives its file a new name and reports it with its rows; files of attempts that failed are never read.

Defined results: a null payload is empty, a null URL is left out. Among records of equal payloads of at least
min_bytes, those with the smallest page id are responses (all of them, if the row itself is repeated) and the others
revisit it; a null page id counts as the largest. An empty table gives no file and an empty result. Long payloads are
held one record at a time. Further columns of the input aren't written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import new_dir

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT_BYTES = 8 << 20
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: The header of records whose URL is escaped.
ESCAPED = "X-Target-URI-Escaped"
RECORD_ID = "<urn:tessella:page:{}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to): refers_to is set for revisits. Only the digests of payloads that are
    there more than once are joined back; the join is over ids, so that a payload with many copies is split by Spark's skew join."""
    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "n_bytes": F.octet_length("html").cast("long")})
    first = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(first, F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "html", "digest", "n_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [VERSION.decode() + "1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {RECORD_ID.format('' if page_id is None else page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        if url != url.strip() or any(c in url for c in "\r\n"):  # what a header line can't hold, with a mark of its own
            head += [f"{ESCAPED}: percent", "WARC-Target-URI: " + "".join(f"%{ord(c):X};" if c == "%" or c.isspace() else c for c in url)]
        else:
            head.append(f"WARC-Target-URI: {url}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {RECORD_ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def write(marked: DataFrame, path: str) -> list[tuple[str, int, int]]:
    """Writes mark_revisits()'s rows, one file a task. Returns (file, bytes, records) of each file; the driver gets nothing else."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, name = None, 0, 0, f"{path}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    where, at = fs.FileSystem.from_uri(name)
                    where.create_dir(at.rpartition("/")[0], recursive=True)
                    out = where.open_output_stream(at, compression=None)
                payload = html.as_py().encode()
                member = record(page_id.as_py(), url.as_py(), payload, refers_to.as_py(), base32_sha1(payload))
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

    files = marked.select("page_id", "url", "html", "refers_to").mapInArrow(of, "file string, bytes long, records long").collect()
    return [tuple(r) for r in files]


class _Source:
    """A file's bytes from `start` on, read as far as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int, first: int):
        self.file, self.base, self.data = file, start, b""
        self.file.seek(start)
        self.more(first)

    def more(self, n: int) -> bool:
        got = self.file.read(n)
        self.data += got
        return bool(got)

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The record in the gzip member at a place and the place after it, or None if there is no such member."""
        d, out, pos = zlib.decompressobj(31), b"", at - self.base
        parts: list[bytes] = []
        try:
            while not d.eof:
                if pos >= len(self.data) and not self.more(1 << 20):
                    return None
                chunk = self.data[pos : pos + (1 << 18)]
                pos += len(chunk)
                got = d.decompress(chunk)
                if got:
                    parts.append(got)
                if len(out) < len(VERSION):
                    out = b"".join(parts)[:16]
                    if not VERSION.startswith(out[: len(VERSION)]):
                        return None
        except zlib.error:
            return None
        whole = b"".join(parts)
        return (whole, self.base + pos - len(d.unused_data)) if whole.startswith(VERSION) else None

    def find(self, at: int, stop: int) -> int | None:
        """The first magic that starts in [at, stop)."""
        while len(self.data) < stop - self.base + 2 and self.more(1 << 20):
            pass
        k = self.data.find(MAGIC, at - self.base, stop - self.base + 2)
        return None if k < 0 else self.base + k


def records_in(file: pa.NativeFile, start: int, stop: int) -> Iterator[bytes]:
    """The records of gzip members that start in [start, stop)."""
    source, at = _Source(file, start, stop - start + (1 << 16)), start
    while at < stop and (at := source.find(at, stop)) is not None:
        if got := source.member(at):
            yield got[0]
            at = got[1]
        else:
            at += 1


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    pairs = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode(): v.strip().decode() for k, _, v in pairs}, rest


def _page(s: str | None) -> int | None:
    n = s.rpartition(":")[2].rstrip(">") if s else ""
    return int(n) if n else None


def parse(whole: bytes) -> dict:
    """A record's fields. A response's digest and size are those of the payload as read, and must agree with the header."""
    warc, block = _headers(whole)
    http, payload = _headers(block[: int(warc["content-length"])])
    digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
    if kind == "response" and (base32_sha1(payload), len(payload)) != (digest, int(http["content-length"])):
        raise ValueError(f"the payload of {warc['warc-record-id']} is damaged")
    url = warc.get("warc-target-uri")
    if url is not None and ESCAPED.lower() in warc:
        url = re.sub("%([0-9A-F]+);", lambda m: chr(int(m[1], 16)), url)
    return {"page_id": _page(warc["warc-record-id"]), "url": url, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": kind, "refers_to": _page(warc.get("warc-refers-to")), "payload": payload if kind == "response" else None}


def read(spark: SparkSession, files: list[tuple[str, int, int]], split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """The records of the files (file, bytes, ...), a task for each range of split_bytes; with payloads, also a binary payload (null for revisits)."""
    n = sum(-(-f[1] // split_bytes) for f in files)
    names = SCHEMA + ", payload binary" * payloads

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        schema = pa.schema(list(zip([c.split()[0] for c in names.split(", ")], types, strict=True)))
        for b in batches:
            for name, start, stop in zip(*(b.column(c).to_pylist() for c in ("file", "start", "stop")), strict=True):
                where, at = fs.FileSystem.from_uri(name)
                with where.open_input_file(at) as f:
                    rows, size = [], 0
                    for whole in records_in(f, start, stop):
                        rows.append(parse(whole))
                        size += len(whole) * payloads + 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    each = spark.createDataFrame([(f[0], f[1]) for f in files if f[1]], "file string, size long")
    ranges = each.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    return ranges.select("file", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop")).repartition(max(1, n)).mapInArrow(of, names)


def round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Writes pages (page_id, url, html) to new archives in the shared folder and reads them back."""
    files = write(mark_revisits(pages, min_bytes=min_bytes), new_dir(pages.sparkSession, "warc"))
    return read(pages.sparkSession, files, split_bytes)
