"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes its rows as gzip members, one a record, to a file of its own
in the archive folder, and returns an index row for each: file, offset, length,
URL, digest. The index is a Parquet table that only successful tasks reach, so
a file left by a lost attempt is never read. Readers take any selection of the
index, sort it by file and offset, and fetch neighbouring records in one read
(gaps up to ``MAX_GAP``, reads up to ``MAX_READ`` bytes or one record).

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
smallest id is a response and the others revisit it. Defined results: a null
payload is empty; a null url has no target line; a null id never is the
smallest, and revisits the one that is (with none it is a response); rows that
repeat the smallest id are responses; an empty table gives an empty index.
The folder may be on any store that pyarrow.fs opens by URI.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import cut

MAX_GAP, MAX_READ, BUFFER = 1 << 16, 1 << 23, 1 << 22
#: Archive bytes that a task reads back, about.
TASK = 1 << 22
DATE = "2024-01-01T00:00:00Z"
_INDEX = "page_id bigint, url string, file string, offset bigint, length bigint, digest string, record_type string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; Hadoop's names for S3 are known."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", folder))


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One record, with the blank lines that end it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""

    def fields(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["Content-Length"])]
    if not raw.startswith(b"WARC/") or len(rest) != len(block) + 4:
        raise ValueError("not a whole WARC record")
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(head), payload


def _writer(folder: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        held = bytearray()
        for batch in batches:
            rows = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = payload or b""
                digest = digest32(payload)
                pack = zlib.compressobj(4, wbits=31)
                member = pack.compress(record(page_id, url, payload, digest, refers_to)) + pack.flush()
                rows.append((page_id, url, name, at, len(member), digest, "response" if refers_to is None else "revisit"))
                at += len(member)
                held += member
                if len(held) > BUFFER:
                    out = out or store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(bytes(held))
                    held.clear()
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in _INDEX.split(", ")])
        if at:
            out = out or store.open_output_stream(f"{base}/{name}", compression=None)
            out.write(bytes(held))
            out.close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes every row under ``folder`` (a URI) and returns the index, read from ``folder``/index."""
    store, base = opened(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= min_bytes
    # Written first, so that the join shuffles both sides for itself and Spark can split a hot payload.
    first = cut(rows.where(large).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"))
    refers: Column = F.when(large & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(first, "sha", "left").select("page_id", "url", "payload", refers.alias("refers_to"))
    rows.mapInArrow(_writer(folder), _INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.parquet(f"{folder}/index")


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows (file, offset, length), sorted, that one read fetches."""
    a = 0
    for b in range(1, len(rows) + 1):
        if b < len(rows):
            file, start, _ = rows[a]
            last_file, last_at, last_size = rows[b - 1]
            if rows[b][0] == last_file and rows[b][1] - last_at - last_size <= MAX_GAP and rows[b][1] + rows[b][2] - start <= MAX_READ:
                continue
        yield a, b
        a = b


def _reader(folder: str, with_payload: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for a, b in ranges(rows):
                if rows[a][0] != name:
                    name, source = rows[a][0], store.open_input_file(f"{base}/{rows[a][0]}")
                begin = rows[a][1]
                data = source.read_at(rows[b - 1][1] + rows[b - 1][2] - begin, begin)
                out = []
                for _, at, size in rows[a:b]:
                    warc, http, payload = parse(zlib.decompress(data[at - begin : at - begin + size], wbits=31))
                    digest, kind = warc["WARC-Payload-Digest"].removeprefix("sha1:"), warc["WARC-Type"]
                    if kind == "response" and digest32(payload) != digest:
                        raise ValueError(f"{name} at {at}: the payload does not have its digest")
                    own, other = warc.get("X-Page-ID"), warc.get("X-Refers-To-Page-ID")
                    out.append((own and int(own), warc.get("WARC-Target-URI"), int(http["Content-Length"]), digest, kind, other and int(other), payload if with_payload else None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return run


def read(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits' stead: empty)."""
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(1, -(-int(size) // TASK))
    rows = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, with_payload), "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Every page written and read back."""
    return read(write(pages, folder), folder, with_payload=False).drop("payload", "url")
