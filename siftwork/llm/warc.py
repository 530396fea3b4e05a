"""Web archives: pages written as WARC records, and archives read back as a chunked record table.

Writing: a task streams its records into gzip members, one per record, and starts a new file when
one is full.  A file's name holds the attempt that wrote it; the manifest, a table committed by
Spark, names the files of the attempts that counted, so a lost or repeated task leaves nothing
half-written in view.

Reading: a task walks through a file with a fixed buffer.  A payload becomes rows (record_id,
chunk) of at most `CHUNK` bytes with the number of bytes and the SHA-1 so far, so neither a task
nor a row ever holds a whole oversized payload; the last row of a record has the final digest.

Archives go to any store that pyarrow's file systems reach from the executors (a shared folder,
HDFS, an object store)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_of

CHUNK = 1 << 20
#: Bytes of payload after which a task starts the next file.
SEGMENT = 1 << 27
_LEVEL = 4
_URN = "urn:siftwork:page:"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]+")

MANIFEST = "path string, records bigint, payload_bytes bigint"
CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, chunk int, data binary, "
    "payload_bytes bigint, payload_digest string, last boolean, intact boolean"
)
_CHUNKS_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("chunk", pa.int32()), ("data", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("last", pa.bool_()), ("intact", pa.bool_()),
    ]
)
_MANIFEST_ARROW = pa.schema([("path", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())])


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def with_revisits(pages: DataFrame, work: Workspace, least: int = 0) -> DataFrame:
    """The pages with `refers_to`: the largest page_id among those with an equal payload of at
    least `least` bytes, null where that is the page itself.

    Payloads are compared by SHA-1 and length.  Only digests are shuffled, reduced per task first,
    so a payload that a third of all pages share is one row per task; payloads that occur once
    are gone before the join.  Pages without an identifier refer to one that has one; among
    themselves they are all responses."""
    body = F.encode(text_of("html"), "UTF-8")
    keyed = pages.select("page_id", "url", "html", F.sha1(body).alias("_sha1"), F.octet_length(body).alias("_size"))
    shared = (
        keyed.filter(F.col("_size") >= least)
        .groupBy("_sha1", "_size")
        .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull())
        .drop("_n")
    )
    joined = keyed.join(work.keep(shared), ["_sha1", "_size"], "left")
    other = F.when(F.col("page_id").eqNullSafe(F.col("_first")), None).otherwise(F.col("_first"))
    return joined.select("page_id", "url", "html", other.alias("refers_to"))


def _record_head(page_id, url, refers_to, payload: bytes) -> tuple[bytes, bytes]:
    """The record's header and the HTTP header its block begins with."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = len(http) + (len(payload) if refers_to is None else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'none' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_CONTROL.sub('', url or '') or 'about:blank'}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {block}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_archives(pages: DataFrame, folder: str, segment: int = SEGMENT) -> DataFrame:
    """Write (page_id, url, html, refers_to) as archives under `folder`; the frame returned is the
    manifest, and the archives are written when it is.  A null html is an empty payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, number, records, size = None, "", 0, 0, 0

        def manifest() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(path=path, records=records, payload_bytes=size)], _MANIFEST_ARROW)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for row in range(batch.num_rows):
                page_id, url, html, refers_to = (c[row].as_py() for c in columns)
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}-{number:04d}"
                    path, records, size = f"{folder}/{name}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                payload = (html or "").encode()
                head, http = _record_head(page_id, url, refers_to, payload)
                member = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                out.write(member.compress(head + http))
                if refers_to is None:
                    for lo in range(0, len(payload), CHUNK):
                        out.write(member.compress(memoryview(payload)[lo : lo + CHUNK]))
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records, size = records + 1, size + len(payload)
                if size >= segment:
                    out.close()
                    out, number = None, number + 1
                    yield manifest()
        if out is not None:
            out.close()
            yield manifest()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, MANIFEST)


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    found = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def _http_length(stream: io.BufferedReader) -> tuple[int, int]:
    """Bytes that the HTTP header takes and the payload length it states."""
    took, length = 0, 0
    while line := stream.readline():
        took += len(line)
        if line in (b"\r\n", b"\n"):
            break
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            length = int(value)
    return took, length


def read_records(stream: io.BufferedReader, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of the chunk table from one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        head = _headers(stream)
        took, stated = _http_length(stream)
        left = int(head["content-length"]) - took
        kind, urn = head["warc-type"], head["warc-record-id"].strip("<>")
        who = (urn, _page(urn), kind, _page(head.get("warc-refers-to")))
        declared = head["warc-payload-digest"].rpartition(":")[2]
        if kind == "revisit":
            yield (*who, 0, b"", stated, declared, True, True)
            continue
        digest, done, number = hashlib.sha1(), 0, 0
        while True:
            data = stream.read(min(chunk, left))
            if not data and left:
                raise EOFError(f"record {urn} ends {left} bytes early")
            digest.update(data)
            done, left = done + len(data), left - len(data)
            so_far = base32_sha1(digest.digest())
            intact = so_far == declared and done == stated if not left else None
            yield (*who, number, data, done, so_far, not left, intact)
            number += 1
            if not left:
                break


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a written manifest, one task per archive.  A damaged
    archive fails the read; a payload that differs from its declared digest has intact = false."""
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _CHUNKS_ARROW, strict=True)], schema=_CHUNKS_ARROW
            )

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place, compression=None) as raw:
                    rows, held = [], 0
                    for row in read_records(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16), chunk):
                        rows.append(row)
                        held += len(row[5]) + 200
                        if held > 4 * CHUNK:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return manifest.select("path").repartition(files).mapInArrow(read, CHUNKS)


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written as archives and read back: the chunk table."""
    spark = pages.sparkSession
    work = Workspace(spark)
    marked = with_revisits(pages, work, least)
    manifest = work.keep(write_archives(marked, f"{work.folder}/warc"))
    return read_archives(spark, manifest)
