"""WARC archives: writing, revisit resolution, deduplicated rewriting and reading.

Payloads never move between tasks. The first pass writes one archive per task and returns one
header row per record; only these rows are shuffled, by payload digest, and joined with the record
that keeps the payload. The second pass gives each task the decisions of whole archives, and streams
their records into new archives with fresh headers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorrel.llm.workspace import CommittedFile, Workspace, open_input

ARCHIVE_BYTES = 64 << 20
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = "file string, offset long, length long, page_id long, record_id string, digest string, payload_bytes long"
_FILES = "file string, records long, bytes long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value: control characters and spaces are percent-encoded, so a URL can't add header lines."""
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record_bytes(kind: str, fields: list[tuple[str, str | None]], payload: bytes | None) -> bytes:
    """One gzip member holding one WARC/1.1 record; a revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n" if payload is not None else "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head.encode() + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of one decompressed record."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def read_members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], stream.read(chunk)
    while data:
        parts.append(z.decompress(data))
        if z.eof:
            yield b"".join(parts)
            data = z.unused_data
            z, parts = zlib.decompressobj(31), []
            if data:
                continue
        data = stream.read(chunk)
    if any(parts):
        raise ValueError("the archive ends inside a record")


def write_archives(pages: DataFrame, ws: Workspace, name: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """One response record per row; returns the index table (file, offset, length, page_id, record_id, digest, payload_bytes)."""
    folder = ws.sub(name)

    def write(batches):
        import pyarrow as pa

        part, out, n, stem = TaskContext.get().partitionId(), None, 0, ""
        for batch in batches:
            rows = []
            for page, url, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out:
                        out.close()
                    out = CommittedFile(folder, f"part-{part:06d}", ".warc.gz")
                payload, stem = payload or b"", out.name
                rid, digest = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{stem}#{n}')}>", payload_digest(payload)
                fields = [("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", _safe(url) if url is not None else None), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", str(page) if page is not None else None), ("X-Payload-Bytes", str(len(payload)))]
                at, data = out.size, record_bytes("response", fields, payload)
                out.write(data)
                rows.append((stem, at, len(data), page, rid, digest, len(payload)))
                n += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["file", "offset", "length", "page_id", "record_id", "digest", "payload_bytes"])
        if out:
            out.close()

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    return ws.table(src.mapInArrow(write, _INDEX), f"{name}-index")


def resolve_revisits(index: DataFrame, ws: Workspace, min_bytes: int = 0) -> DataFrame:
    """The index with ``refers_id`` and ``refers_page``: set where another record keeps the payload.

    Of records of equal digest and length, that with the largest page_id (null lowest; then the
    last in file and offset) stays a response. Payloads under ``min_bytes`` are never revisits.
    """
    keep = (
        index.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest", "payload_bytes")
        .agg(F.max(F.struct("page_id", "file", "offset", "record_id")).alias("w"), F.count("*").alias("n"))
        .where("n > 1")
        .selectExpr("digest AS k_digest", "payload_bytes AS k_bytes", "w.page_id AS w_page", "w.file AS w_file", "w.offset AS w_offset", "w.record_id AS w_record")
    )
    keep = ws.table(keep, "kept")
    other = F.expr("w_record IS NOT NULL AND NOT (file = w_file AND offset = w_offset)")
    return index.join(keep, (index.digest == keep.k_digest) & (index.payload_bytes == keep.k_bytes), "left").select(
        "file", "offset", "length", "page_id", "record_id", "digest", "payload_bytes",
        F.when(other, F.col("w_record")).alias("refers_id"), F.when(other, F.col("w_page")).alias("refers_page"),
    )


def rewrite_archives(decided: DataFrame, ws: Workspace, source: str, target: str) -> DataFrame:
    """Stream the archives of ``source`` into deduplicated ones; returns their table (file, records, bytes)."""
    src, dst = ws.sub(source), ws.sub(target)

    def rewrite(batches):
        import pyarrow as pa

        part, out, n, done = TaskContext.get().partitionId(), None, 0, []
        opened, stream = "", None
        for batch in batches:
            for file, offset, length, rid, refers_id, refers_page in zip(*(c.to_pylist() for c in batch.columns)):
                if file != opened:
                    if stream:
                        stream.close()
                    opened, stream = file, open_input(src, file)
                stream.seek(offset)
                old, payload = parse_record(zlib.decompress(stream.read(length), 31))
                if old["WARC-Record-ID"] != rid:
                    raise ValueError(f"{file} at {offset}: the index names another record")
                fields = [(k, old.get(k)) for k in ("WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "X-Page-ID", "X-Payload-Bytes")]
                if refers_id is not None:
                    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_id), ("X-Refers-To-Page-ID", str(refers_page) if refers_page is not None else None)]
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out:
                        done.append((out.close(), n, out.size))
                    out, n = CommittedFile(dst, f"part-{part:06d}", ".warc.gz"), 0
                out.write(record_bytes("response" if refers_id is None else "revisit", fields, payload if refers_id is None else None))
                n += 1
        if stream:
            stream.close()
        if out:
            done.append((out.close(), n, out.size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    n = int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = decided.select("file", "offset", "length", "record_id", "refers_id", "refers_page").repartition(n, "file").sortWithinPartitions("file", "offset")
    return ws.table(dealt.mapInArrow(rewrite, _FILES), f"{target}-files")


def read_archives(files: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records of the archives that ``files`` names, each response checked against its digest."""

    def read(batches):
        import pyarrow as pa

        names = [x.strip() for x in _RECORD.split(",")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in names]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, stream = [], open_input(folder, file)
                for raw in read_members(stream):
                    f, payload = parse_record(raw)
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Bytes"])
                    if f["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"{file}: a payload doesn't match its digest")
                    page, refers = f.get("X-Page-ID"), f.get("X-Refers-To-Page-ID")
                    rows.append((int(page) if page else None, f.get("WARC-Target-URI"), size, digest, f["WARC-Type"], int(refers) if refers else None, file))
                stream.close()
                for i in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), kinds)], [x.split()[0] for x in names])

    return files.select("file").repartition(tasks).mapInArrow(read, _RECORD)


def dedupe_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, deduplicate them, and return the records read back.

    A null html is an empty payload, and equals an empty one. A null url or page_id is left out of
    the record and null again when read. Repeated rows give a record each; repeated page_ids are
    told apart by file and offset. A page may be as long as a task can hold twice. An empty table
    gives no archive and no rows. Further columns are ignored.
    """
    ws = Workspace(spark, "warc")
    index = write_archives(pages, ws, "raw", date)
    files = rewrite_archives(resolve_revisits(index, ws, min_bytes), ws, "raw", "deduped")
    ws.drop("raw")
    n = files.count()
    return read_archives(files, ws.sub("deduped"), max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 8))))
