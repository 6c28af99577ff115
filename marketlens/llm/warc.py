"""WARC archives: writing, normalising monolithic gzip files, and reading by offset.

``write_archives`` writes one record per row into files that are a single gzip stream (as
some crawlers leave them).  ``normalise`` inflates each such stream once, from start to
end, and rewrites every record as its own gzip member; the sidecar index (a DataFrame,
written as Parquet) has the file, offset and length of each record, so that a record can be
read alone.  ``read_records`` does that.

Tasks write under names that hold the attempt, and only the names in the index count, so a
task that is repeated after an executor was lost leaves at most an unreferenced file.  A
file is processed as a stream with one record in memory.  Files are opened through the
file system of the shared folder's URI.

Defined cases: a null payload is the empty payload; null record ids and URLs are kept as
null (the headers are left out); repeated rows give repeated records, all of them
responses if they hold the smallest id; an empty table gives no file and no rows; a file
that ends inside a record raises an error.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shared import open_fs

LEVEL = 6
CHUNK = 1 << 20
DATE = "2024-01-01T00:00:00Z"  # fixed, so that reruns write the same bytes
INDEX = "path string, offset bigint, length bigint, record_type string, record_key bigint"


def payload_sha1(payload: Column) -> Column:
    """SHA-1 of the UTF-8 payload (null: empty) as 40 hex digits."""
    return F.sha1(F.coalesce(payload, F.lit("")).cast("binary"))


def plan_records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """Rows to write: ``id``, ``url``, ``digest``, ``n_bytes``, ``refers_to`` and ``payload`` (null for revisits).

    Of equal payloads of at least ``least_bytes`` bytes the smallest id is the response and the
    others revisit it.  Only digests and ids meet in the grouping; the join that follows is
    split by adaptive execution when one payload holds many rows.
    """
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": payload_sha1(F.col("payload")), "n_bytes": F.octet_length("payload").cast("bigint")})
    first = rows.filter(F.col("n_bytes") >= least_bytes).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = first.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return rows.join(first, rows["digest"] == first["d"], "left").withColumn("refers_to", refers).select(
        "id", "url", "digest", "n_bytes", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))


def _record(row: dict) -> bytes:
    payload = (row["payload"] or "").encode("utf-8", "surrogatepass")
    revisit = row["refers_to"] is not None
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode() + payload
    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}"]
    if row["id"] is not None:
        head.append(f"WARC-Record-ID: <urn:page:{row['id']}>")
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _attempt(folder: str, kind: str, seq: int) -> str:
    c = TaskContext.get()
    return f"{folder}/{kind}-{c.partitionId():05d}-{c.taskAttemptId()}-{seq}.warc.gz"


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write the rows of ``plan_records`` as monolithic gzip files; returns their paths (``path``).

    The result has to be written or cached by the caller (``cut``) before it is used twice.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        out, zipped, size, seq = None, None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = _attempt(folder, "mono", seq)
                    fs.create_dir(open_fs(folder)[1], recursive=True)
                    out = fs.open_output_stream(open_fs(path)[1], compression=None)
                    zipped, size = zlib.compressobj(1, zlib.DEFLATED, 31), 0
                data = _record(row)
                out.write(zipped.compress(data))
                size += len(data)
                if size >= archive_bytes:
                    out.write(zipped.flush())
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path]})
                    out, seq = None, seq + 1
        if out is not None:
            out.write(zipped.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path]})

    return records.mapInArrow(run, "path string")


def inflate(stream) -> Iterator[bytes]:
    """The bytes of a gzip file (one member or many) in chunks, read once."""
    un = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            part = un.decompress(data, CHUNK)
            if part:
                yield part
            data = un.unconsumed_tail
            if un.eof:
                data, un = un.unused_data, zlib.decompressobj(31)
    tail = un.flush()
    if tail:
        yield tail


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole WARC records (with the two closing line breaks) of a byte stream; one is in memory at a time."""
    buf = bytearray()

    def more() -> bool:
        part = next(chunks, None)
        if part is not None:
            buf.extend(part)
        return part is not None

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if bytes(buf).strip():
                    raise ValueError("the archive ends inside a record header")
                return
        size = end + 4 + int(header(bytes(buf[:end])).get("content-length", "0")) + 4
        while len(buf) < size:
            if not more():
                raise ValueError("the archive ends inside a record")
        yield bytes(buf[:size])
        del buf[:size]


def header(raw: bytes) -> dict[str, str]:
    """Field names in lower case and values of a header block; the first line is kept under ``""``."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    out = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _key(value: str | None) -> int | None:
    return int(value.strip("<>").rpartition(":")[2]) if value else None


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``path`` with a gzip member per record; returns the index of the new files."""
    archives = archives.select("path").distinct()
    archives = archives.repartition(max(archives.count(), 1), "path")  # a path row is small, its archive is not

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for source in batch["path"].to_pylist():
                target = _attempt(folder, "record", seq)
                seq += 1
                fs, at = open_fs(source)
                to, dest = open_fs(target)
                to.create_dir(dest.rsplit("/", 1)[0], recursive=True)
                rows, offset = {k: [] for k in ("path", "offset", "length", "record_type", "record_key")}, 0
                with fs.open_input_stream(at, compression=None) as stream, to.open_output_stream(dest, compression=None) as out:
                    for record in split_records(inflate(stream)):
                        fields = header(record[: record.find(b"\r\n\r\n")])
                        member = gzip.compress(record, LEVEL, mtime=0)
                        out.write(member)
                        for k, v in zip(rows, (target, offset, len(member), fields.get("warc-type"), _key(fields.get("warc-record-id"))), strict=True):
                            rows[k].append(v)
                        offset += len(member)
                        if len(rows["path"]) >= 10_000:
                            yield _index_batch(rows)
                            rows = {k: [] for k in rows}
                yield _index_batch(rows)

    return archives.mapInArrow(run, INDEX)


def _index_batch(rows: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(rows, schema=pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_key", pa.int64())]))


RECORDS = ("record_key bigint, record_type string, url string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def by_stretch(index: DataFrame, stretch_bytes: int = 32 << 20) -> DataFrame:
    """The index dealt out with a partition for each stretch of a file, in the order of the file.

    Index rows are small beside the records, so partitions of equal index bytes would be few.
    """
    stretch = F.floor(F.col("offset") / F.lit(stretch_bytes))
    stretches = index.select("path", stretch).distinct().count()
    return index.repartition(max(stretches, 1), F.col("path"), stretch).sortWithinPartitions("path", "offset")


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the members that an index lists, each by its offset and length.

    ``payload_bytes`` is the HTTP length (of a revisit: that of the payload it refers to).
    The digest of a response is computed from the bytes read; one that differs from its header
    raises an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            out = {k: [] for k in ("record_key", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload")}
            for row in batch.to_pylist():
                if row["path"] != opened:
                    fs, at = open_fs(row["path"])
                    opened, stream = row["path"], fs.open_input_file(at)
                record = gzip.decompress(stream.read_at(row["length"], row["offset"]))
                end = record.find(b"\r\n\r\n")
                fields = header(record[:end])
                body = record[end + 4 : -4]
                split = body.find(b"\r\n\r\n")
                http, payload = header(body[:split]), body[split + 4 :]
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"digest differs at {row['path']}:{row['offset']}")
                for k, v in zip(out, (_key(fields.get("warc-record-id")), fields["warc-type"], fields.get("warc-target-uri"), _key(fields.get("warc-refers-to")),
                                      int(http["content-length"]), digest, payload if with_payload and fields["warc-type"] == "response" else None), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("record_key", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()),
                ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]))

    return index.mapInArrow(run, RECORDS)
