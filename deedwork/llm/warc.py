"""Web archives written and read as a chunked record table.

Writing: each task appends one gzip member per record to archive files of its own and returns where each record lies. The index that comes of
it names the files of successful attempts only, so a lost executor leaves at most a file that nothing refers to. Equal payloads are stored once:
the other records refer to the one with the largest id.

Both sides take their rows in batches bounded by bytes. Reading: the index is dealt out by the bytes it stands for, each task opens the archives at its records' offsets and yields rows of (record, chunk number,
chunk, digest so far). A payload is never held whole, the last chunk of a record carries its full length and digest.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deedwork.llm.common import fold, materialized, place, python_ready
from deedwork.session import scratch_path

CHUNK_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 32 << 20
LEAST_SHARED_BYTES = 0
INDEX = "record long, archive string, at long, size long"
CHUNKS = "record long, record_type string, refers_to long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string, last boolean"


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


class _Archive:
    """One archive being written: gzip members, one for each record."""

    def __init__(self, folder: str):
        self.path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        system, inner = place(folder)
        system.create_dir(inner, recursive=True)
        system, inner = place(self.path)
        self.out, self.at = system.open_output_stream(inner, compression=None), 0

    def add(self, head: bytes, block: Iterator[bytes]) -> tuple[int, int]:
        packer, start = zlib.compressobj(6, zlib.DEFLATED, 31), self.at
        for part in (head, *block, b"\r\n\r\n"):
            self._put(packer.compress(part))
        self._put(packer.flush())
        return start, self.at - start

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)


def _parts(payload: bytes, chunk: int) -> Iterator[memoryview]:
    view = memoryview(payload)
    return (view[k : k + chunk] for k in range(0, len(view), chunk))


def _head(kind: str, record: int, url: str | None, length: int, fields: list[tuple[str, str]]) -> bytes:
    target = "".join(" " if c.isspace() else c for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{record}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}"] * bool(target) + [f"{a}: {b}" for a, b in fields]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def _writer(folder: str, chunk: int, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                record, url, refers_to, payload = (batch.column(c)[k].as_py() for c in ("record", "url", "refers_to", "payload"))
                if archive is None or archive.at >= archive_bytes:
                    if archive:
                        archive.out.close()
                    archive = _Archive(folder)
                digest = hashlib.sha1()
                for part in _parts(payload, chunk):
                    digest.update(part)
                fields = [("WARC-Payload-Digest", f"sha1:{_base32(digest.digest())}")]
                answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if refers_to is None:
                    fields.append(("Content-Type", "application/http; msgtype=response"))
                    head = _head("response", record, url, len(answer) + len(payload), fields)
                    at, size = archive.add(head, (answer, *_parts(payload, chunk)))
                else:
                    fields.append(("WARC-Refers-To", f"<urn:record:{refers_to}>"))
                    at, size = archive.add(_head("revisit", record, url, len(answer), fields), (answer,))
                rows.append({"record": record, "archive": archive.path, "at": at, "size": size})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("record", "int64"), ("archive", "string"), ("at", "int64"), ("size", "int64")]))
        if archive:
            archive.out.close()

    return run


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write ``record``, ``url``, ``refers_to`` and ``payload`` as archives under ``folder``; returns the index, one row per record."""
    return materialized(pages.mapInArrow(_writer(folder, chunk, archive_bytes), INDEX), "archive-index")


class _Member(io.RawIOBase):
    """The bytes of one gzip member, inflated a bounded piece at a time."""

    def __init__(self, file, at: int, size: int, piece: int):
        file.seek(at)
        self.file, self.left, self.piece, self.inflate, self.pending = file, size, piece, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.inflate.eof:
            if not self.pending and self.left:
                self.pending = self.file.read(min(self.left, self.piece))
                self.left -= len(self.pending)
            data = self.inflate.decompress(self.pending, len(into))
            self.pending = self.inflate.unconsumed_tail
            if data or not (self.pending or self.left):
                into[: len(data)] = data
                return len(data)
        return 0


def _fields(lines: io.BufferedReader) -> dict[str, str]:
    out = {}
    lines.readline()  # version or status
    while (line := lines.readline().strip()):
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def _number(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])


def _chunks_of(stream: io.BufferedReader, chunk: int) -> Iterator[dict]:
    head = _fields(stream)
    base = {"record": _number(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": None}
    length = int(_fields(stream)["content-length"])
    if base["record_type"] == "revisit":
        base["refers_to"] = _number(head["warc-refers-to"])
        yield base | {"chunk_no": 0, "chunk": b"", "bytes_so_far": 0, "digest_so_far": head["warc-payload-digest"].partition(":")[2], "last": True}
        return
    digest, done, number = hashlib.sha1(), 0, 0
    while True:
        data = stream.read(min(chunk, length - done))
        if not data and done < length:
            raise ValueError(f"record {base['record']} ends after {done} of {length} bytes")
        digest.update(data)
        done += len(data)
        yield base | {"chunk_no": number, "chunk": data, "bytes_so_far": done, "digest_so_far": _base32(digest.digest()), "last": done == length}
        if done == length:
            break
        number += 1
    if f"sha1:{_base32(digest.digest())}" != head["warc-payload-digest"]:
        raise ValueError(f"record {base['record']} does not have its digest")


def _reader(chunk: int):
    fields = [("record", "int64"), ("record_type", "string"), ("refers_to", "int64"), ("chunk_no", "int64"), ("chunk", "binary")]
    schema = pa.schema([*fields, ("bytes_so_far", "int64"), ("digest_so_far", "string"), ("last", "bool")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            held, rows = 0, []
            for k in range(batch.num_rows):
                path, at, size = (batch.column(c)[k].as_py() for c in ("archive", "at", "size"))
                if path != name:
                    system, inner = place(path)
                    name, file = path, system.open_input_file(inner)
                for row in _chunks_of(io.BufferedReader(_Member(file, at, size, chunk)), chunk):
                    rows.append(row)
                    held += len(row["chunk"])
                    if held >= 16 * chunk:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        held, rows = 0, []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_chunks(index: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives that ``index`` lists."""
    python_ready(index.sparkSession)
    stored = index.agg(F.sum("size")).first()[0] or 0
    # Neighbours in an archive go to one task, and no task gets many more bytes than ``READ_BYTES``, however small the index is.
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-stored // READ_BYTES))
    dealt = index.repartitionByRange(tasks, "archive", "at").sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(_reader(chunk), CHUNKS)


def _payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "utf-8")


def archive_pages(
    pages: DataFrame,
    folder: str | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_shared_bytes: int = LEAST_SHARED_BYTES,
    archive_bytes: int = ARCHIVE_BYTES,
    chunk: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Write one record per row and return the index of the archives and their chunked record table.

    ``folder`` must be one that all executors reach; by default it lies in the scratch folder. Records with equal payloads of at least
    ``least_shared_bytes`` are revisits of the one with the largest id. A null payload is empty. Rows that repeat the id of such a record
    are responses too; a row without an id is written as a response of record -1. An empty table writes nothing.
    """
    spark: SparkSession = pages.sparkSession
    python_ready(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder or scratch_path(spark, "archives"))
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    rows = fold(pages, {"record": id_col, "url": url_col, "html": payload_col})
    rows = rows.select("record", "url", _payload(F.col("html")).alias("payload")).withColumn("sha1", F.sha1("payload"))
    shared = rows.select("record", "sha1", F.octet_length("payload").alias("n")).where(F.col("n") >= least_shared_bytes)
    shared = shared.groupBy("sha1", "n").agg(F.max("record").alias("largest"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    shared = shared.select(F.col("sha1").alias("shared_sha1"), "n", "largest")
    same = (F.col("sha1") == F.col("shared_sha1")) & (F.octet_length("payload") == F.col("n"))
    rows = rows.join(shared, same, "left")
    rows = rows.select(
        F.coalesce(F.col("record"), F.lit(-1)).cast("bigint").alias("record"),
        F.col("url").cast("string"),
        F.when(F.col("record") < F.col("largest"), F.col("largest")).cast("bigint").alias("refers_to"),
        "payload",
    )
    index = write_archives(rows, folder, archive_bytes, chunk)
    return index, read_chunks(index, chunk)


def record_table(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: ``record``, ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``.

    A revisit takes the length of the response that it refers to; both state the same digest.
    """
    ends = materialized(chunks.where("last").drop("chunk", "chunk_no", "last"), "record-ends")
    told = ends.where("record_type = 'revisit'").select(F.col("refers_to").alias("record")).distinct()
    lengths = ends.where("record_type = 'response'").join(told, "record", "left_semi")
    lengths = lengths.groupBy(F.col("record").alias("first")).agg(F.max("bytes_so_far").alias("first_bytes"))
    out = ends.join(lengths, (F.col("refers_to") == F.col("first")) & (F.col("record_type") == "revisit"), "left")
    size = F.when(F.col("record_type") == "revisit", F.col("first_bytes")).otherwise(F.col("bytes_so_far"))
    return out.select("record", "record_type", "refers_to", size.alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"))
