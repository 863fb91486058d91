"""WARC archives as a PySpark Python data source.

``spark.read.format("warc").load(folder)`` plans its partitions from the sizes of the
archive files, so that each reads about ``target_mb``.  Every record is a gzip member of
its own whose header carries, in the "sl" extra field, the member's compressed length.
The reader inflates a record's headers first and applies the pushed predicates on record
type and header columns; a record that fails is skipped by its length, unread, and with
option ``payload=false`` no payload is decoded at all.  Members without the field are
read through.

Writing (``df.write.format("warc")``) turns rows (record_id, record_type, target_uri,
refers_to, payload) into records; each task writes files of its own, named by partition
and attempt, and the driver drops those of attempts that did not commit.

Paths are opened through pyarrow's file systems, so any store that it knows will do.

Cases: a null payload is written as an empty one, a null URI is read back as null, blanks
and control characters in a URI are percent-encoded; a very long payload is one record, held
in memory alone; records with equal ids or equal content are all kept; a folder without
archives, or with empty ones, gives no rows; columns beside those written are not read, so
their names do not matter; records without a type or an id have nulls there.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from flowtally.llm.common import new_path, store

HEADERS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long"
SCHEMA = f"{HEADERS}, payload binary"
FILE_MB, TARGET_MB, BATCH_MB, LEAST_REVISIT = 64, 64, 8, 1000
BLANK = re.compile(r"[\s\x00-\x1f]")
# Fixed value: records carry this time, since pages have none.
DATE = "2024-01-01T00:00:00Z"


def open_store(path: str):
    """File system and plain path of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(content: bytes) -> bytes:
    """A gzip member with its compressed and plain lengths in the extra field "sl"."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(content) + squeeze.flush()
    length = 10 + 2 + 4 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, length, len(content) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


def record(row) -> bytes:
    """A WARC/1.1 record: an HTTP response with its payload, or a revisit with the headers alone."""
    payload = row.payload or b""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row.record_type == "revisit"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row.record_type}",
        f"WARC-Record-ID: <{row.record_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {BLANK.sub(lambda m: quote(m[0]), row.target_uri or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest.digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{row.refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, int], ...]

    def __init__(self, paths):
        self.paths = tuple(paths)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


def header_row(raw: bytes) -> dict:
    """The header columns of a record's header block."""
    fields = {}
    for line in raw.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    digest = fields.get("warc-payload-digest", "")
    if digest.lower().startswith("sha1:"):
        digest = base64.b32decode(digest[5:].upper()).hex()
    size = fields.get("x-payload-length")
    return {
        "record_id": fields.get("warc-record-id", "").strip("<>") or None,
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri") or None,
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None,
        "payload_digest": digest or None,
        "payload_bytes": int(size) if size and size.isdigit() else None,
    }


def test(filter_: Filter):
    """A pushed filter as a test of header columns; None if it can't be pushed."""
    column = getattr(filter_, "attribute", ())
    if len(column) != 1 or column[0] not in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes"):
        return None
    name, value = column[0], getattr(filter_, "value", None)
    known = lambda f: (lambda row: row[name] is not None and f(row[name]))
    match filter_:
        case EqualTo():
            return known(lambda v: v == value)
        case EqualNullSafe():
            return lambda row: row[name] == value
        case In():
            return known(lambda v: v in value)
        case IsNotNull():
            return known(lambda v: True)
        case StringStartsWith():
            return known(lambda v: v.startswith(value))
        case StringEndsWith():
            return known(lambda v: v.endswith(value))
        case StringContains():
            return known(lambda v: value in v)
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, wants_payload: bool):
        self.path, self.target, self.wants_payload, self.filters = options["path"], float(options.get("target_mb", TARGET_MB)) * 1e6, wants_payload, []

    def pushFilters(self, filters):
        for f in filters:
            if test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        from pyarrow import fs

        store, place = open_store(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and f.base_name.endswith(".warc.gz"))
        groups, size = [[]], 0.0
        for path, length in found:
            if groups[-1] and size + length > self.target:
                groups.append([])
                size = 0.0
            groups[-1].append((path, length))
            size += length
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        tests = [test(f) for f in self.filters]
        names = [x.split()[0] for x in (SCHEMA if self.wants_payload else HEADERS).split(", ")]
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        rows, held = [], 0
        for path, _ in partition.paths:
            with store.open_input_file(path) as file:
                for row in self.records(file, tests):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 200
                    if held > BATCH_MB << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, file, tests) -> Iterator[dict]:
        size, at = file.size(), 0
        while at < size:
            file.seek(at)
            head = file.read(1 << 12)
            length = struct.unpack("<I", head[16:20])[0] if len(head) > 24 and head[3] & 4 and head[12:14] == b"sl" else None
            inflate, fed = zlib.decompressobj(31), head[:length] if length else head
            content = inflate.decompress(fed, 1 << 14)
            # The headers first; more of the member only if they are long.
            while b"\r\n\r\n" not in content and not inflate.eof:
                more = inflate.unconsumed_tail or file.read(1 << 16)
                if not more:
                    break
                content += inflate.decompress(more, 1 << 14)
            raw, _, rest = content.partition(b"\r\n\r\n")
            row = header_row(raw)
            passes = all(t(row) for t in tests)
            if length and not (passes and self.wants_payload and row["record_type"] == "response"):
                at += length
            else:
                if length and length > len(head):
                    file.seek(at)
                    content = zlib.decompress(file.read(length), 31)
                    at += length
                elif length:
                    content += inflate.decompress(inflate.unconsumed_tail)
                    at += length
                else:
                    parts = [content]
                    while not inflate.eof:
                        more = inflate.unconsumed_tail or file.read(1 << 16)
                        if not more:
                            break
                        parts.append(inflate.decompress(more))
                    content, at = b"".join(parts), file.tell() - len(inflate.unused_data)
                rest = content[len(raw) + 4 :]
            if not passes:
                continue
            if self.wants_payload:
                row["payload"] = rest.partition(b"\r\n\r\n")[2][:-4] if row["record_type"] == "response" else None
            yield row


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.file_mb, self.job = options["path"], float(options.get("file_mb", FILE_MB)), uuid.uuid4().hex[:8]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        store, place = open_store(self.path)
        store.create_dir(place, recursive=True)
        task, names, file, size = TaskContext.get(), [], None, 0
        try:
            for row in iterator:
                if file is None or size > self.file_mb * 1e6:
                    if file is not None:
                        file.close()
                    names.append(f"part-{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):04d}.warc.gz")
                    file, size = store.open_output_stream(f"{place}/{names[-1]}", compression=None), 0
                out = member(record(row))
                file.write(out)
                size += len(out)
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def _drop(self, keep: set[str]) -> None:
        from pyarrow import fs

        store, place = open_store(self.path)
        for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name not in keep:
                store.delete_file(f.path)

    def commit(self, messages) -> None:
        store, place = open_store(self.path)
        store.create_dir(place, recursive=True)
        self._drop({n for m in messages if m is not None for n in m.names})

    def abort(self, messages) -> None:
        self._drop(set())


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def _payload(self) -> bool:
        return str(self.options.get("payload", "true")).lower() != "false"

    def schema(self) -> str:
        return SCHEMA if self._payload() else HEADERS

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options), self._payload())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the source known and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Pages as rows to archive: of equal payloads of at least ``least`` bytes the largest page_id is the response, the others revisit it.

    Which pages revisit is settled on ids and digests alone; payloads only meet that list, by
    page_id, so copies of one page never gather in a task (and a short list leaves the
    payloads where they are).  A null page is an empty payload; of rows that also share their
    page_id, all are responses.
    """
    raw = F.coalesce(F.encode(F.col(html), "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("target_uri"), raw.alias("payload")).withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha1("payload")))
    digests = store(rows.where("digest is not null").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    first = store(digests.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("first"), F.sum("n").alias("copies")).where("copies > 1 and first is not null").drop("copies"), "first")
    revisits = digests.join(first, F.col("digest") == F.col("_d")).where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = store(revisits.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first"), "revisits")
    revisit = F.col("first").isNotNull()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select(urn("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(revisit, urn("first")).alias("refers_to"), "payload")


def archive(pages: DataFrame, path: str, **columns) -> None:
    """Writes a record for every page to archives in the folder ``path``."""
    register(pages.sparkSession)
    records_of(pages, **columns).write.format("warc").mode("append").save(path)


def page_index(pages: DataFrame) -> DataFrame:
    """Archives all pages in the shared folder and reads back page_id, payload_bytes, payload_digest, record_type and refers_to.

    Responses are measured by the payload read; revisits, which carry none, by their headers.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    archive(pages, path)
    rows = spark.read.format("warc").load(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    response = F.col("record_type") == "response"
    return rows.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )
