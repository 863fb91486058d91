"""Token ids as Parquet list columns that can be read in part.

Layout: rows in ascending doc_id, one file per range of ids.  ``ids`` (list of int) is
dictionary-coded, the sorted and running columns (doc_id, first, n_tokens) are delta-coded
by the v2 writer; row groups and pages are small enough that their indexes let a reader
skip to some documents, and the metadata columns can be read without any token.
``first`` counts the ids before a document within its file; a file's offset is the sum of
the files before it, found from the metadata columns alone.

Texts are dealt by ranges of (doc_id, hash of the text) before they are encoded, so one
id that repeats in many rows does not fill one task, and each range is sorted and encoded
in a stream.

Cases: a null text is encoded as empty and still gets its end id; null ids come first;
repeated ids follow each other in the order of their texts; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowtally.llm.common import new_path, slices
from flowtally.llm.tokens import encoder

END_ID, BROADCAST_FILES = 2, 100_000
# Row groups of 16 MB, pages of 128 kB or 2,000 rows with min/max and offset indexes.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.page.write-checksum.enabled": "true",
}


def with_end(flat: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each text's ids; returns flat ids and the bounds of the texts."""
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(bounds[-1]), end_id, np.int32)
    body = np.ones(len(out), bool)
    body[bounds[1:] - 1] = False
    out[body] = flat
    return out, bounds


def write_tokens(docs: DataFrame, path: str, vocabulary: str, keeps_spaces: bool = False, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encodes every whole text and writes (doc_id, part, first, n_tokens, ids) to ``path``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, coder = TaskContext.get().partitionId(), 0, encoder(vocabulary, keeps_spaces)
        for batch in batches:
            for piece, texts in slices(batch, 1):
                ids, bounds = with_end(*coder.encode(texts), end_id)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
                n = len(texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), lists], names=["doc_id", "part", "first", "n_tokens", "ids"])
                before += int(bounds[-1])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(encode, f"doc_id {kind}, part int, first long, n_tokens long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``start``: the ids of all documents before it."""
    rows = spark.read.parquet(path)
    files = rows.groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("ids"))
    offsets = files.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    # One row per file: broadcast while that is proven small, else joined.
    small = len(rows.inputFiles()) <= BROADCAST_FILES
    return rows.join(F.broadcast(offsets) if small else offsets, "part").withColumn("start", (F.col("offset") + F.col("first")).cast("long")).drop("offset")


def id_digests(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """Replaces the list column ``ids`` by ``ids_crc32`` (unsigned crc32 of the ids as little-endian 32-bit integers)."""
    at = rows.columns.index(ids)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            raw, bounds = memoryview(np.ascontiguousarray(col.values.to_numpy(zero_copy_only=False), "<i4")).cast("B"), 4 * col.offsets.to_numpy()
            crc = np.fromiter((zlib.crc32(raw[s:e]) for s, e in zip(bounds[:-1], bounds[1:])), np.int64, batch.num_rows)
            arrays = [*batch.columns]
            arrays[at] = pa.array(crc)
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:at], "ids_crc32", *batch.schema.names[at + 1 :]])

    schema = ", ".join("ids_crc32 long" if f.name == ids else f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(digest, schema)


def token_index(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads from them doc_id, start, n_tokens and ids_crc32."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return id_digests(read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", "ids"))
