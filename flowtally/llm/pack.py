"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows of ``capacity`` (2048) and a rest, and the
rest into pieces of near-equal length of at most ``piece`` (512).  Full windows stand
alone.  Rests are dealt by hash into groups of about ``group_tokens`` ids; in a group of k = ceil(ids /
capacity) windows each piece starts as a partial partition of k sums, and the two
partial partitions with the largest spread are merged over and over, the largest sums of
one onto the smallest of the other, until one is left.  If a window exceeds the capacity,
the count of windows rises by one and the group is partitioned again.

Encoding streams through the scan and keeps only the spans and their checksums; spans
are stored, so groups can be sized from all of them and encoding runs once.  A group is
bounded by its size, not by any key.

Cases: a null or empty text is its end id alone; a very long text is many full windows;
repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtally.llm.common import slices, store
from flowtally.llm.token_files import with_end
from flowtally.llm.tokens import encoder

CAPACITY, PIECE, END_ID, GROUP_TOKENS = 2048, 512, 1, 1 << 18


def cut_points(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Starts of the pieces of a document of n ids, and n."""
    full = n - n % capacity
    rest = n - full
    k = -(-rest // piece)
    return [*range(0, full, capacity), *(full + rest * i // k for i in range(k)), n]


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 .. k-1) of each piece by Karmarkar-Karp differencing over k-way partial partitions."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    # A node is a piece (below n) or the union of two nodes.  A state lists the sums that
    # hold a node in ascending order, as (sum, node); sums without a node are 0 and left
    # out.  Once all k sums hold a node they count from the smallest.
    unions: list[tuple[int, int]] = []
    heap = [(-int(size), i, [(int(size), i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for last in range(n, 2 * n - 1):
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        # The largest sums of one meet the smallest of the other: without enough free sums
        # the m smallest of both meet, crosswise.
        m = max(0, len(a) + len(b) - k)
        merged = a[m:] + b[m:]
        for (x, i), (y, j) in zip(a[:m], reversed(b[:m])):
            merged.append((x + y, n + len(unions)))
            unions.append((i, j))
        merged.sort()
        base = merged[0][0] if len(merged) == k else 0
        if base:
            merged = [(x - base, i) for x, i in merged]
        heapq.heappush(heap, (-merged[-1][0], last, merged))
    window = np.zeros(n, np.int64)
    waiting = [(node, w) for w, (_, node) in enumerate(heap[0][2])]
    while waiting:
        node, w = waiting.pop()
        if node < n:
            window[node] = w
        else:
            waiting += [(x, w) for x in unions[node - n]]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Near-equal windows within ``capacity``; their count rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, k)
        if np.bincount(found, sizes, k).max() <= capacity:
            return found
        k += 1


def spans(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, end_id: int = END_ID) -> DataFrame:
    """The pieces of every encoded text: doc_id, start, length, ids_crc32, doc_tokens, and the ids if asked for."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary, True)
        for batch in batches:
            for part, texts in slices(batch, 1):
                ids, bounds = with_end(*coder.encode(texts), end_id)
                row, start, length, total, crc = [], [], [], [], []
                raw = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
                for k, (s, e) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    cuts = cut_points(e - s)
                    for p, q in zip(cuts, cuts[1:]):
                        row.append(k)
                        start.append(p)
                        length.append(q - p)
                        total.append(e - s)
                        crc.append(zlib.crc32(raw[4 * (s + p) : 4 * (s + q)]))
                arrays = [part.column(0).take(pa.array(row)), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(doc_id, text).mapInArrow(encode, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (column length)."""
    columns, fields = pieces.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    rows = pieces.withColumn("_row", F.monotonically_increasing_id())
    total = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    full = rows.where(F.col("length") == capacity).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = rows.where(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row", kind="stable").reset_index(drop=True)
        window = windows(part["length"].to_numpy(np.int64), capacity)
        part["sequence_id"] = part["_group"] * (1 << 32) + window
        part = part.iloc[np.argsort(window, kind="stable")]
        part["offset"] = part.groupby("sequence_id")["length"].cumsum() - part["length"]
        return part[[*columns, "sequence_id", "offset"]]

    return full.unionByName(rest.groupBy("_group").applyInPandas(deal, f"{fields}, sequence_id long, offset long"))


def packed(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    return pack(store(spans(docs, vocabulary, doc_id, text), "spans"))


def sequences(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed windows themselves: sequence_id and its ids, piece after piece."""
    rows = pack(store(spans(docs, vocabulary, doc_id, text, with_ids=True), "spans"))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
