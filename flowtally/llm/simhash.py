"""SimHash near-duplicates: byte-position inverted index with count filtering.

Method: two 64-bit fingerprints that differ in at most ``bits`` (4) bits share at least
8 - 4 = 4 of their 8 bytes in place.  An inverted index on single positional bytes has
2,048 lists and would touch n^2 / 32 pairs, so its lists are intersected ahead: 20 sets
of three positions are chosen such that any four positions hold one of them (split the
positions 3 + 3 + 2 into A, B, C and take the sets inside a part, two of A with one of B,
two of B with one of C, two of C with one of A).  Every pair with four shared bytes thus
meets in a list.  There its shared positional bytes are tallied, pairs with fewer than
the guaranteed minimum are dropped, and the rest is verified bit by bit.  Lists longer
than ``block`` are cut into block pairs; a task sends on a forest of its links, never
all pairs.

Cases: null and blank texts have fingerprint zero and link like any other; fewer words
than a shingle: the whole sequence is the one shingle; repeated rows and equal texts
share a fingerprint, which enters the index once; an empty table gives an empty result;
a null doc_id never becomes a component id unless its whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from flowtally.llm.common import blocked, components, fresh, join_labels, run_numbers, run_pairs, slices, store, whole_runs, with_row_ids

SHINGLE, SEED, BITS, BLOCK = 4, 42, 4, 1024


def position_sets() -> list[tuple[int, ...]]:
    """20 triples of byte positions such that every four positions hold one."""
    a, b, c = (0, 1, 2), (3, 4, 5), (6, 7)
    out = [a, b]
    for two, one in ((a, b), (b, c), (c, a)):
        out += [(*pair, x) for pair in combinations(two, 2) for x in one]
    return [tuple(sorted(x)) for x in out]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = text.encode().lower().split()
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    digest, stops = xxhash.xxh64_intdigest, (ends[shingle - 1 :] - 1).tolist()
    h = np.array([digest(norm[s:e], SEED) for s, e in zip(starts, stops)], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        set_bits += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str, name: str, shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint of each whole text as a signed long column ``name``."""
    at = docs.columns.index(text)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, at):
                found = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*part.schema.names, name])

    return docs.mapInArrow(add, docs.withColumn(name, F.lit(0).cast("long")).schema)


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all those within ``bits`` bits of each other.

    Within a task, linked fingerprints are joined to the smallest of their group, so the
    rows out stay below the rows in; the components are those of all links.
    """
    if not 0 <= bits <= 4:
        raise ValueError("the index guarantees whole results up to 4 differing bits")
    byte = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(255)
    key = lambda n, s: sum((F.shiftleft(byte(p), 8 * k) for k, p in enumerate(s)), F.lit(n << 24).cast("long"))
    keys = prints.select("fp", F.explode(F.array(*[key(n, s) for n, s in enumerate(position_sets())])).alias("key"))
    shared = 8 - bits

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("key", "ba", "bb")):
            fp = table["fp"].to_numpy().view(np.uint64)
            run, labels = run_numbers(table, ("key", "ba", "bb")), np.arange(len(fp))
            for i, j in run_pairs(run, 1 << 18):
                other = fp[i] ^ fp[j]
                enough = np.flatnonzero((other.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= shared)
                near = enough[np.bitwise_count(other[enough]) <= bits]
                if len(near):
                    labels = join_labels(labels, i[near], j[near])
            moved = np.flatnonzero(labels != np.arange(len(fp)))
            if len(moved):
                signed = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[labels[moved]]), pa.array(signed[moved])], names=["a", "b"])

    return blocked(keys, "key", "fp", block).select("fp", "key", "ba", "bb").mapInArrow(verify, "a long, b long")


def groups(rows: DataFrame, fp: str, doc_id: str) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint; component_id is the smallest doc_id reachable by links."""
    prints = store(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "prints")
    roots = components(links(prints.select("fp")))
    rooted = store(prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    # Both sides start from files: a large group is then an ordinary skewed join, which Spark splits.
    least = store(rooted.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id")), "least")
    return store(rooted.join(least, F.col("root") == F.col("_root")).select("fp", "component_id"), "groups")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = store(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp", shingle).select("doc_id", "fp"), "fingerprints")
    found = groups(rows, "fp", "doc_id").withColumnRenamed("fp", "_fp")
    return rows.join(found, F.col("fp") == F.col("_fp")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id stays, one row if it repeats."""
    fp, keep_id = fresh(docs, "_fp", "_keep")
    rows, rid = with_row_ids(docs, "docs", lambda d: with_fingerprints(d, text, fp))
    narrow = rows.select(F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp"))
    found = groups(narrow, "fp", "doc_id").withColumnRenamed("fp", "_f")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    # Of each fingerprint first (many rows may share one), then of each group.
    best = narrow.groupBy("fp").agg(first.alias("best"))
    roots = best.join(found, F.col("fp") == F.col("_f")).groupBy(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone"))
    keep = roots.agg(F.min("best").alias("best")).select(F.col("best.rid").alias(keep_id))
    return rows.join(keep, F.col(rid) == F.col(keep_id), "left_semi").select(*docs.columns)
