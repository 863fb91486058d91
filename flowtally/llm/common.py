"""What the operators share: stored intermediates, batches of texts, links and components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtally.sources.shared import discard, stored as store, work_path as new_path

WORD = r"[^\x20\x09-\x0D]+"
TEXT_BYTES = 4 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Pieces of a batch whose texts stay near 4 MB (one longer text is a piece of its own); null texts become ''."""
    import pyarrow.compute as pc

    col = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), TEXT_BYTES, "right")))
        yield batch.slice(start, end - start), [t or "" for t in col.slice(start, end - start).to_pylist()]
        start = end


# Links within lists of rows that share a key -----------------------------------------


def blocked(rows: DataFrame, key: str, node: str, limit: int) -> DataFrame:
    """Deals rows that share ``key`` with another row into runs of at most about 2 * ``limit`` rows.

    A key with more than ``limit`` rows is cut into blocks by the hash of ``node``; each
    pair of its blocks is a run (``key``, ``ba``, ``bb``), so every pair of rows meets in
    a run and no task holds a whole hot key.  ``blk`` is the row's own block.
    """
    many = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_r"))
    return (
        rows.join(many, key)
        .withColumn("blk", F.pmod(F.xxhash64(node), F.col("_r")).cast("int"))
        .withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)))
        .withColumn("ba", F.least("blk", "_o"))
        .withColumn("bb", F.greatest("blk", "_o"))
        .drop("_r", "_o")
        .repartition(key, "ba", "bb")
        .sortWithinPartitions(key, "ba", "bb")
    )


def whole_runs(batches: Iterable[pa.RecordBatch], columns: tuple[str, ...], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows (but for the last) that end where a run of equal ``columns`` ends."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(count - 1, bool)
        for c in columns:
            v = table[c].to_numpy()
            change |= v[1:] != v[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            end = int(cut[-1]) + 1
            yield table.slice(0, end)
            rest = table.slice(end)
            held, count = rest.to_batches(), rest.num_rows
    if count:
        yield pa.Table.from_batches(held)


def run_numbers(table: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """The number of each row's run within the table."""
    change = np.zeros(table.num_rows, bool)
    for c in columns:
        v = table[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.cumsum(change)


def run_pairs(run: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the same run as index arrays (i < j), in pieces of at most ``most`` pairs."""
    at, lag = np.arange(len(run)), 1
    while True:
        at = at[at + lag < len(run)]
        at = at[run[at] == run[at + lag]]
        if not len(at):
            return
        for s in range(0, len(at), most):
            yield at[s : s + most], at[s : s + most] + lag
        lag += 1


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the groups of rows i and j; a group is labelled with its smallest row."""
    while True:
        a, b = labels[i], labels[j]
        differ = a != b
        if not differ.any():
            return labels
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nxt := labels[labels], labels):
            labels = nxt


# Components ---------------------------------------------------------------------------


def _follow(df: DataFrame, column: str, hops: DataFrame) -> DataFrame:
    """Replaces ``column`` by where ``hops`` (node, to) sends it."""
    to = hops.select(F.col("node").alias("_node"), F.col("to").alias("_to"))
    return df.join(to, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_to", column)).drop("_node", "_to")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the smallest node it is joined to.

    Each round hooks every node to its smallest neighbour, shortens the paths twice and
    rewrites the links between what remains; the links left at least halve on stars and
    fall fast on chains.  Rounds are stored, so a lost executor costs one round at most.
    """
    tidy = lambda df: df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    given = left = store(tidy(links), "links")
    nodes = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = hops = store(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("node"), "to"), "hops")
        for _ in range(2):
            hops = _follow(hops, "to", hops)
        hops = store(hops, "hops")
        rounds.append(hops)
        before, left = left, store(tidy(_follow(_follow(left, "a", hops), "b", hops)), "links")
        discard(first, *([before] if before is not given else []))
    labels = nodes.withColumn("root", F.col("node"))
    for hops in rounds:
        labels = _follow(labels, "root", hops)
    out = store(labels, "labels")
    discard(given, left, *rounds)
    return out


def with_row_ids(df: DataFrame, name: str, extra: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, str]:
    """``df`` with a long number for each row, stored so that the number stays; and the column's name."""
    (rid,) = fresh(df, "_row")
    out = df.withColumn(rid, F.monotonically_increasing_id())
    return store(extra(out) if extra else out, name), rid


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; FLOWTALLY_TOKENIZERS names another folder."""
    folder = os.environ.get("FLOWTALLY_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
