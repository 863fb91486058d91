"""Embedding near-duplicates by collision-counting projections.

Vectors are projected on many random unit directions.  The difference of two vectors
with the least cosine asked for is about normal in each projection, with a known spread,
so a window of ``WIDTH`` spreads around a query holds its partner in a known share of
the projections.  A pair is verified in double precision only if it collides in at least
``least_count`` of ``COUNTED`` projections, the count that a pair at the threshold misses
with a chance below ``MISS``; counting stops early, every ``STEP`` projections, for pairs
below the count that so many projections ask for.

One sorted projection holds a third of all vectors in a window, so counting over single
projections would touch every pair.  The sorted order is therefore taken over ``K``
projections at once: each of ``TABLES`` tables sorts the vectors by the cells that K
shifted projections put them in, and pairs are counted where they share a cell.  A pair
at the threshold shares none of the 28 cells with a chance of about 2 in 10,000, closer
pairs with less; of unrelated pairs about one in 50 meets.  Cells with more than ``BLOCK`` vectors are cut into block pairs.

Equal vectors are one node.  A pair is counted in the first table in which it meets, so
links are counted once; tasks send on counts and a forest of links, never pairs.

Cases: vectors that are null, empty or zero or hold null or non-finite components, and
vectors of rows without an id, link with nothing; vectors of different lengths do not
link; of rows that repeat an id each is a vector of its own; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtally.llm.common import blocked, components, join_labels, run_numbers, run_pairs, store, whole_runs

COSINE, TABLES, K, COUNTED, CELL, WIDTH, MISS, BLOCK, SEED = 0.95, 28, 12, 128, 7.6, 2.0, 1e-5, 512, 5


STEP = 8


@cache
def least_count(projections: int, width: float = WIDTH, miss: float = MISS) -> int:
    """The largest count that a pair at the threshold falls short of with a chance below ``miss``."""
    from statistics import NormalDist

    p, below = 2 * NormalDist().cdf(width) - 1, 0.0
    for c in range(projections + 1):
        below += np.exp(lgamma(projections + 1) - lgamma(c + 1) - lgamma(projections - c + 1) + c * log(p) + (projections - c) * log(1 - p))
        if below > miss:
            return c
    return projections


@cache
def directions(d: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """TABLES * K random unit directions for vectors of length d, and a shift for each."""
    rng = np.random.default_rng((seed, d))
    r = rng.standard_normal((d, TABLES * K))
    return r / np.linalg.norm(r, axis=0), rng.random(TABLES * K)


def spread(cosine: float, d: int) -> float:
    """Standard deviation of a projected difference of two unit vectors at a cosine."""
    return sqrt((2 - 2 * cosine) / d)


def units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to the longest, and their lengths in components."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[column.offsets[0].as_py() :]
    x = np.zeros((len(lengths), int(lengths.max(initial=1))))
    x[np.arange(x.shape[1]) < lengths[:, None]] = flat[: int(lengths.sum())]
    peak = np.abs(x).max(1, keepdims=True)
    x = x / np.where(peak > 0, peak, 1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300), lengths


def cells(x: np.ndarray, d: int, cosine: float) -> np.ndarray:
    """The cell number (32 bits) of each vector in each table."""
    r, shift = directions(d)
    at = np.floor(x[:, :d] @ r / (CELL * spread(cosine, d)) + shift).astype(np.int64).reshape(len(x), TABLES, K)
    h = np.full(at.shape[:2], d, np.uint64)
    for k in range(K):
        h = (h ^ at[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(33)).astype(np.int32)


def colliding(points: np.ndarray, i: np.ndarray, j: np.ndarray, window: float) -> np.ndarray:
    """Places of the pairs (i, j) with enough collisions; ``points`` is one row per projection."""
    at, count = np.arange(len(i)), np.zeros(len(i), np.int16)
    for k in range(len(points)):
        count += np.abs(points[k][i] - points[k][j]) <= window
        if (k + 1) % STEP == 0 or k + 1 == len(points):
            keep = np.flatnonzero(count >= least_count(k + 1))
            at, count, i, j = at[keep], count[keep], i[keep], j[keep]
    return at


def near_links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """For distinct vectors (rep, copies, embedding): rows (a, b, links) with b the smallest of a's group in a task and links the copies linked to a there."""

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, lengths = units(batch.column("embedding"))
            out = np.zeros((len(x), TABLES), np.int32)
            for d in np.unique(lengths):
                rows = lengths == d
                out[rows] = cells(x[rows], int(d), cosine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = store(vectors.select("rep", "copies", "embedding").mapInArrow(place, f"rep long, copies long, embedding {kind}, cells array<int>"), "cells")
    rows = placed.select("rep", "copies", "embedding", "cells", F.posexplode("cells").alias("t", "cell")).withColumn("key", F.shiftleft(F.col("t").cast("long"), 32) + F.col("cell")).drop("cell")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, ("key", "ba", "bb"), 8192):
            table = table.combine_chunks()
            x, lengths = units(table["embedding"].combine_chunks())
            rep, copies, t = (table[c].to_numpy() for c in ("rep", "copies", "t"))
            side, cross = table["blk"].to_numpy(), table["ba"].to_numpy() != table["bb"].to_numpy()
            cell = table["cells"].combine_chunks().flatten().to_numpy().reshape(len(rep), TABLES)
            run, links, labels = run_numbers(table, ("key", "ba", "bb")), np.zeros(len(rep), np.int64), np.arange(len(rep))
            ranks = np.argsort(np.argsort(rep, kind="stable"), kind="stable")
            place_of = np.argsort(ranks)
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                points, window = np.ascontiguousarray((x[own][:, :d] @ directions(int(d))[0][:, :COUNTED]).T.astype(np.float32)), WIDTH * spread(cosine, int(d))
                for i, j in run_pairs(run[own], 1 << 16):
                    i0, j0 = own[i], own[j]
                    # Of a cut cell, blocks meet once: within a block in its own run, across in the pair's.
                    meet = np.flatnonzero(~cross[i0] | (side[i0] != side[j0]))
                    i, j, i0, j0 = i[meet], j[meet], i0[meet], j0[meet]
                    many = colliding(points, i, j, window)
                    i0, j0 = i0[many], j0[many]
                    close = np.einsum("ij,ij->i", x[i0], x[j0]) >= cosine
                    i0, j0 = i0[close], j0[close]
                    if not len(i0):
                        continue
                    labels[:] = join_labels(labels, ranks[i0], ranks[j0])
                    first = (cell[i0] == cell[j0]).argmax(1) == t[i0]
                    np.add.at(links, i0[first], copies[j0[first]])
                    np.add.at(links, j0[first], copies[i0[first]])
            root = rep[place_of[labels[ranks]]]
            some = np.flatnonzero((links > 0) | (root != rep))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(root[some]), pa.array(links[some])], names=["a", "b", "links"])

    return blocked(rows, "key", "rep", block).mapInArrow(count, "a long, b long, links long")


def valid(embedding: str):
    """True for vectors that can link."""
    sound = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) > 0) & sound & F.exists(embedding, lambda v: v != 0), F.lit(False))


def near_duplicates(embeddings: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")).withColumn("ok", valid("embedding") & F.col("vec_id").isNotNull())
    good = rows.where("ok").select("vec_id", "embedding")
    reps = store(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    found = store(near_links(reps, cosine), "found")
    # A rep has the smallest id of its copies, so components of reps are those of all vectors.
    roots = components(found.select("a", "b"))
    links = found.groupBy(F.col("a").alias("_rep")).agg(F.sum("links").alias("links"))
    per_vector = reps.join(links, F.col("rep") == F.col("_rep"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    per_vector = per_vector.select("embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    counted = good.join(per_vector, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return counted.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
