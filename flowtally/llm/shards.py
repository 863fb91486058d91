"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each key gets a score from every shard, -weight / ln(u) with u in (0, 1) hashed from the
key and the shard's number alone, and goes to the highest.  A shard more takes rows only
into itself, a shard less gives away only its own, and shares follow the weights.  All
of it is arithmetic on columns; the text never moves.

Slots (gapless from 0 within a shard) come from two levels: the key's hash deals each
shard's rows into bins, bins are counted from the key column alone, and a row's slot is
the rows of the bins before plus its place in its bin.  The number of bins follows the
number of rows, so no task holds a shard.

Cases: a null key is hashed as a key of its own; equal keys land in one shard and still
get slots of their own (they are spread over bins by the text's checksum); a null text
has size 1 and the checksum of the empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_BIN = 2000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 ..) with the highest weighted score for a key; ties go to the lowest number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("less"))

    best = F.array_max(F.array(*[score(k, w) for k, w in enumerate(weights)]))
    return (-best["less"]).cast("int")


def shard_rows(docs: DataFrame, weights: Sequence[float] = (1.0,) * 8, grown: Sequence[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown``: the weights after growth (default: one more shard of the mean weight).
    """
    grown = list(grown or [*weights, sum(weights) / len(weights)])
    n = docs.count()  # from the files' footers
    bins = max(64, -(-n // (ROWS_PER_BIN * len(weights))))
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.crc32(whole), F.lit("bin")), F.lit(bins)).cast("int").alias("bin"),
    )
    counts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumn("place", place)
        .join(before, ["shard", "bin"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("place") - 1).cast("long").alias("slot"), "grown_shard")
    )
