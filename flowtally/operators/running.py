"""Running values over an order, for groups of which one may hold most rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.sources.shared import stored

KINDS = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def with_group(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the columns of their group, one row per key; unknown keys meet, and without a key all rows meet the one group."""
    if not key:
        return rows.join(F.broadcast(groups))
    named = groups.withColumnsRenamed({c: f"_of_{c}" for c in key})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in key])
    return rows.join(named, same).drop(*[f"_of_{c}" for c in key])


SPREAD = 64


def join_spread(rows: DataFrame, few: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """Inner join of ``rows`` with ``few`` rows per key, where one key may hold most rows: each key is dealt to ``SPREAD`` parts by ``by``."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int"))
    copies = few.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return dealt.join(copies, [*key, "_deal"]).drop("_deal")


def running(rows: DataFrame, key: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]], totals: bool = False) -> DataFrame:
    """Adds the value of each {name: (kind, column)} over the rows of the key up to and including each row.

    kind is sum, max or last (known).  With ``totals`` the value over the whole key is
    added as <name>_all.  ``order`` must tell the rows of a key apart.

    Rows are cut into ranges of (key, order), run within their range and stored; each
    range is one row of a small table that carries the values on to the next.  So a key
    is spread over as many tasks as its rows fill, and unknown keys are a key.
    """
    cut = rows.withColumns({f"_run_{n}": c for n, (_, c) in values.items()}).repartitionByRange(*key, *order).withColumn("_run_part", F.spark_partition_id())
    within = Window.partitionBy("_run_part", *key).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    own = {n: KINDS[kind](f"_run_{n}").over(upto) for n, (kind, _) in values.items()}
    local = stored(cut.select(*rows.columns, "_run_part", F.row_number().over(within).alias("_run_at"), *[c.alias(f"_own_{n}") for n, c in own.items()]), "running")
    ends = local.groupBy("_run_part", *key).agg(*[F.max_by(f"_own_{n}", "_run_at").alias(n) for n in values])
    ranges = Window.partitionBy(*key).orderBy("_run_part")
    before = [KINDS[kind](n).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before_{n}") for n, (kind, _) in values.items()]
    whole = [KINDS[kind](n).over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"{n}_all") for n, (kind, _) in values.items()] if totals else []
    carried = ends.select("_run_part", *key, *before, *whole)
    mine, theirs = (lambda n: F.col(f"_own_{n}")), (lambda n: F.col(f"_before_{n}"))
    joined = {
        "sum": lambda n: F.coalesce(mine(n) + theirs(n), mine(n), theirs(n)),
        "max": lambda n: F.when(theirs(n).isNull() | (mine(n) > theirs(n)), mine(n)).otherwise(theirs(n)),
        "last": lambda n: F.coalesce(mine(n), theirs(n)),
    }
    return with_group(local, carried, ["_run_part", *key]).select(*rows.columns, *[joined[kind](n).alias(n) for n, (kind, _) in values.items()], *([f"{n}_all" for n in values] if totals else []))
