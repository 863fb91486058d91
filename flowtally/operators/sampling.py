"""Splits, samples, balance and scaling.

Random order is the md5 of a seed and the row's key: portable, repeatable and the same
whatever the partitioning.  Ranks run per experiment, split or class, in ranges of the
order, so that a class of most rows is numbered by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.functions.unknown import seeded_order
from flowtally.operators.running import running


def sample_splits(rows: DataFrame, fractions: dict[str, float], sample: float, key: list[str], seed: int = 1) -> DataFrame:
    """Disjoint samples: of each experiment floor(n * fraction * sample) rows per split, in split order; adds split and shuffle_key."""
    ranked = running(rows.withColumn("shuffle_key", seeded_order(seed, *key)), ["exp_id"], ["shuffle_key", *key], {"_rn": ("sum", F.lit(1))}, totals=True)
    split, upto = None, F.lit(0)
    for name, fraction in fractions.items():
        upto = upto + F.floor(F.col("_rn_all") * F.lit(float(fraction * sample)))
        test = F.col("_rn") <= upto
        split = F.when(test, name) if split is None else split.when(test, name)
    return ranked.withColumn("split", split).where("split is not null").drop("_rn", "_rn_all")


def disjoint_splits(experiments: DataFrame, fractions: dict[str, float], seed: int = 1) -> DataFrame:
    """Splits whole experiments: ceil counts for test, then val; the rest trains."""
    n = experiments.count()
    rank = F.row_number().over(Window.orderBy(seeded_order(seed, "exp_id"), "exp_id"))
    test = -int(-n * fractions.get("test", 0) // 1)
    val = -int(-n * fractions.get("val", 0) // 1)
    return experiments.withColumn("_rn", rank).withColumn("split", F.when(F.col("_rn") <= test, "test").when(F.col("_rn") <= test + val, "val").otherwise("train")).drop("_rn")


def pick_experiments(experiments: DataFrame, n: int, seed: int = 1) -> DataFrame:
    return experiments.orderBy(seeded_order(seed, "exp_id"), "exp_id").limit(n)


def subsplit_fraction(rows: DataFrame, fraction: float, order: list[str]) -> DataFrame:
    """The first ceil(n * fraction) rows of each subsplit; names with "high-fair-rate" get 1.25 times the fraction, at most all."""
    share = F.when(F.contains(F.col("subsplit"), F.lit("high-fair-rate")), F.lit(min(1.0, fraction * 1.25))).otherwise(F.lit(float(fraction)))
    ranked = running(rows, ["subsplit"], order, {"_rn": ("sum", F.lit(1))}, totals=True)
    return ranked.where(F.col("_rn") <= F.ceil(F.col("_rn_all") * share)).drop("_rn", "_rn_all")


def draw_with_replacement(rows: DataFrame, by: str, draws: Column, key: list[str], seed: int = 1) -> DataFrame:
    """Draws rows of each group uniformly with replacement; ``draws`` is a count in terms of n, the group's rows.

    Draw d of a group takes the row numbered by the hash of (seed, group, d), an equi-join
    on (group, number), so draws of a hot group spread over all its numbers.
    """
    numbered = running(rows.withColumn("_seeded", seeded_order(seed, *key)), [by], ["_seeded", *key], {"_upto": ("sum", F.lit(1))}).withColumn("_no", F.col("_upto") - 1)
    wanted = rows.groupBy(F.col(by).alias("_g")).agg(F.count(F.lit(1)).alias("n")).withColumn("_draw", F.explode(F.when(draws > 0, F.sequence(F.lit(1), draws.cast("long"))).otherwise(F.array().cast("array<bigint>"))))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("_g").cast("string"), F.col("_draw").cast("string"))), 1, 12), 16, 10).cast("long"), F.col("n"))
    chosen = wanted.select("_g", pick.alias("_pick"))
    return chosen.join(numbered, F.col("_g").eqNullSafe(F.col(by)) & (F.col("_pick") == F.col("_no"))).select(*rows.columns)


def random_percent(rows: DataFrame, percent: float, key: list[str], seed: int = 1) -> DataFrame:
    """ceil(n * percent / 100) rows of each experiment, with replacement."""
    return draw_with_replacement(rows, "exp_id", F.ceil(F.col("n") * F.lit(percent / 100)), key, seed)


def balance(rows: DataFrame, label: str, key: list[str], mode: str = "drop", seed: int = 1) -> DataFrame:
    """Equal class counts: "drop" to the rarest class, or "add" draws with replacement up to the commonest."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    target = counts.agg(F.min("_n").alias("lo"), F.max("_n").alias("hi")).first()
    if mode == "drop":
        ranked = running(rows.withColumn("_seeded", seeded_order(seed, *key)), [label], ["_seeded", *key], {"_rn": ("sum", F.lit(1))})
        return ranked.where(F.col("_rn") <= (target.lo or 0)).drop("_rn", "_seeded")
    return rows.unionByName(draw_with_replacement(rows, label, F.lit(target.hi or 0) - F.col("n"), key, seed))


def fit_scale(rows: DataFrame, columns: list[str], standardize: bool = True, groups: list[list[str]] | None = None) -> DataFrame:
    """Two numbers per column: mean and population deviation, or minimum and maximum, shared within a group; no spread gives 0."""
    groups = groups or [[c] for c in columns]
    parts = rows.agg(*[x for c in columns for x in (F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))])
    out = []
    for group in groups:
        total = lambda p, g=group: sum((F.coalesce(F.col(f"{p}_{c}"), F.lit(0)) for c in g), F.lit(0))
        n = F.nullif(total("n"), F.lit(0))
        mean = total("s") / n
        pair = (mean, F.sqrt(F.greatest(total("q") / n - mean * mean, F.lit(0.0)))) if standardize else tuple((f(*[F.col(f"{p}_{c}") for c in [*group, group[0]]])) for f, p in ((F.least, "lo"), (F.greatest, "hi")))
        out += [F.struct(F.lit(c).alias("feature"), pair[0].alias("p1"), pair[1].alias("p2")) for c in group]
    return parts.select(F.explode(F.array(*out)).alias("_s")).select("_s.*")


def apply_scale(rows: DataFrame, params: dict[str, tuple[float, float]], standardize: bool = True, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(x - mean) / deviation, or linear to [low, high]; columns without spread become 0 or ``low``."""
    out = {}
    for c, (a, b) in params.items():
        if standardize:
            out[c] = (F.col(c) - a) / b if b else F.when(F.col(c).isNotNull(), 0.0)
        else:
            out[c] = (F.col(c) - a) / (b - a) * (high - low) + low if b != a else F.when(F.col(c).isNotNull(), low)
    return rows.withColumns(out)
