"""Distributions, groupings and paired comparisons of per-experiment or per-packet values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.operators.running import running, with_group

# The percentile lists of the two reports.
PERCENTILES = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.999]
LENGTH_PERCENTILES = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 1.0]

BINS = 4096


def percentiles(rows: DataFrame, value: str, by: list[str] = [], points: list[float] = PERCENTILES, approximate: bool = False) -> DataFrame:
    """Long form (by, p, value) with linear interpolation; ``approximate`` takes a sketch's values instead.

    Counts over ``BINS`` equal parts of each group's range tell in which parts the ranks
    asked for lie; only values of those parts are counted one by one and numbered.  So a
    group of any size is exact without a buffer of its values, and rows are not shuffled.
    Unknown values do not count, a group without values gives no row; NaN is above all.
    """
    at = F.array(*map(F.lit, points))
    if approximate:
        got = rows.groupBy(*by).agg(F.percentile_approx(value, at).alias("_v"))
        return got.select(*by, F.posexplode("_v").alias("_k", "value")).withColumn("p", F.get(at, F.col("_k"))).select(*by, "p", "value")
    x = F.col("_x")
    seen = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    finite = F.when(F.abs(x) < float("inf"), x)
    span = seen.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(F.lit(1)).alias("_all"))
    # Halves, so that the range of the largest doubles stays finite.
    part = F.floor((x / 2 - F.col("_lo") / 2) / F.nullif(F.col("_hi") / 2 - F.col("_lo") / 2, F.lit(0.0)) * BINS)
    bin_ = F.when(x == float("-inf"), 0).when(finite.isNull(), BINS - 1).otherwise(F.coalesce(F.least(part, F.lit(BINS - 1)), F.lit(0))).cast("int")
    placed = with_group(seen, span, by).select(*by, "_x", "_all", bin_.alias("_bin"))
    w = Window.partitionBy(*by).orderBy("_bin")
    bins = placed.groupBy(*by, "_all", "_bin").agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    # A value or bin covers the ranks _upto - _n to _upto - 1; a point lies between two ranks.
    place = lambda p: p * (F.col("_all") - 1)
    covers = lambda rank: (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    near = lambda p: covers(F.floor(place(p))) | covers(F.ceil(place(p)))
    chosen = bins.where(F.exists(at, near)).select(*by, "_bin", (F.col("_upto") - F.sum("_n").over(w)).alias("_skipped"))
    counts = with_group(placed, chosen, [*by, "_bin"]).groupBy(*by, "_x", "_all", "_skipped").agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, by, ["_x"], {"_within": ("sum", F.col("_n"))}).withColumn("_upto", F.col("_within") + F.col("_skipped"))
    met = ranked.withColumn("p", F.explode(F.filter(at, near)))
    low, high = F.max(F.when(covers(F.floor(place(F.col("p")))), x)), F.max(F.when(covers(F.ceil(place(F.col("p")))), x))
    share = F.max(place(F.col("p")) - F.floor(place(F.col("p"))))
    return met.groupBy(*by, "p").agg(F.when(share > 0, (1 - share) * low + share * high).otherwise(low).alias("value"))


def cdf(rows: DataFrame, value: str, by: list[str] = []) -> DataFrame:
    """Share of values up to and including each distinct value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, by, [value], {"_upto": ("sum", F.col("n"))}, totals=True).select(*by, value, (F.col("_upto") / F.col("_upto_all")).alias("cdf"))


def binned_cdf(rows: DataFrame, value: str, bins: int = 1000) -> DataFrame:
    """CDF over ``bins`` equal-width bins: (bin, upper, cdf), however many they are."""
    return running(histogram(rows, value, bins), [], ["bin"], {"_upto": ("sum", F.col("n"))}, totals=True).select("bin", "upper", (F.col("_upto") / F.col("_upto_all")).alias("cdf"))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width density histogram: bin, lower, upper, n, density; the last bin is closed above."""
    span = rows.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = rows.where(F.col(value).isNotNull()).join(F.broadcast(span)).groupBy(bin_.alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.col("_lo") + F.col("bin") * width).alias("lower"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"), "n", (F.col("n") / (F.col("_n") * F.nullif(width, F.lit(0.0)))).alias("density"))


def group_by_parameter(rows: DataFrame, parameter: str, value: str, most: int = 10) -> DataFrame:
    """Count, mean and median of a value per parameter; more than ``most`` parameters fall into ``most`` equal-width buckets, the last closed above."""
    span = rows.agg(F.min(parameter).cast("double").alias("_lo"), F.max(parameter).cast("double").alias("_hi"), F.countDistinct(parameter).alias("_k"))
    width = (F.col("_hi") - F.col("_lo")) / most
    bucket = F.col("_lo") + F.least(F.floor((F.col(parameter) - F.col("_lo")) / width), F.lit(most - 1)) * width
    key = F.when(F.col("_k") > most, bucket).otherwise(F.col(parameter).cast("double"))
    return rows.join(F.broadcast(span)).groupBy(key.alias("category")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def summary_stats(rows: DataFrame, columns: list[str], by: list[str] = []) -> DataFrame:
    """Mean, population standard deviation and variance of columns, long form."""
    long = rows.unpivot(by, columns, "metric", "value")
    return long.groupBy(*by, "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("var"))


def paired_deltas(pairs: DataFrame, metric: str) -> DataFrame:
    """Adds <metric>_delta (on - off) and <metric>_pct (in percent of off) to rows with <metric>_off and <metric>_on."""
    off, on = F.col(f"{metric}_off"), F.col(f"{metric}_on")
    return pairs.withColumns({f"{metric}_delta": on - off, f"{metric}_pct": (on - off) / F.nullif(off, F.lit(0.0)) * 100})


def expected_class_share(flows: DataFrame, first_class: Column) -> DataFrame:
    """Share of an experiment's flows that are of the first class, in percent."""
    return flows.groupBy("exp_id").agg((F.sum(first_class.cast("int")) * 100.0 / F.count(F.lit(1))).alias("expected_pct"))


def cca_pair_summary(experiments: DataFrame) -> DataFrame:
    """Mean Jain's index off, on and change per pair of congestion controls; dctcp is left out."""
    rows = experiments.where((F.col("cca_1") != "dctcp") & (F.col("cca_2") != "dctcp"))
    return rows.groupBy("cca_1", "cca_2").agg(F.avg("jain_off").alias("jain_off"), F.avg("jain_on").alias("jain_on"), F.avg(F.col("jain_on") - F.col("jain_off")).alias("change"), F.count(F.lit(1)).alias("n"))


def pooled_cdfs(experiments: DataFrame, metrics: list[str]) -> DataFrame:
    """CDF of each metric over all pairs but those with dctcp: metric, value, cdf."""
    rows = experiments.where((F.col("cca_1") != "dctcp") & (F.col("cca_2") != "dctcp"))
    return cdf(rows.unpivot([], metrics, "metric", "value"), "value", ["metric"])


def class_deltas(utilisation: DataFrame, by: list[str], classes: list[str]) -> DataFrame:
    """Utilisation per class (flow_class) without and with the mechanism (enabled) side by side, with delta and percent of each class."""
    names = F.concat("flow_class", F.when(F.col("enabled"), "_on").otherwise("_off"))
    wide = utilisation.where(F.col("flow_class").isin(classes)).withColumn("_side", names).groupBy(*by).pivot("_side", [f"{c}_{s}" for c in classes for s in ("off", "on")]).agg(F.first("utilisation"))
    for c in classes:
        wide = paired_deltas(wide, c)
    return wide


def counter_means(counters: DataFrame, columns: list[str]) -> DataFrame:
    return counters.agg(*[F.avg(c).alias(c) for c in columns])


def sweep_summary(results: DataFrame) -> DataFrame:
    """Accuracy (1 - loss) and time per training setting, results without loss left out."""
    return results.where(F.col("loss").isNotNull() & ~F.isnan("loss")).groupBy("sims", "keep_pct", "iterations").agg(F.avg(1 - F.col("loss")).alias("accuracy"), F.avg("seconds").alias("seconds"))


def feature_pair_ratio(single: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accuracy of a pair of features over that of its first alone, as a matrix with the second features as columns."""
    return pairs.join(single.select(F.col("feature").alias("feature_1"), F.col("accuracy").alias("_own")), "feature_1").withColumn("ratio", F.col("accuracy") / F.col("_own")).groupBy("feature_1").pivot("feature_2").agg(F.first("ratio"))
