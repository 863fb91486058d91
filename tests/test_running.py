"""Running values over ranges against windows, with a key that holds most rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window, functions as F

from flowtally.operators import reports, sampling, windows as win
from flowtally.operators.running import running


@pytest.fixture
def ranges(spark):
    """Cuts small tables into many ranges."""
    names = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def hot(spark, n=3000):
    """Two thirds of the rows are of key 0, some of an unknown key; a value in five is unknown."""
    key = F.when(F.col("id") % 3 < 2, 0).when(F.col("id") % 100 == 2, None).otherwise(F.col("id") % 7)
    return spark.range(n).select(key.alias("k"), "id", F.when(F.col("id") % 5 > 0, F.xxhash64("id") % 50).alias("x"))


@pytest.mark.parametrize("down", [False, True])
def test_running_equals_windows(spark, ranges, down):
    order = F.desc("id") if down else F.asc("id")
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = running(hot(spark), ["k"], [order], {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("x"))}, totals=True)
    want = hot(spark).select("k", "id", "x", F.sum("x").over(w), F.max("x").over(w), F.last("x", ignorenulls=True).over(w), F.sum("x").over(Window.partitionBy("k")))
    got = out.select("k", "id", "x", "s", "m", "l", "s_all").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want.collect())))


def test_a_hot_key_is_spread(spark, ranges):
    cut = hot(spark).where("k = 0").repartitionByRange("k", "id")
    assert cut.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_running_on_an_empty_table_and_without_a_key(spark, ranges):
    assert running(hot(spark).where("false"), ["k"], ["id"], {"s": ("sum", F.col("x"))}).count() == 0
    got = running(spark.range(500), [], ["id"], {"n": ("sum", F.lit(1))}).collect()
    assert all(r.n == r.id + 1 for r in got) and len(got) == 500


def test_percentiles_equal_the_builtin(spark, ranges):
    points = [0.0, 0.05, 0.5, 0.9, 0.999, 1.0]
    want = {(r.k, p): v for r in hot(spark).groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("v")).collect() for p, v in zip(points, r.v)}
    got = {(r.k, r.p): r.value for r in reports.percentiles(hot(spark), "x", ["k"], points).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_percentiles_of_infinite_and_unknown_values(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, 2.0), (1, 1.0), (1, -1.7e308), (1, float("-inf")), (2, None), (3, 5e-324), (None, 1.7e308), (None, -1.7e308)], "k int, x double")
    got = {(r.k, r.p): r.value for r in reports.percentiles(df, "x", ["k"], [0.0, 0.5, 1.0]).collect()}
    assert got == {(1, 0.0): float("-inf"), (1, 0.5): 1.0, (1, 1.0): float("inf"), (3, 0.0): 5e-324, (3, 0.5): 5e-324, (3, 1.0): 5e-324, (None, 0.0): -1.7e308, (None, 0.5): 0.0, (None, 1.0): 1.7e308}


def test_percentiles_of_values_that_share_a_bin(spark, ranges):
    """An outlier puts all others into the first bin; they are still numbered exactly, over several tasks."""
    df = spark.range(2001).select(F.when(F.col("id") == 2000, 1e12).otherwise(F.col("id").cast("double")).alias("x"))
    got = {r.p: r.value for r in reports.percentiles(df, "x", [], [0.25, 0.5, 0.9999]).collect()}
    assert got == pytest.approx({0.25: 500.0, 0.5: 1000.0, 0.9999: 1999 + 0.8 * (1e12 - 1999)})


def test_cdf_of_a_hot_group(spark, ranges):
    got = {(r.k, r.x): r.cdf for r in reports.cdf(hot(spark), "x", ["k"]).collect()}
    rows = [(r.k, r.x) for r in hot(spark).collect() if r.x is not None]
    for k in {k for k, _ in rows}:
        own = sorted(x for key, x in rows if key == k)
        assert all(got[k, x] == pytest.approx(sum(y <= x for y in own) / len(own)) for x in set(own))


def test_merged_totals_of_one_hot_experiment(spark, ranges):
    """Both forms agree where one experiment holds nearly all packets and windows span many ranges."""
    rows = spark.range(2000).select(
        F.when(F.col("id") % 50 == 0, 1).otherwise(0).cast("long").alias("exp_id"), (F.col("id") % 4).alias("sender_port"), F.lit(1).cast("long").alias("receiver_port"),
        F.floor(F.col("id") / 4).alias("pkt_idx"), (F.col("id") * 1000 + F.pmod(F.xxhash64("id"), F.lit(3000))).alias("arrival_us"), (F.col("id") % 9 + 100).alias("wire_b"),
        (F.col("id") % 4 * 20_000 + 5000.0).alias("min_rtt_us"), F.lit(4).cast("long").alias("active_flows"), F.lit(1e9).alias("bw_bps"), F.lit(True).alias("use_bess"),
    )
    a, b = ({tuple(r[:4]): tuple(r[4:]) for r in win.merged_totals(rows, [1, 32], method=m).collect()} for m in ("vectorised", "builtin"))
    assert len(a) == 2000 and a == b


def test_samples_of_a_hot_class(spark, ranges):
    """Splits are disjoint with the counts asked for, the same again; balance cuts all classes to the rarest."""
    rows = hot(spark).select(F.coalesce("k", F.lit(9)).alias("exp_id"), "id")
    n = {r.exp_id: r["count"] for r in rows.groupBy("exp_id").count().collect()}
    got, again = (sampling.sample_splits(rows, {"train": 0.5, "test": 0.25}, 0.4, ["id"]).select("exp_id", "id", "split").collect() for _ in range(2))
    assert sorted(got) == sorted(again) and len({r.id for r in got}) == len(got)
    counts = {}
    for r in got:
        counts[r.exp_id, r.split] = counts.get((r.exp_id, r.split), 0) + 1
    assert counts == {(k, s): int(n[k] * f * 0.4) for k in n for s, f in (("train", 0.5), ("test", 0.25)) if int(n[k] * f * 0.4)}
    balanced = {r.exp_id: r["count"] for r in sampling.balance(rows, "exp_id", ["id"]).groupBy("exp_id").count().collect()}
    assert balanced == dict.fromkeys(n, min(n.values()))
    assert sampling.balance(rows, "exp_id", ["id"], "add").groupBy("exp_id").count().where(F.col("count") != max(n.values())).count() == 0
