"""Throughput, fairness and utilisation of experiments, and max-min rates under changing bottlenecks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.functions.unknown import bits_per_second
from flowtally.operators.recurrences import in_packet_order
from flowtally.operators.running import running
from flowtally.sources.tables import FLOW

BUCKET_US = 1_000_000


def flow_throughput(packets: DataFrame, extra: list[str] = []) -> DataFrame:
    """One row per flow: bytes after the first packet over its duration.  ``extra`` columns join the key (such as enabled or sender_id)."""
    rows = packets.groupBy(*dict.fromkeys([*extra, *FLOW])).agg(
        (F.sum("wire_b") - F.min_by("wire_b", "pkt_idx")).alias("bytes"), F.sum("wire_b").alias("all_bytes"), F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us"), F.count(F.lit(1)).alias("n_packets")
    )
    return rows.withColumn("tput_bps", bits_per_second(F.col("bytes"), F.col("last_us") - F.col("first_us")))


def jain_index(shares: DataFrame, by: list[str], value: str = "tput_bps") -> DataFrame:
    """(sum x)^2 / (n sum x^2) over the known shares of each group."""
    x = F.col(value)
    return shares.groupBy(*by).agg((F.pow(F.sum(x), 2) / F.nullif(F.count(x) * F.sum(x * x), F.lit(0.0))).alias("jain"), F.count(x).alias("n"))


def jain_by_sender(shares: DataFrame, by: list[str]) -> DataFrame:
    return jain_index(shares.groupBy(*by, "sender_id").agg(F.sum("tput_bps").alias("tput_bps")), by)


def utilisation(flow_rows: DataFrame, by: list[str], bandwidth: Column | None = None) -> DataFrame:
    """All bytes of a group's flows over its whole span and the link's rate (bw_bps of the rows)."""
    rate = bits_per_second(F.sum("all_bytes"), F.max("last_us") - F.min("first_us"))
    return flow_rows.groupBy(*by).agg((rate / (bandwidth if bandwidth is not None else F.max("bw_bps"))).alias("utilisation"))


# Ways to class a flow for class utilisation; others can be given as columns.
CLASSIFIERS = {"sender": "sender_id", "receiver": "receiver_port", "cca": "cca", "start": "start_s"}


def class_utilisation(flow_rows: DataFrame, by: list[str], classifier: str | Column) -> DataFrame:
    """Utilisation per class of flows."""
    c = F.col(CLASSIFIERS[classifier]) if isinstance(classifier, str) else classifier
    return utilisation(flow_rows.withColumn("flow_class", c), [*by, "flow_class"])


def throughput_series(packets: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Per flow, throughput of buckets that start at their first packet and close with the first packet over ``bucket_us`` after it.

    A bucket has two packets at least, the last one stays open; x_us is its middle.
    A flow's packets pass through in batches; of a bucket only its first and latest packet are held on.
    """
    keys = [c for c in [*FLOW, "sender_id"] if c in packets.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, last, total, sample, key = None, None, 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = key or [batch.column(c)[:1].to_pylist()[0] for c in keys]
            t = batch.column("arrival_us").to_numpy().astype(np.int64)
            b = total + np.cumsum(batch.column("wire_b").to_numpy().astype(np.int64))
            rows, at = [], 0
            start = start or (int(t[0]), int(b[0]))
            while (end := at + int(np.searchsorted(t[at:], start[0] + bucket_us, "right"))) < len(t):
                last = (int(t[end - 1]), int(b[end - 1])) if end else last
                if last and last[0] > start[0]:
                    rows.append((sample, (start[0] + last[0]) / 2, (last[1] - start[1]) * 8e6 / (last[0] - start[0])))
                    sample += 1
                start, at = (int(t[end]), int(b[end])), end
            last, total = (int(t[-1]), int(b[-1])), int(b[-1])
            if rows:
                columns = [pa.array([v] * len(rows), batch.schema.field(c).type) for c, v in zip(keys, key)]
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, zip(*rows))], names=[*keys, "sample_idx", "x_us", "tput_bps"])

    kinds = {f.name: f.dataType.simpleString() for f in packets.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "sample_idx long", "x_us double", "tput_bps double"])
    return in_packet_order(packets.select(*keys, "pkt_idx", "arrival_us", "wire_b")).applyInArrow(run, schema)


def throughput_grid(packets: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """The fixed-grid variant: bytes per flow and bucket as a rate, built in alone."""
    return packets.groupBy(*FLOW, F.floor(F.col("arrival_us") / bucket_us).alias("bucket")).agg((F.sum("wire_b") * 8e6 / bucket_us).alias("tput_bps"))


def sender_series(series: DataFrame) -> DataFrame:
    """Sum of a sender's flow series by sample index, as long as that of its first flow."""
    first = series.groupBy("exp_id", "sender_id").agg(F.min("sender_port").alias("sender_port"))
    length = series.join(first, ["exp_id", "sender_id", "sender_port"]).groupBy("exp_id", "sender_id").agg(F.max("sample_idx").alias("_last"))
    return series.join(length, ["exp_id", "sender_id"]).where("sample_idx <= _last").groupBy("exp_id", "sender_id", "sample_idx").agg(F.sum("tput_bps").alias("tput_bps"))


def mixed_senders(flows: DataFrame) -> DataFrame:
    """Senders of an experiment whose flows differ in congestion control: exp_id, sender_id, ccas (sorted)."""
    return flows.groupBy("exp_id", "sender_id").agg(F.array_sort(F.collect_set("cca")).alias("_c")).where(F.size("_c") > 1).select("exp_id", "sender_id", F.concat_ws(",", "_c").alias("ccas"))


def avg_flow_throughput(rows: DataFrame, column: str) -> DataFrame:
    """Mean known windowed throughput of each flow."""
    return rows.groupBy(*FLOW).agg(F.avg(column).alias("mean_tput_bps"))


def interpolate(series: DataFrame, grid: DataFrame, key: list[str], x: str = "x_us", y: str = "tput_bps") -> DataFrame:
    """Linear interpolation of each key's series at the grid points of the key (columns key, at), clamped at the ends."""
    points = series.select(*key, F.col(x).cast("double").alias("_x"), F.col(y).alias("_y"), F.lit(0).alias("_ask"))
    asks = grid.select(*key, F.col("at").cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_ask"))
    pair = F.when(F.col("_ask") == 0, F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")))
    union = points.unionByName(asks).withColumn("_p", pair)
    before = F.last("_p", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_x", "_ask").rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("_p", ignorenulls=True).over(Window.partitionBy(*key).orderBy(F.desc("_x"), "_ask").rowsBetween(Window.unboundedPreceding, 0))
    met = union.withColumns({"_b": before, "_a": after}).where("_ask = 1")
    share = (F.col("_x") - F.col("_b.x")) / (F.col("_a.x") - F.col("_b.x"))
    value = F.when(F.col("_b").isNull(), F.col("_a.y")).when(F.col("_a").isNull() | (F.col("_a.x") == F.col("_b.x")), F.col("_b.y")).otherwise(F.col("_b.y") + share * (F.col("_a.y") - F.col("_b.y")))
    return met.select(*key, F.col("_x").alias("at"), value.alias(y))


def group_series(series: DataFrame, key: list[str], group: list[str], step: int = 1000, x: str = "x_us", y: str = "tput_bps") -> DataFrame:
    """Sum over a group of its keys' series, each interpolated on a common grid of ``step`` (1 ms)."""
    span = series.groupBy(*group).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    grid = series.select(*dict.fromkeys([*group, *key])).distinct().join(span, group).select(*key, F.explode(F.sequence(F.ceil(F.col("_lo") / step).cast("long") * step, F.col("_hi").cast("long"), F.lit(step).cast("long"))).alias("at"))
    return interpolate(series, grid, key, x, y).groupBy(*group, "at").agg(F.sum(y).alias(y))


def bottleneck_intervals(changes: DataFrame, ends: DataFrame) -> DataFrame:
    """Rate of every sender between consecutive change times of an experiment (exp_id, sender_id, time_s, rate_mbps).

    A sender keeps its rate until its next change; rate 0 is unlimited (NULL); the last
    interval ends at end_s of ``ends``.
    """
    times = changes.select("exp_id", "time_s").distinct()
    cuts = times.join(ends, "exp_id").withColumn("next_s", F.coalesce(F.lead("time_s").over(Window.partitionBy("exp_id").orderBy("time_s")), F.col("end_s")))
    every = cuts.join(changes.select("exp_id", "sender_id").distinct(), "exp_id").join(changes, ["exp_id", "sender_id", "time_s"], "left")
    upto = Window.partitionBy("exp_id", "sender_id").orderBy("time_s").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.last("rate_mbps", ignorenulls=True).over(upto)
    return every.select("exp_id", "sender_id", F.col("time_s").alias("from_s"), F.col("next_s").alias("to_s"), F.when(rate > 0, rate).alias("rate_mbps"))


def maxmin_rates(intervals: DataFrame, flows: DataFrame, links: DataFrame) -> DataFrame:
    """Max-min fair rate per flow of two senders that share a link: exp_id, from_s, to_s, sender_id, maxmin_mbps, violation.

    None limited: the link by all flows; one limited: the other gets the rest; both: their own limits (a violation unless they sum to less than the link).
    """
    n = flows.groupBy("exp_id", "sender_id").agg(F.count(F.lit(1)).alias("flows"))
    pair = intervals.join(n, ["exp_id", "sender_id"]).groupBy("exp_id", "from_s", "to_s").agg(F.array_sort(F.collect_list(F.struct("sender_id", "rate_mbps", "flows"))).alias("s")).join(links, "exp_id").where(F.size("s") == 2)
    both = pair.select("exp_id", "from_s", "to_s", "link_mbps", F.posexplode("s").alias("k", "me"), F.col("s").alias("s")).withColumn("other", F.get("s", 1 - F.col("k")))
    mine, theirs = F.col("me.rate_mbps"), F.col("other.rate_mbps")
    rate = F.when(mine.isNull() & theirs.isNull(), F.col("link_mbps") / (F.col("me.flows") + F.col("other.flows"))).when(mine.isNull(), (F.col("link_mbps") - theirs) / F.col("me.flows")).otherwise(mine / F.col("me.flows"))
    return both.select("exp_id", "from_s", "to_s", F.col("me.sender_id").alias("sender_id"), rate.alias("maxmin_mbps"), F.coalesce(mine + theirs >= F.col("link_mbps"), F.lit(False)).alias("violation"))


def maxmin_shares(packets: DataFrame, rates: DataFrame) -> DataFrame:
    """Actual rate over max-min rate of each flow in each interval (times in s from the experiment's start).

    Packets meet intervals by an as-of union in ranges of time, so no packet is paired with
    every interval and a sender of most packets is spread over many tasks.
    """
    starts = rates.select("exp_id", "sender_id", (F.col("from_s") * 1e6).cast("long").alias("_t"), F.struct("from_s", "to_s", "maxmin_mbps").alias("_r"), F.lit(0).alias("_kind"))
    keep = [*FLOW, "pkt_idx", "wire_b"]
    rows = packets.select("exp_id", "sender_id", F.col("arrival_us").alias("_t"), F.lit(1).alias("_kind"), *[c for c in keep if c != "exp_id"])
    union = rows.unionByName(starts, allowMissingColumns=True)
    met = running(union, ["exp_id", "sender_id"], ["_t", "_kind"], {"_in": ("last", F.col("_r"))}).where("_kind = 1 and _in is not null").where(F.col("_t") < F.col("_in.to_s") * 1e6)
    per = met.groupBy(*FLOW, "sender_id", F.col("_in.from_s").alias("from_s"), F.col("_in.maxmin_mbps").alias("maxmin_mbps")).agg((F.sum("wire_b") - F.min_by("wire_b", "pkt_idx")).alias("bytes"), (F.max("_t") - F.min("_t")).alias("us"))
    return per.withColumn("ratio", bits_per_second(F.col("bytes"), F.col("us")) / (F.col("maxmin_mbps") * 1e6)).drop("bytes", "us")


def bottleneck_change(off: DataFrame, on: DataFrame) -> DataFrame:
    """Mean max-min ratio per interval without and with the mechanism, and the change in percent."""
    mean = lambda df, name: df.groupBy("from_s").agg(F.avg("ratio").alias(name))
    return mean(off, "ratio_off").join(mean(on, "ratio_on"), "from_s").withColumn("change_pct", (F.col("ratio_on") - F.col("ratio_off")) / F.nullif(F.col("ratio_off"), F.lit(0.0)) * 100)
