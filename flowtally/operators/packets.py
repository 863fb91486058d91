"""Packets: direction, filters, trims and relative time.

Bounds of flows and experiments are small aggregates joined back, never windows over an
experiment, so the packets keep their partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.sources.tables import FLOW, flow_window

EXP = ["exp_id"]


def normalize(headers: DataFrame, flows: DataFrame) -> DataFrame:
    """Header fields to packets: ACKs are those sent from the local address, with ports swapped; unknown flows go.

    headers: exp_id, src_addr, local_addr, src_port, dst_port, sec, usec, ip_len, ihl, transport_header_b, seq, tsval, tsecr, wire_b.
    """
    ack = F.col("src_addr") == F.col("local_addr")
    out = headers.select(
        "exp_id",
        F.when(ack, F.col("dst_port")).otherwise(F.col("src_port")).cast("long").alias("sender_port"),
        F.when(ack, F.col("src_port")).otherwise(F.col("dst_port")).cast("long").alias("receiver_port"),
        F.when(ack, 1).otherwise(0).alias("direction"),
        (F.col("sec") * 1_000_000 + F.col("usec")).alias("arrival_us"),
        (F.col("ip_len") - 4 * F.col("ihl") - F.col("transport_header_b")).alias("payload_b"),
        "seq",
        "tsval",
        "tsecr",
        "wire_b",
    )
    return out.join(flows.select(*FLOW).distinct(), FLOW, "left_semi")


def capture_filter(packets: DataFrame, ports: list[int] | None = None, skip_localhost: bool = False) -> DataFrame:
    """TCP only, not SSH, optionally only some local ports and no localhost (little-endian 127.0.0.1)."""
    keep = (F.col("protocol") == 6) & (F.col("local_port") != 22) & (F.col("remote_port") != 22)
    if ports:
        keep &= F.col("local_port").isin(ports)
    if skip_localhost:
        keep &= (F.col("remote_addr") != 0x0100007F) & (F.col("local_addr") != 0x0100007F)
    return packets.where(keep)


def time_bounds(packets: DataFrame, by: list[str] = FLOW) -> DataFrame:
    """First and last arrival of each group."""
    return packets.groupBy(*by).agg(F.min("arrival_us").alias("first_us"), F.max("arrival_us").alias("last_us"), F.count(F.lit(1)).alias("n_packets"))


def select_tail_percent(packets: DataFrame, percent: float, by: list[str]) -> DataFrame:
    """Packets of the last ``percent`` of each capture's duration; a capture without duration keeps one row."""
    bounds = packets.groupBy(*by).agg(F.min("arrival_us").alias("_lo"), F.max("arrival_us").alias("_hi"))
    one = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("arrival_us"), F.desc("pkt_idx")))
    # Exact in integers: 100 (t - last) > -percent (last - first).
    late = 100 * (F.col("arrival_us") - F.col("_hi")) > -percent * (F.col("_hi") - F.col("_lo"))
    return packets.withColumn("_n", one).join(bounds, by).where(late | ((F.col("_hi") == F.col("_lo")) & (F.col("_n") == 1))).drop("_lo", "_hi", "_n")


def drop_empty_flows(packets: DataFrame) -> DataFrame:
    """Flows with fewer than two data packets go."""
    return packets.join(time_bounds(packets).where("n_packets > 1").select(*FLOW), FLOW, "left_semi")


def trim_to_first_finish(packets: DataFrame) -> DataFrame:
    """Packets strictly before the earliest last packet of the experiment's flows; a flow's first packet stays."""
    bounds = time_bounds(packets)
    end = bounds.groupBy(*EXP).agg(F.min("last_us").alias("_end"))
    first = packets.groupBy(*FLOW).agg(F.min("pkt_idx").alias("_first"))
    return packets.join(first, FLOW).join(end, EXP).where((F.col("arrival_us") < F.col("_end")) | (F.col("pkt_idx") == F.col("_first"))).drop("_first", "_end")


def trim_to_common_span(packets: DataFrame, by: list[str] = EXP) -> DataFrame:
    """From the latest first packet (at least the last two of a flow stay) to strictly before the earliest last packet."""
    flow = list(dict.fromkeys([*by, *FLOW]))
    bounds = time_bounds(packets, flow)
    span = bounds.groupBy(*by).agg(F.max("first_us").alias("_start"), F.min("last_us").alias("_end"))
    from_end = F.row_number().over(Window.partitionBy(*flow).orderBy(F.desc("arrival_us"), F.desc("pkt_idx")))
    started = packets.withColumn("_left", from_end).join(span, by).where((F.col("arrival_us") >= F.col("_start")) | (F.col("_left") <= 2))
    return started.where(F.col("arrival_us") < F.col("_end")).drop("_left", "_start", "_end")


def relative_time(packets: DataFrame, times: list[str] = ["arrival_us"], origin: DataFrame | None = None) -> DataFrame:
    """Times less the experiment's earliest first packet (of ``origin``, which defaults to the packets)."""
    start = (origin if origin is not None else packets).groupBy(*EXP).agg(F.min("arrival_us").alias("_t0"))
    return packets.join(start, EXP).withColumns({c: F.col(c) - F.col("_t0") for c in times}).drop("_t0")


def warmup_drop(rows: DataFrame, fraction: float) -> DataFrame:
    """Drops the first floor(n * fraction) rows of each flow."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*FLOW))
    return rows.withColumn("_rn", F.row_number().over(flow_window())).withColumn("_skip", F.floor(n * F.lit(float(fraction)))).where("_rn > _skip").drop("_rn", "_skip")


def drop_bad_experiments(experiments: DataFrame, flows: DataFrame) -> DataFrame:
    """Experiments that did not fail, have flows and a capture, and exactly one receiver."""
    one = flows.groupBy("exp_name").agg(F.countDistinct("receiver").alias("_n")).where("_n = 1")
    return experiments.where(~F.col("exp_name").startswith("FAILED") & F.coalesce(F.col("has_capture"), F.lit(False))).join(one, "exp_name", "left_semi")


def drop_unknown_labels(rows: DataFrame, label: str) -> DataFrame:
    return rows.where(F.col(label).isNotNull())


def flag_non_finite(rows: DataFrame, columns: list[str], by: list[str] = EXP) -> DataFrame:
    """Long form (by, feature, has_non_finite): one aggregate over all columns."""
    bad = lambda c: F.max(F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(False)))
    return rows.groupBy(*by).agg(*[bad(F.col(c)).alias(c) for c in columns]).unpivot(by, columns, "feature", "has_non_finite")


def replace_unknowns(rows: DataFrame, columns: list[str], mode: str = "mean") -> DataFrame:
    """Unknown values become the column's mean (one aggregate row), or with mode "trees" NaN; all-unknown columns stay unknown under "mean"."""
    if mode == "trees":
        return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})
    means = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    return rows.join(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*[f"_m_{c}" for c in columns])


def unknown_report(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long form (feature, n_unknown, all_unknown): one aggregate over all columns."""
    counts = rows.agg(*[F.count(F.lit(1)).alias("_n"), *[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in columns]])
    return counts.unpivot(["_n"], columns, "feature", "known").select("feature", (F.col("_n") - F.col("known")).alias("n_unknown"), (F.col("known") == 0).alias("all_unknown"))


def replace_infinite(c: Column) -> Column:
    """Infinite values become unknown."""
    return F.when(F.abs(c) != float("inf"), c)


def project_required(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns asked for; an error names those that are missing."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"missing columns: {missing}")
    return rows.select(*columns)
