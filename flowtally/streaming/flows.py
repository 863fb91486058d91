"""Rates and sessions of live packets with Structured Streaming, and decisions in batch form; ``online`` has round trips, flow state and decisions as keyed state.

Every streaming job runs on an unbounded source and, in tests and registered queries, to the end of
what is there (``run_to_end``).  State is keyed by flow and expires by event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtally.functions.unknown import MATHIS_C, MIN_RWND_B, MSS_B
from flowtally.operators.running import join_spread
from flowtally.sources.shared import work_path
from flowtally.sources.tables import wall_micros

SMOOTHING, IDLE_S, ACTIVE_S = 10, 60, 5


def packet_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of received packets with event time ``ts``."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A pattern, since a streaming source takes folders or patterns but no single file.
    path = f"{sf_dir}/event[s].parquet"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.select(
        F.timestamp_micros(wall_micros("ts")).alias("ts"),
        wall_micros("ts").alias("arrival_us"),
        (F.col("user_id") % 3).alias("sender_id"),
        (F.col("user_id") + 10000).alias("sender_port"),
        F.col("event_id").alias("tsecr"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        (F.floor(F.col("value") * 10) + 100).cast("long").alias("payload_b"),
        (F.floor(F.col("value") * 10) + 166).cast("long").alias("wire_b"),
    )


@contextmanager
def state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, which state with lists, maps and timers needs; the session's setting is put back."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that its source holds and returns what it wrote.

    Append streams write Parquet; update and complete ones hand each batch to a table of
    their own, of which the last row of a key or the last batch counts.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True)
    with state_in_rocksdb(spark):
        if mode == "append":
            query = writer.format("parquet").option("path", out).outputMode("append").start()
        else:
            query = writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(out)


def run_each(stream: DataFrame, name: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``work`` on each micro-batch until the source ends and returns what it gave.

    ``work`` may read tables anew for every batch, and a batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    schemas = []

    def write(df: DataFrame, n: int) -> None:
        rows = work(df)
        schemas[:] = [rows.schema]
        rows.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    if not schemas:
        raise ValueError("the stream had no batch")
    return spark.read.schema(schemas[0]).parquet(out)


def ingress_rate(stream: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Packets and bytes per tumbling window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("packets"), F.sum("wire_b").alias("bytes")).select(F.unix_micros("w.start").alias("start_us"), "packets", "bytes")


def active_sessions(stream: DataFrame, gap: str = f"{ACTIVE_S} seconds", late: str = "1 minute") -> DataFrame:
    """Spans in which a flow never paused for the gap: a flow is active until the gap after its last packet."""
    return stream.withWatermark("ts", late).groupBy("sender_port", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("packets")).select("sender_port", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "packets")


# Decisions ----------------------------------------------------------------------------

PACED, NOT_PACED = 0, 1


def react(rate: float, up: bool, strategy: str = "aimd") -> float:
    """AIMD: +1e6 or half.  MIMD: times 1.3 or divided by 1.75."""
    if strategy == "aimd":
        return rate + 1e6 if up else rate / 2
    return rate * 1.3 if up else rate / 1.75


def decide(label: int, measured_bps: float, paced_bps: float | None, strategy: str = "aimd") -> float | None:
    """The paced rate after a label (0 below, 1 near, 2 above), None when not paced."""
    if label == 2:
        return react(paced_bps if paced_bps is not None else measured_bps, False, strategy)
    if paced_bps is not None and label == 0:
        return react(paced_bps, True, strategy)
    return paced_bps


def paced_rates(labels: np.ndarray, measured_bps: np.ndarray, paced_bps: float | None, strategy: str = "aimd") -> np.ndarray:
    """The paced rate after each label in turn (NaN: not paced); rows between changes are filled at once."""
    out, moves = np.empty(len(labels)), np.flatnonzero(labels != 1)
    out[: moves[0] if len(moves) else len(out)] = np.nan if paced_bps is None else paced_bps
    for i, after in zip(moves.tolist(), [*moves[1:].tolist(), len(labels)]):
        paced_bps = decide(int(labels[i]), float(measured_bps[i]), paced_bps, strategy)
        out[i:after] = np.nan if paced_bps is None else paced_bps
    return out


def decisions(rows: DataFrame, key: list[str], order: str, strategy: str = "aimd") -> DataFrame:
    """Batch form: a decision per row of each flow in order (label, tput_bps, min_rtt_us): decision, target_bps, rwnd_b."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*key, order]), "decision int, target_bps double, rwnd_b double"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        target = paced_rates(group["label"].to_numpy(), group["tput_bps"].to_numpy(float), None, strategy)
        out = group[[*key, order]].reset_index(drop=True)
        out["decision"] = np.where(np.isnan(target), NOT_PACED, PACED)
        out["target_bps"], out["rwnd_b"] = target, target / 8 * group["min_rtt_us"].to_numpy(float) / 1e6
        return out.replace({np.nan: None}).infer_objects()

    return rows.select(*key, order, "label", "tput_bps", "min_rtt_us").groupBy(*key).applyInPandas(run, schema)


def apply_decisions(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Only changes go out; windows are rounded half to even and at least 2000 bytes."""
    w = Window.partitionBy(*key).orderBy(order)
    window = F.greatest(F.bround("rwnd_b"), F.lit(float(MIN_RWND_B))).cast("long")
    set_ = rows.withColumn("rwnd_b", window)
    before = F.struct("decision", "rwnd_b")
    changed = ~before.eqNullSafe(F.lag(before).over(w))
    return set_.withColumn("_changed", changed).where("_changed").drop("_changed")


def decide_sender(rows: DataFrame) -> DataFrame:
    """One paced rate per sender: Mathis (1448 B, mean RTT) at loss l / (4 + 5e4 l), divided by its flows."""
    loss = F.col("loss_rate") / (4 + 5e4 * F.col("loss_rate"))
    rate = F.lit(8e6 * MSS_B * MATHIS_C) / F.col("rtt_us") / F.sqrt(F.when(loss > 0, loss)) / F.col("n_flows")
    return rows.withColumns({"target_bps": rate, "decision": F.lit(PACED), "rwnd_b": rate / 8 * F.col("min_rtt_us") / 1e6})


def sender_ready(flows: DataFrame, ready: Column, active: Column) -> DataFrame:
    """Whether all active flows of a sender are ready."""
    return flows.where(active).groupBy("sender_id").agg(F.bool_and(ready).alias("ready"), F.count(F.lit(1)).alias("n_flows"))


def sender_merge(flows: DataFrame, window: int = SMOOTHING) -> DataFrame:
    """One row per sender, epoch and time: flows interpolated at the last ``window`` times of all of them.

    An epoch counts once all of the sender's n_flows are there; of a sender only the
    newest such epoch stays.  Mean RTT and loss rate, least loss event rate and minimum
    RTT, summed throughput; the Mathis rate follows anew from those.  Times are cut to
    the last of each flow, then of the sender, and a sender's rows meet what is one per sender
    in parts by flow, so no task sees all packets of a sender.
    """
    epoch, flow = ["sender_id", "epoch"], ["sender_id", "epoch", "sender_port"]
    ready = flows.groupBy(*epoch).agg(F.countDistinct("sender_port").alias("have"), F.max("n_flows").alias("n_flows")).where("have = n_flows")
    newest = ready.groupBy("sender_id").agg(F.max("epoch").alias("epoch"))
    columns = ["rtt_us", "loss_event_rate", "loss_rate", "tput_bps", "min_rtt_us"]
    rows = join_spread(flows, newest, epoch, ["sender_port"]).select(*flow, "arrival_us", *columns)
    latest = lambda key, order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    last = rows.select(*flow, "arrival_us").withColumn("_own", latest(flow, [F.desc("arrival_us")])).where(F.col("_own") <= window)
    times = last.withColumn("_at", latest(epoch, [F.desc("arrival_us"), "sender_port", "_own"])).where(F.col("_at") <= window).select(*epoch, "_at", F.col("arrival_us").alias("_t"))
    asks = join_spread(rows.select(*flow).distinct(), times, epoch, ["sender_port"])
    seen = F.struct(F.col("arrival_us").alias("_x"), *columns)
    union = rows.select(*flow, F.col("arrival_us").alias("_t"), F.lit(None).cast("int").alias("_at"), seen.alias("_s")).unionByName(asks, allowMissingColumns=True)
    asked = F.col("_at").isNotNull()
    side = lambda order: F.last("_s", ignorenulls=True).over(Window.partitionBy(*flow).orderBy(order, asked).rowsBetween(Window.unboundedPreceding, 0))
    met = union.withColumns({"_b": side(F.col("_t")), "_a": side(F.desc("_t"))}).where(asked)
    b, a = (lambda c: F.coalesce(F.col("_b"), F.col("_a"))[c]), (lambda c: F.coalesce(F.col("_a"), F.col("_b"))[c])
    share = F.coalesce((F.col("_t") - b("_x")) / F.nullif(a("_x") - b("_x"), F.lit(0)), F.lit(0.0))
    how = {"rtt_us": F.avg, "loss_event_rate": F.min, "loss_rate": F.avg, "tput_bps": F.sum, "min_rtt_us": F.min}
    out = met.groupBy(*epoch, "_at", F.col("_t").alias("arrival_us")).agg(*[f(b(c) + share * (a(c) - b(c))).alias(c) for c, f in how.items()])
    model = F.lit(8e6 * MSS_B * MATHIS_C) / F.nullif("rtt_us", F.lit(0.0)) / F.sqrt(F.when(F.col("loss_event_rate") > 0, F.col("loss_event_rate")))
    return out.select(*epoch, "arrival_us", *columns, model.alias("mathis_bps"))
