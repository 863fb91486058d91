"""Packets, flows and experiments derived from the ``events`` table.

Each user is a flow of experiment user_id % 5.  Payloads, sequence numbers (with gaps on
errors and step-backs as retransmissions) and round trips follow from the event's value
and the number in its properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FLOW = ["exp_id", "sender_port", "receiver_port"]
PACKET_ORDER = ["arrival_us", "pkt_idx"]
BANDWIDTHS = [(0, 50.0, True), (1, 100.0, True), (2, 20.0, True), (3, 200.0, True), (4, 50.0, False)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_micros(name: str) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    c = F.col(name)
    minutes = F.unix_date(F.to_date(c)) * 1440 + F.hour(c) * 60 + F.minute(c)
    return minutes.cast("long") * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


def flow_window() -> Window:
    return Window.partitionBy(*FLOW).orderBy("pkt_idx")


def data_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received data packets: flow key, pkt_idx, seq, arrival_us, tsecr, payload_b, wire_b, gen_rtt_us, k."""
    base = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("exp_id"),
        (F.col("user_id") + 10000).alias("sender_port"),
        F.lit(5201).cast("long").alias("receiver_port"),
        (F.col("user_id") % 3).alias("sender_id"),
        wall_micros("ts").alias("arrival_us"),
        F.col("event_id").alias("tsecr"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.col("event_type"),
        (F.floor(F.col("value") * 10) + 100).cast("long").alias("payload_b"),
    )
    order = Window.partitionBy(*FLOW).orderBy("arrival_us", "tsecr")
    run = F.sum(F.col("payload_b") * F.when(F.col("event_type") == "error", 4).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = base.withColumn("pkt_idx", (F.row_number().over(order) - 1).cast("long")).withColumn("run_b", run)
    seq = F.when(F.col("k") % 17 == 0, F.greatest(F.col("run_b") - F.col("payload_b") - 2000, F.lit(0))).otherwise(F.col("run_b") - F.col("payload_b"))
    return numbered.select(*FLOW, "sender_id", "pkt_idx", seq.alias("seq"), "arrival_us", "tsecr", "payload_b", (F.col("payload_b") + 66).alias("wire_b"), ((F.col("k") + 1) * 1_000_000_000).alias("gen_rtt_us"), "k")


def ack_packets(data: DataFrame) -> DataFrame:
    """The ACKs that the data packets answer: flow key, ack_idx, tsval, ack_us; a tenth is missing."""
    sent = data.where("k % 10 <> 0").select(*FLOW, F.col("tsecr").alias("tsval"), (F.col("arrival_us") - F.col("gen_rtt_us")).alias("ack_us"))
    order = Window.partitionBy(*FLOW).orderBy("ack_us", "tsval")
    return sent.withColumn("ack_idx", (F.row_number().over(order) - 1).cast("long"))


def raw_packets(data: DataFrame, ticks: int = 1) -> DataFrame:
    """Packets of both directions as captured: received data (direction 0) and the sent packets that it answers (1).

    A TSval stands for ``ticks`` events, so that a flow sends it again if ticks is large; a tenth is never sent.
    """
    clock = F.expr(f"tsecr div {ticks}")
    received = data.select("sender_id", "sender_port", F.lit(0).alias("direction"), "arrival_us", F.lit(None).cast("long").alias("tsval"), clock.alias("tsecr"), "seq", "payload_b", "wire_b")
    sent = data.where("k % 10 <> 0").select("sender_id", "sender_port", F.lit(1).alias("direction"), (F.col("arrival_us") - F.col("gen_rtt_us")).alias("arrival_us"), clock.alias("tsval"))
    return received.unionByName(sent, allowMissingColumns=True).withColumn("ts", F.timestamp_micros("arrival_us"))


def bandwidths(spark: SparkSession) -> DataFrame:
    """exp_id, bw_bps, use_bess: the emulated link of each experiment (constant, five rows)."""
    return spark.createDataFrame(BANDWIDTHS, "exp_id long, bw_bps double, use_bess boolean")


def paired_packets(data: DataFrame) -> DataFrame:
    """Every experiment twice: as it is (enabled false) and without the packets of odd events (enabled true)."""
    return data.withColumn("enabled", F.explode(F.when(F.col("tsecr") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))


# The same tables in DuckDB's SQL, as the head of an oracle's WITH clause.
ORACLE_PACKETS = """
ev AS (SELECT event_id, epoch_us(ts) AS arrival_us, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
base AS (SELECT user_id % 5 AS exp_id, user_id + 10000 AS sender_port, CAST(5201 AS BIGINT) AS receiver_port, user_id % 3 AS sender_id, arrival_us,
  event_id AS tsecr, k, event_type, CAST(floor(value * 10) AS BIGINT) + 100 AS payload_b FROM ev),
numbered AS (SELECT *, row_number() OVER o - 1 AS pkt_idx,
  CAST(sum(payload_b * CASE WHEN event_type = 'error' THEN 4 ELSE 1 END) OVER (PARTITION BY exp_id, sender_port, receiver_port ORDER BY arrival_us, tsecr ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_b
  FROM base WINDOW o AS (PARTITION BY exp_id, sender_port, receiver_port ORDER BY arrival_us, tsecr)),
data AS (SELECT exp_id, sender_port, receiver_port, sender_id, pkt_idx, CASE WHEN k % 17 = 0 THEN greatest(run_b - payload_b - 2000, 0) ELSE run_b - payload_b END AS seq,
  arrival_us, tsecr, payload_b, payload_b + 66 AS wire_b, (k + 1) * 1000000000 AS gen_rtt_us, k FROM numbered),
acks AS (SELECT exp_id, sender_port, receiver_port, tsecr AS tsval, arrival_us - gen_rtt_us AS ack_us,
  row_number() OVER (PARTITION BY exp_id, sender_port, receiver_port ORDER BY arrival_us - gen_rtt_us, tsecr) - 1 AS ack_idx FROM data WHERE k % 10 <> 0),
bw(exp_id, bw_bps, use_bess) AS (VALUES (0, 50.0::DOUBLE, true), (1, 100.0::DOUBLE, true), (2, 20.0::DOUBLE, true), (3, 200.0::DOUBLE, true), (4, 50.0::DOUBLE, false))"""
