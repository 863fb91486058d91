"""Queries for the smaller operators: round trips, projections, metadata joins, online variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtally.functions import registry
from flowtally.operators import fairness, features, joins, packets as pk, sampling
from flowtally.operators.running import running
from flowtally.plans.packet_queries import KEY, O_FEATURES, O_LABELLED, labelled, with_features, with_rtt
from flowtally.plans.registry import query
from flowtally.sources import files
from flowtally.sources.shared import work_path
from flowtally.sources.tables import FLOW, ORACLE_PACKETS, ack_packets, data_packets, table
from flowtally.streaming import flows as live


@query(f"WITH {ORACLE_PACKETS}, u AS (SELECT exp_id, 0 AS direction, payload_b FROM data UNION ALL SELECT exp_id, 1, 0 FROM acks) SELECT exp_id, direction, count(*) AS n, CAST(sum(payload_b) AS BIGINT) AS payload_b FROM u GROUP BY ALL")
def a1_read_packets(spark, sf_dir):
    """Data packets and ACKs written as captures by experiment and read back."""
    data = data_packets(spark, sf_dir)
    none = F.lit(None).cast("long")
    both = data.select(*FLOW, F.lit(0).alias("direction"), "pkt_idx", "seq", "arrival_us", none.alias("tsval"), "tsecr", "payload_b", "wire_b").unionByName(
        ack_packets(data).select(*FLOW, F.lit(1).alias("direction"), F.col("ack_idx").alias("pkt_idx"), none.alias("seq"), F.col("ack_us").alias("arrival_us"), "tsval", none.alias("tsecr"), F.lit(0).cast("long").alias("payload_b"), F.lit(66).cast("long").alias("wire_b"))
    )
    path = work_path(spark, "captures")
    both.write.partitionBy("exp_id").parquet(path)
    return files.read_packets(spark, path).groupBy("exp_id", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_b").alias("payload_b"))


@query(f"WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(arrival_us) - min(arrival_us), 0) AS tput FROM data GROUP BY {KEY}) SELECT exp_id, round(pow(sum(tput), 2) / nullif(count(tput) * sum(tput * tput), 0), 9) AS jain FROM f GROUP BY exp_id")
def a13_write_eval_results(spark, sf_dir):
    path = work_path(spark, "results")
    files.write_eval_results(fairness.jain_index(fairness.flow_throughput(data_packets(spark, sf_dir)), ["exp_id"]), path)
    return spark.read.schema("exp_id long, jain double, n long").json(path).select("exp_id", F.round("jain", 9).alias("jain"))


@query("WITH f AS (SELECT DISTINCT CASE WHEN user_id % 7 = 0 THEN concat('FAILED-', user_id % 20) ELSE concat('exp-', user_id % 20) END AS exp_name, user_id % 20 AS e, user_id // 160 AS receiver FROM events), n AS (SELECT exp_name, e, count(DISTINCT receiver) AS r FROM f GROUP BY ALL) SELECT exp_name FROM n WHERE r = 1 AND NOT starts_with(exp_name, 'FAILED') AND e % 3 <> 0")
def b5_drop_bad_experiments(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("e", F.col("user_id") % 20)
    flows = users.select(F.concat(F.when(F.col("user_id") % 7 == 0, "FAILED-").otherwise("exp-"), F.col("e").cast("string")).alias("exp_name"), "e", F.floor(F.col("user_id") / 160).alias("receiver"))
    experiments = flows.select("exp_name", (F.col("e") % 3 != 0).alias("has_capture")).distinct()
    return pk.drop_bad_experiments(experiments, flows).select("exp_name")


KNOWABLE = [c for c in registry.REGULAR if registry.is_knowable(c)]


@query(f"WITH {O_FEATURES}, c AS (SELECT " + ", ".join(f"count({c}) AS {c}" for c in KNOWABLE) + " FROM feat), u AS (UNPIVOT c ON " + ", ".join(KNOWABLE) + " INTO NAME feature VALUE n) SELECT feature, n FROM u")
def b10_knowable_features(spark, sf_dir):
    """Known values of each regular feature that a receiver on its own can know."""
    rows = pk.project_required(with_features(spark, sf_dir), KNOWABLE)
    return rows.agg(*[F.count(c).alias(c) for c in KNOWABLE]).unpivot([], KNOWABLE, "feature", "n")


@query(f"WITH {O_LABELLED} SELECT exp_id, count(*) AS n FROM labelled WHERE ratio IS NOT NULL GROUP BY exp_id")
def b14_drop_unknown_labels(spark, sf_dir):
    return pk.drop_unknown_labels(labelled(spark, sf_dir), "label").groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS n, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS mean FROM events GROUP BY event_type")
def b17_replace_infinite(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 10 == 0, float("inf")).otherwise(F.col("value")))
    clean = rows.withColumn("value", pk.replace_infinite(F.col("value")))
    return clean.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query(f"WITH {ORACLE_PACKETS} SELECT exp_id, CASE WHEN sender_port % 2 = 0 THEN 'cubic' ELSE 'bbr' END AS cca, count(*) AS n, CAST(sum(wire_b) AS BIGINT) AS wire_b FROM data GROUP BY ALL")
def c1_attach_flow_meta(spark, sf_dir):
    data = data_packets(spark, sf_dir)
    meta = data.select(*FLOW).distinct().withColumn("cca", F.when(F.col("sender_port") % 2 == 0, "cubic").otherwise("bbr"))
    return joins.attach_flow_meta(data, meta).groupBy("exp_id", "cca").agg(F.count(F.lit(1)).alias("n"), F.sum("wire_b").alias("wire_b"))


@query(f"WITH {O_FEATURES}, o AS (SELECT {KEY}, pkt_idx, wire_b, CASE WHEN interarrival_us = 0 THEN 1 ELSE interarrival_us END AS gap, rtt_us / 1e9 AS ratio, (k % 3) / (k % 3 + 1.0) AS loss FROM feat) SELECT {KEY}, pkt_idx, round(gap, 0) AS interarrival_us, round(8e6 * wire_b / gap, 6) AS inv_interarrival_bps, round(ratio, 6) AS rtt_ratio, round(loss, 9) AS loss_rate FROM o")
def e12_online_features(spark, sf_dir):
    rows = with_rtt(spark, sf_dir).withColumns({"min_rtt_us": F.lit(1e9), "pkts_lost": (F.col("k") % 3).cast("double")})
    out = features.online_features(rows)
    return out.select(*FLOW, "pkt_idx", F.round("interarrival_us", 0).alias("interarrival_us"), F.round("inv_interarrival_bps", 6).alias("inv_interarrival_bps"), F.round("rtt_ratio", 6).alias("rtt_ratio"), F.round("loss_rate", 9).alias("loss_rate"))


@query("SELECT exp_id FROM (SELECT DISTINCT user_id % 97 AS exp_id FROM events) ORDER BY md5(concat_ws('|', '1', exp_id)), exp_id LIMIT 10")
def g3_pick_experiments(spark, sf_dir):
    names = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("exp_id")).distinct()
    return sampling.pick_experiments(names, 10)


@query(f"WITH {ORACLE_PACKETS} SELECT {KEY}, pkt_idx, row_number() OVER (PARTITION BY exp_id ORDER BY arrival_us, sender_port, receiver_port, pkt_idx) - 1 AS m_idx FROM data")
def h1_merge_timelines(spark, sf_dir):
    """All flows of an experiment on one timeline; at equal times the lower flow first."""
    rows = data_packets(spark, sf_dir).select(*FLOW, "pkt_idx", "arrival_us")
    numbered = running(rows, ["exp_id"], ["arrival_us", "sender_port", "receiver_port", "pkt_idx"], {"_n": ("sum", F.lit(1))})
    return numbered.select(*FLOW, "pkt_idx", (F.col("_n") - 1).alias("m_idx"))


@query("WITH s AS (SELECT user_id * 1.0 AS start_s, 2000 + user_id * 10 AS rwnd_b FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)) SELECT user_id + 10000 AS sender_port, event_id AS tsecr, coalesce((SELECT arg_min(rwnd_b, start_s) FROM s WHERE start_s >= user_id), (SELECT arg_max(rwnd_b, start_s) FROM s)) AS rwnd_b FROM events")
def j17_scheduled_window(spark, sf_dir):
    """A stream joined with a schedule that is read anew for each micro-batch."""
    users = table(spark, sf_dir, "events").where("user_id % 10 = 0").select("user_id").distinct()
    path = work_path(spark, "schedule")
    users.select(F.col("user_id").cast("double").alias("start_s"), (2000 + F.col("user_id") * 10).alias("rwnd_b")).write.parquet(path)
    stream = live.packet_stream(spark, sf_dir).withColumn("now_s", (F.col("sender_port") - 10000).cast("double")).select("sender_port", "tsecr", "now_s")
    return live.run_each(stream, "scheduled", lambda df: joins.schedule_at(df, df.sparkSession.read.parquet(path)).drop("now_s")).drop("batch")
