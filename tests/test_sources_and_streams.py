"""Text and JSON sources on hand-made files, and streams against their batch results."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from flowtally.operators import joins
from flowtally.sources import files
from flowtally.streaming import flows as live


def test_params(spark, tmp_path):
    doc = {
        "category": "multibottleneck",
        "bess_bw_Mbps": 100,
        "sender_bottlenecks": {"s1": [{"time_s": 0, "rate_Mbps": 0}, {"time_s": 5, "rate_Mbps": 12.5}], "s2": [{"time_s": 0, "rate_Mbps": 3}]},
        "flowsets": [[["s1"], ["r", 0, 0, 0, 0, 0, 0, "10.0.0.9"], "cubic", 1, 9, [101, 102], 5201, None, None, 2], [["s2"], ["r", 0, 0, 0, 0, 0, 0, "10.0.0.9"], "bbr", 0, 9, [201], 5202, None, None, 1]],
    }
    (tmp_path / "exp-a.json").write_text(json.dumps(doc, indent=2))
    experiments, flows, changes = files.read_params(spark, str(tmp_path))
    assert [tuple(r) for r in experiments.collect()] == [("exp-a", "multibottleneck", 100.0)]
    got = {(r.sender, r.sender_port): (r.receiver, r.receiver_ip, r.cca, r.start_s, r.receiver_port, r.n_flows) for r in flows.collect()}
    assert got[("s1", 102)] == ("r", "10.0.0.9", "cubic", 1.0, 5201, 2) and len(got) == 3
    assert sorted(tuple(r)[1:] for r in changes.collect()) == [("s1", 0.0, 0.0), ("s1", 5.0, 12.5), ("s2", 0.0, 3.0)]


def test_queue_log(spark, tmp_path):
    (tmp_path / "q.txt").write_text("stats:0x1,10,0xa,2\n0,0x3e8,1,0x64,1448,0x5,0,4,1\n1,2000,1,100,0x5a8,4,1,3,1\nnoise\n")
    events, stats = files.read_queue_log(spark, str(tmp_path))
    assert sorted((r.event, r.time_us, r.seq, r.payload_b, r.dropped) for r in events.collect()) == [("deq", 2.0, 100, 1448, True), ("enq", 1.0, 100, 1448, False)]
    assert tuple(stats.first()) == (1, 10, 10, 2)


def test_schedule(spark, tmp_path):
    (tmp_path / "s.csv").write_text("# start,window\n0,1000\n10,2000\n5,1500\n")
    schedule = files.read_schedule(spark, str(tmp_path))
    times = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 5.0, 99.0)], "now_s double")
    assert [r.rwnd_b for r in joins.schedule_at(times, schedule).orderBy("now_s").collect()] == [1000, 1000, 1500, 1500, 2000]
    assert [r.rwnd_b for r in joins.schedule_at(times, schedule, "current").orderBy("now_s").collect()] == [1000, 1000, 1000, 1500, 2000]


def test_reports_and_logs(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text(json.dumps({"end": {"sum_received": {"bits_per_second": 5.0}, "sum_sent": {"retransmits": 8, "start": 1, "end": 5}, "cpu_utilization_percent": {"host_total": 7.5}}}, indent=1))
    (tmp_path / "r" / "b.json").write_text("{}")
    rows = sorted((r.tput_bps, r.retrans_per_s, r.cpu_host_total, r.cpu_remote_user) for r in files.read_load_reports(spark, str(tmp_path / "r")).collect())
    assert rows == [(0.0, 0.0, 0.0, 0.0), (5.0, 2.0, 7.5, 0.0)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.log").write_text("Test accuracy: 0.5\nModel fit in iterations: [12]\nTest accuracy: 0.75\nFinished training - time: 3.5 seconds\n")
    r = files.read_training_logs(spark, str(tmp_path / "l")).first()
    assert (r.accuracy, r.iterations, r.train_s, r.test_s) == (0.75, 12.0, 3.5, None)
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "k.txt").write_text("x\nlen,a,100\nlen,a,200\n")
    assert sorted(r.len for r in files.parse_skb_lengths(spark.read.text(str(tmp_path / "k"))).collect()) == [100, 200]


def test_counters(spark, tmp_path):
    (tmp_path / "c.csv").write_text("System,System,Core0\nL2MISS,L3MISS,L3MISS\n1,2,3\nsocket is disabled\n5,x,7\n")
    rows = files.read_host_counters(spark, str(tmp_path), [("System", "L3MISS"), ("Core0", "L3MISS")]).orderBy("line_no").collect()
    assert [(r.System_L3MISS, r.Core0_L3MISS) for r in rows] == [(2.0, 3.0), (None, 7.0)]


@pytest.fixture
def packets(spark, tmp_path):
    """Three files in order of time: flow 1 stops early, flow 2 goes on."""
    s = 1_000_000
    rows = [(1, k * s // 10) for k in range(20)] + [(2, k * s) for k in range(200)]
    df = spark.createDataFrame(rows, "sender_port long, arrival_us long").withColumns({"ts": F.timestamp_micros("arrival_us"), "payload_b": F.lit(100).cast("long"), "rtt_us": F.lit(50_000.0)})
    for k in range(4):
        df.where(F.floor(F.col("arrival_us") / (50 * s)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_streams_equal_batches(packets):
    df, stream = packets
    rate = live.run_to_end(live.ingress_rate(stream.withColumn("wire_b", F.lit(166)), "10 seconds"), "rate", "update")
    got = {r.start_us: (r.p, r.b) for r in rate.groupBy("start_us").agg(F.max_by("packets", "batch").alias("p"), F.max_by("bytes", "batch").alias("b")).collect()}
    want = {r.start_us: (r.packets, r.bytes) for r in live.ingress_rate(df.withColumn("wire_b", F.lit(166)), "10 seconds").collect()}
    assert got == want
    closed = {tuple(r) for r in live.run_to_end(live.active_sessions(stream, "2 seconds", "10 seconds"), "sessions").collect()}
    assert closed and closed <= {tuple(r) for r in live.active_sessions(df, "2 seconds").collect()}


def test_sender_merge(spark):
    rows = [(7, p, e, t, 10.0 * p, 0.1 * p, 0.2, 100.0 * p, 5.0 * p, 2) for p in (1, 2) for e in (1, 2) for t in (0, 10)] + [(7, 1, 3, 0, 1.0, 0.1, 0.1, 1.0, 1.0, 2)]
    df = spark.createDataFrame(rows, "sender_id long, sender_port long, epoch long, arrival_us long, rtt_us double, loss_event_rate double, loss_rate double, tput_bps double, min_rtt_us double, n_flows int")
    out = live.sender_merge(df, 2).collect()
    assert {r.epoch for r in out} == {2} and len(out) == 2
    assert all((r.rtt_us, r.loss_event_rate, r.tput_bps, r.min_rtt_us) == (15.0, 0.1, 300.0, 5.0) for r in out)
