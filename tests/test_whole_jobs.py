"""Queries that do the whole job beside the ones that do a part of it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowtally.operators import recurrences
from flowtally.sources.tables import data_packets
from flowtally.streaming import flows as live, online

QUERIES = entry.queries()


def test_every_answered_packet_has_its_rtt(spark, sf_dir):
    want = {(r.sender_port, r.tsecr): float(r.gen_rtt_us) if r.k % 10 else None for r in data_packets(spark, sf_dir).collect()}
    got = {(r.sender_port, r.tsecr): r.rtt_us for r in QUERIES["j1_stream_rtt_all"](spark, sf_dir).collect()}
    assert got == want and max(x for x in want.values() if x) > 36_000_000_000 and None in want.values()


def test_losses_on_the_stream_are_those_of_the_batch(spark, tmp_path):
    """A flow in four files with a gap of two packets after every seventh: losses span files and batches."""
    s = 1_000_000
    rows = [(0, 1, 1, k, (k + 2 * (k // 7)) * 100, (k + 1) * s, 100, 166, 500_000.0) for k in range(120)]
    df = spark.createDataFrame(rows, "exp_id long, sender_port long, receiver_port long, pkt_idx long, seq long, arrival_us long, payload_b long, wire_b long, rtt_us double").withColumn("ts", F.timestamp_micros("arrival_us"))
    for k in range(4):
        df.where(F.floor(F.col("pkt_idx") / 30) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.run_to_end(online.decide_live(stream, [8, 16], late="1 hour", smoothing=8, idle_s=3600), "flows").where("event = 'features'").collect()
    want = {r.arrival_us: r.loss_event_rate_cw8 for r in recurrences.loss_event_features(df).join(df.select("pkt_idx", "arrival_us"), "pkt_idx").collect()}
    assert len(out) == 32
    for r in out:
        assert r.loss_event_rate == pytest.approx(want[r.arrival_us])


def test_the_safe_window_is_sought_among_all(spark, sf_dir):
    from flowtally.functions.registry import WINDOWS

    rows = QUERIES["d20_window_errors_all"](spark, sf_dir).collect()
    for e in {r.exp_id for r in rows}:
        own = {r.k: r.n_errors for r in rows if r.exp_id == e}
        assert sorted(own) == WINDOWS
        assert {r.safe_k for r in rows if r.exp_id == e} == {min((k for k, n in own.items() if n == 0), default=0)}
