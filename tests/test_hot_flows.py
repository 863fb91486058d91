"""One flow that holds most packets: EWMAs over ranges, throughput series and histograms in batches, against plain accounts."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.functions.registry import ewma_name
from flowtally.operators import fairness, recurrences, windows as win
from flowtally.operators.recurrences import ewma_paths
from flowtally.sources.shared import stored

KEY = "exp_id long, sender_port long, receiver_port long, sender_id long, pkt_idx long, arrival_us long, wire_b long, rtt_us double, loss_rate double"


@pytest.fixture
def many_ranges(spark):
    """Cuts small tables into many ranges and Arrow batches."""
    names = {"spark.sql.shuffle.partitions": "11", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def flows(spark):
    """Flow 1 has 900 of 1,000 packets, with unknown and zero values, pauses and equal times; flow 4 has one packet."""
    rng, rows = random.Random(8), []
    for port, n in ((1, 900), (2, 60), (3, 39), (4, 1)):
        t = 0
        for k in range(n):
            t += rng.choice([0, 0, 1, 5, 40, 900])
            # Flow 1 has no usable value at first, so its average opens in a later range.
            rtt = None if (port == 1 and k < 300) or rng.random() < 0.2 else float(rng.randrange(1, 50))
            rows.append((0, port, 1, 7, k, t, rng.randrange(60, 1500), rtt, 0.0 if rng.random() < 0.6 else rng.random()))
    return spark.createDataFrame(rows, KEY), rows


def ewma_by_hand(xs, a):
    e, out = None, []
    for x in xs:
        e = x if e in (None, 0) else e if x in (None, 0) else a * x + (1 - a) * e
        out.append(e)
    return out


def test_averages_of_a_flow_over_many_ranges(spark, many_ranges):
    df, rows = flows(spark)
    alphas = [0.1, 0.5, 1.0]
    out = {(r.sender_port, r.pkt_idx): r.asDict() for r in recurrences.ewma_features(df, ["rtt_us", "loss_rate"], alphas).collect()}
    assert len(out) == 1000
    for port in (1, 2, 3, 4):
        own = [r for r in rows if r[1] == port]
        for m, at in (("rtt_us", 7), ("loss_rate", 8)):
            for a in alphas:
                for r, want in zip(own, ewma_by_hand([x[at] for x in own], a)):
                    got = out[(port, r[4])][ewma_name(m, a)]
                    assert got is None if want is None else got == pytest.approx(want, rel=1e-9), (port, r[4], m, a)


def test_a_hot_flow_spans_ranges(spark, many_ranges):
    df, _ = flows(spark)
    ranges = df.repartitionByRange("exp_id", "sender_port", "receiver_port", "pkt_idx").withColumn("_part", F.spark_partition_id())
    carries = recurrences.ewma_carries(stored(ranges), ["rtt_us"], [0.5]).where("sender_port = 1").collect()
    assert len(carries) >= 8


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_blocks_of_maps_equal_steps(n, monkeypatch):
    monkeypatch.setattr(recurrences, "STEPS", 0)
    rng = np.random.default_rng(n)
    x = rng.normal(5, 2, (n, 3))
    x[rng.random((n, 3)) < 0.4] = np.nan
    x[rng.random((n, 3)) < 0.2] = 0
    alphas = np.array([0.01, 0.5, 0.99, 1.0])
    for start in (None, np.array([np.nan, 0.0, 3.0] * 4)):
        got = ewma_paths(x, alphas, start)
        for c in range(3):
            for k, a in enumerate(alphas):
                e, col = (np.nan if start is None else start[c * 4 + k]), c * 4 + k
                for i in range(n):
                    e = x[i, c] if np.isnan(e) or e == 0 else e if np.isnan(x[i, c]) or x[i, c] == 0 else a * x[i, c] + (1 - a) * e
                    assert (np.isnan(e) and np.isnan(got[i, col])) or got[i, col] == pytest.approx(e, rel=1e-10)


def series_by_hand(packets, bucket):
    out, start = [], 0
    while True:
        end = next((i for i in range(start, len(packets)) if packets[i][5] > packets[start][5] + bucket), None)
        if end is None:
            return out
        if packets[end - 1][5] > packets[start][5]:
            span = packets[end - 1][5] - packets[start][5]
            out.append((len(out), (packets[start][5] + packets[end - 1][5]) / 2, sum(p[6] for p in packets[start + 1 : end]) * 8e6 / span))
        start = end


@pytest.mark.parametrize("bucket", [0, 3, 100, 5000, 10**9])
def test_series_of_a_flow_in_batches(spark, many_ranges, bucket):
    df, rows = flows(spark)
    got = fairness.throughput_series(df, bucket).collect()
    for port in (1, 2, 3, 4):
        mine = sorted((r.sample_idx, r.x_us, r.tput_bps) for r in got if r.sender_port == port)
        want = series_by_hand([r for r in rows if r[1] == port], bucket)
        assert np.array(mine) == pytest.approx(np.array(want))


@pytest.mark.parametrize("duration,buckets", [(1, 1), (7, 3), (100, 10), (5000, 7), (10**7, 4)])
def test_histograms_of_a_flow_in_batches(spark, many_ranges, duration, buckets):
    df, rows = flows(spark)
    got = {(r.sender_port, r.end_idx, r.bucket): r.n for r in win.arrival_histogram(df, duration, buckets).collect()}
    want = {}
    for port in (1, 2, 3, 4):
        t = [r[5] for r in rows if r[1] == port]
        for k, end in enumerate(t):
            for x in t:
                if end - duration <= x <= end:
                    at = (port, k, min((x - end + duration) * buckets // duration, buckets - 1))
                    want[at] = want.get(at, 0) + 1
    assert got == want
