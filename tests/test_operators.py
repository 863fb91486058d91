"""Hand-made flows and properties of the operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from flowtally.functions import registry, unknown as u
from flowtally.operators import experiments, fairness, features, joins, models, packets as pk, recurrences, reports, sampling, scoring, windows as win
from flowtally.streaming import flows as live

FLOW = {"exp_id": 1, "sender_port": 10, "receiver_port": 20}


def flow(spark, rows, **key):
    """Packets of one flow from (arrival_us, seq, payload_b) tuples."""
    k = FLOW | key
    data = [(k["exp_id"], k["sender_port"], k["receiver_port"], i, seq, t, None, b, b + 66) for i, (t, seq, b) in enumerate(rows)]
    return spark.createDataFrame(data, "exp_id long, sender_port long, receiver_port long, pkt_idx long, seq long, arrival_us long, tsecr long, payload_b long, wire_b long")


def column(df, name, order="pkt_idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def featured(df, spark, acks=None):
    acks = acks if acks is not None else spark.createDataFrame([], "exp_id long, sender_port long, receiver_port long, tsval long, ack_us long, ack_idx long")
    rows = joins.match_rtt_tcp(joins.is_retransmission(df), acks)
    meta = spark.createDataFrame([(1, 1e9, False), (2, 1e9, False)], "exp_id long, bw_bps double, use_bess boolean")
    return features.row_features(joins.attach_exp_meta(joins.active_flows(rows), meta))


def test_names():
    names = registry.all_features()
    assert len(names) == len(set(names)) == 318
    for n in names:
        metric, kind, p = registry.parse_name(n)
        assert n == {"regular": lambda: metric, "ewma": lambda: registry.ewma_name(metric, p)}.get(kind, lambda: registry.window_name(metric, int(p or 0)))()
    assert registry.GROUND_TRUTH_COLUMN == "tput_to_fair_ratio_w8" and not registry.is_knowable("total_tput_bps_w4")
    assert "loss_rate_w8" in registry.close_over_inputs(["mathis_tput_bps_w8"]) and set(registry.model_inputs()) <= set(registry.knowable_features())


def test_unknown_values(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, float("inf")), (0.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(u.safe_div(F.col("a"), F.col("b"))).collect()] == [0.5, None, None, None, 0.0]
    assert [r[0] for r in df.select(u.safe_least(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 2.0, 1.0, 3.0]
    assert [r[0] for r in df.select(u.to_marker(u.from_marker(F.lit(-1)))).collect()] == [-1] * 5
    ratios = spark.createDataFrame([(0.89,), (0.9,), (1.1,), (1.11,), (None,)], "r double")
    assert [r[0] for r in ratios.select(u.fairness_class(F.col("r"))).collect()] == [0, 1, 1, 2, None]


def test_losses(spark):
    gap = featured(flow(spark, [(0, 0, 100), (10, 100, 100), (20, 500, 100)]), spark)
    assert column(gap, "pkts_lost") == [None, 0, 3] and column(gap, "loss_rate") == [None, 0, 0.75]
    even = featured(flow(spark, [(0, 0, 100), (10, 350, 100), (20, 800, 100)]), spark)
    assert column(even, "pkts_lost") == [None, 2, 4]
    again = featured(flow(spark, [(0, 0, 100), (10, 100, 100), (20, 100, 100), (30, 50, 100), (40, 200, 100)]), spark)
    assert column(again, "is_retrans") == [False, False, True, True, False]
    assert column(again, "pkts_lost") == [None, 0, None, None, None]
    assert column(gap, "pkts_lost_total") == [0, 0, 3]


def test_sequence_wrap(spark):
    rows = joins.is_retransmission(flow(spark, [(0, 2**32 - 150, 100), (10, 2**32 - 50, 100), (20, 50, 100), (30, 150, 100)]))
    assert column(rows, "seq_epoch") == [0, 0, 1, 1] and column(rows, "prev_seq")[2] is None and not any(column(rows, "is_retrans"))


def test_rtt_carry_reset_and_order(spark):
    df = flow(spark, [(100, 0, 10), (200, 10, 10), (300, 20, 10), (400, 20, 10), (500, 30, 10), (600, 40, 10), (700, 50, 10)])
    echoes = {1: 7, 2: 99, 4: 99, 5: 9, 6: 8}
    df = df.withColumn("tsecr", F.create_map(*[F.lit(x) for kv in echoes.items() for x in kv])[F.col("pkt_idx").cast("int")].cast("long"))
    acks = spark.createDataFrame([(1, 10, 20, ts, t, k) for k, (ts, t) in enumerate([(7, 150), (7, 160), (8, 250), (9, 350)])], "exp_id long, sender_port long, receiver_port long, tsval long, ack_us long, ack_idx long")
    rows = joins.match_rtt_tcp(joins.is_retransmission(df), acks)
    # first: none; match; miss carries; repeat resets; miss carries the reset; match; an ACK that lies behind does not match.
    assert column(rows, "rtt_us") == [None, 50.0, 50.0, None, None, 250.0, 250.0]


def test_min_rtt_before_any_is_huge(spark):
    rows = featured(flow(spark, [(0, 0, 10), (5, 10, 10)]), spark)
    assert column(rows, "min_rtt_us") == [u.NO_RTT] * 2 and column(rows, "has_rtt") == [False, False]


def test_equal_times(spark):
    rows = featured(flow(spark, [(0, 0, 10), (0, 10, 10)]), spark)
    assert column(rows, "inv_interarrival_bps") == [None, None]
    online = features.online_features(rows.withColumn("min_rtt_us", F.lit(4.0)).withColumn("rtt_us", F.lit(8.0)))
    assert column(online, "interarrival_us") == [None, 1.0] and column(online, "rtt_ratio") == [2.0, 2.0]


def test_trims(spark):
    a, b = flow(spark, [(0, 0, 1), (10, 1, 1), (20, 2, 1)]), flow(spark, [(5, 0, 1), (15, 1, 1), (30, 2, 1)], sender_port=11)
    both = a.unionByName(b)
    first = pk.trim_to_first_finish(both)
    assert sorted((r.sender_port, r.arrival_us) for r in first.collect()) == [(10, 0), (10, 10), (11, 5), (11, 15)]
    span = pk.trim_to_common_span(both)
    assert sorted((r.sender_port, r.arrival_us) for r in span.collect()) == [(10, 10), (11, 5), (11, 15)]
    assert pk.drop_empty_flows(flow(spark, [(0, 0, 1)])).count() == 0
    assert sorted(r.arrival_us for r in pk.relative_time(b).collect()) == [0, 10, 25]
    one = flow(spark, [(7, 0, 1), (7, 1, 1)])
    assert pk.select_tail_percent(one, 10, ["exp_id"]).count() == 1


@pytest.mark.parametrize("method", ["vectorised", "builtin"])
def test_window_starts(spark, method):
    df = flow(spark, [(0, 0, 1), (10, 1, 1), (20, 2, 1), (500, 3, 1), (505, 4, 1)]).withColumn("min_rtt_us", F.lit(12.0))
    rows = win.window_starts(df, [1, 2], method=method)
    assert column(rows, "s_w1") == [None, 0, 1, 2, 3] and column(rows, "s_w2") == [None, 0, 0, 2, 3]


@pytest.mark.parametrize("method", ["vectorised", "builtin"])
def test_merged_starts_never_move_back(spark, method):
    df = spark.createDataFrame([(1, k, 10 * k, w) for k, w in enumerate([5.0, 5.0, 5.0, 1000.0, 5.0])], "exp_id long, m_idx long, arrival_us long, min_rtt_us double")
    rows = win.window_starts(df, [1], ["exp_id"], "m_idx", method=method, forward_only=True)
    assert column(rows, "s_w1", "m_idx") == [None, 0, 1, 1, 3]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.floats(0.5, 30)), min_size=2, max_size=40))
def test_both_window_methods_agree(spark, steps):
    t = np.cumsum([s for s, _ in steps])
    low = np.minimum.accumulate([w for _, w in steps])
    df = flow(spark, [(int(x), k, 1) for k, x in enumerate(t)]).join(spark.createDataFrame([(k, float(w)) for k, w in enumerate(low)], "pkt_idx long, min_rtt_us double"), "pkt_idx")
    a, b = (sorted(map(tuple, win.window_starts(df, [1, 4], method=m).select("pkt_idx", "s_w1", "s_w4").collect())) for m in ("vectorised", "builtin"))
    assert a == b


def test_ewma_rules():
    x = np.array([np.nan, 0, 0.5, 0, np.nan, 0.2])
    got = recurrences.ewma_paths(x, np.array([0.5]))[:, 0]
    assert np.isnan(got[0]) and got[1:].tolist() == [0, 0.5, 0.5, 0.5, 0.35]


def slow_events(tracker, lost, before, now, rtt):
    """One step per lost packet."""
    for k in range(lost):
        at = before + (k + 1) * (now - before) / lost
        if at > tracker.events[0][0] + rtt:
            tracker.events.insert(0, [at, 0])
            del tracker.events[max(tracker.windows) + 1 :]
        tracker.events[0][1] += 1
    tracker.events[0][1] += 1


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 500), st.sampled_from([-1.0, 0.0, 3.0, 50.0, 400.0])), min_size=1, max_size=12))
def test_loss_events_match_a_step_by_step_tracker(steps):
    a, b, t = recurrences.LossEvents((8,)), recurrences.LossEvents((8,)), 1000
    for lost, gap, rtt in steps:
        a.add(lost, t, t + gap, rtt)
        slow_events(b, lost, t, t + gap, rtt)
        t += gap
        assert [e[1] for e in a.events] == [e[1] for e in b.events] and a.rates() == b.rates()


def test_a_huge_gap_is_quick():
    tracker = recurrences.LossEvents((8,))
    tracker.add(10**9, 0, 10**6, 1e-9)
    assert [e[1] for e in tracker.events] == [2] + [1] * 8


def test_find_bound(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([10, None, 20, 30])], "g long, idx long, v long")
    probes = spark.createDataFrame([(1, t) for t in (5, 10, 15, 30, 99)] + [(2, 5)], "g long, t long")
    after = {(r.g, r.t): r.bound for r in joins.find_bound(rows, probes, ["g"], "v", "t", "after").collect()}
    before = {(r.g, r.t): r.bound for r in joins.find_bound(rows, probes, ["g"], "v", "t", "before").collect()}
    assert after == {(1, 5): 0, (1, 10): 0, (1, 15): 2, (1, 30): 3, (1, 99): 3, (2, 5): None}
    assert before == {(1, 5): 0, (1, 10): 0, (1, 15): 1, (1, 30): 2, (1, 99): 3, (2, 5): None}


def test_experiment_names(spark):
    names = [
        "unfair-36.0bw-164.0rtt-2048q-bbr,cubic-1,7-0.16ping-unfairFalse-bessTrue-id885164571-20240123T092126.tar.gz",
        "unfair-pcc-cubic-8bw-30rtt-64q-1pcc-1cubic-100s-20201118T114242.tar.gz",
        "unfair-pcc-cubic-8bw-30rtt-64q-2pcc-3cubic-unfairTrue-100s-20201118T114242",
        "unfair-pcc-cubic-8bw-30rtt-64q-1pcc-1cubic-5ping-unfairFalse-bessFalse-100s-2020",
        "unfair-pcc-cubic-8bw-30rtt-64q-1pcc-1cubic-3bitrate-4bitrate-35.60ping-unfairTrue-bessTrue-100s-2020.npz",
        "unfair-pcc-cubic-bbr-8bw-30rtt-64q-1pcc-1cubic-2bbr-3bitrate-4bitrate-5bitrate-35.60ping-unfairTrue-bessTrue-100s-2020",
    ]
    good, bad = experiments.parse_names(spark.createDataFrame([(n,) for n in names], "exp_name string"))
    got = {r.exp_name: r for r in good.collect()}
    assert [r.exp_name for r in bad.collect()] == [names[1][:-7]]
    first = next(r for r in got.values() if r.cca_1 == "bbr")
    assert (first.cca_2, first.flows_1, first.flows_2, first.use_monitor, first.bw_bps, first.queue_pkts) == ("cubic", 1, 7, False, 36e6, 2048)
    assert sorted(r.tot_flows for r in got.values()) == [2, 2, 4, 5, 8]
    assert next(r for r in got.values() if not r.use_bess).bw_bps is None


def test_maxmin(spark):
    changes = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 0, 10.0, 4.0), (1, 1, 20.0, 3.0)], "exp_id long, sender_id long, time_s double, rate_mbps double")
    spans = fairness.bottleneck_intervals(changes, spark.createDataFrame([(1, 30.0)], "exp_id long, end_s double"))
    flows = spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "exp_id long, sender_id long")
    rates = fairness.maxmin_rates(spans, flows, spark.createDataFrame([(1, 9.0)], "exp_id long, link_mbps double"))
    assert {(r.from_s, r.sender_id): r.maxmin_mbps for r in rates.collect()} == {(0.0, 0): 3.0, (0.0, 1): 3.0, (10.0, 0): 2.0, (10.0, 1): 5.0, (20.0, 0): 2.0, (20.0, 1): 3.0}


@given(st.lists(st.floats(0.01, 1e6), min_size=1, max_size=20))
@settings(max_examples=5, deadline=None)
def test_jain_index_lies_between(spark, shares):
    r = fairness.jain_index(spark.createDataFrame([(1, x) for x in shares], "exp_id long, tput_bps double"), ["exp_id"]).first()
    assert 1 / len(shares) - 1e-9 <= r.jain <= 1 + 1e-9 and r.n == len(shares)


def test_anchored_series(spark):
    s = 1_000_000
    df = flow(spark, [(0, 0, 34), (s // 2, 1, 34), (s, 2, 34), (s + 1, 3, 34), (3 * s, 4, 34), (3 * s + 9, 5, 34)])
    rows = fairness.throughput_series(df).collect()
    assert [(r.sample_idx, r.x_us, r.tput_bps) for r in rows] == [(0, s / 2, 1600.0)]


def test_splits_are_disjoint_and_sized(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("exp_id"), "id")
    out = sampling.sample_splits(rows, {"train": 0.7, "val": 0.0, "test": 0.3}, 0.5, ["id"])
    assert out.select("id").distinct().count() == out.count()
    counts = {(r.exp_id, r.split): r["count"] for r in out.groupBy("exp_id", "split").count().collect()}
    assert counts[(0, "train")] == int(334 * 0.35) and counts[(1, "test")] == int(333 * 0.15) and (0, "val") not in counts
    assert sampling.pick_experiments(rows.select("exp_id").distinct(), 2).count() == 2


def test_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    params = {r.feature: (r.p1, r.p2) for r in sampling.fit_scale(df, ["a", "b"]).collect()}
    assert params == {"a": (2.0, 1.0), "b": (5.0, 0.0)}
    assert [tuple(r) for r in sampling.apply_scale(df, params).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    joint = {r.feature: (r.p1, r.p2) for r in sampling.fit_scale(df, ["a", "b"], False, [["a", "b"]]).collect()}
    assert joint == {"a": (1.0, 5.0), "b": (1.0, 5.0)}


def test_modes_and_numbers(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 1, 1, 2, 2)], "g long, label int")
    assert scoring.label_mode(df, ["g"]).first().label == 2
    rows = scoring.global_row_numbers(spark.range(100).select((99 - F.col("id")).alias("v")), ["v"]).collect()
    assert all(r.v == r.rn for r in rows) and len(rows) == 100
    assert reports.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v").first().n == 2


def test_ward_clusters():
    m = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0.8], [0, 0, 0.8, 1]], float)
    assert models.ward_clusters(m, 2).tolist() == [0, 0, 1, 1]


def test_decisions():
    labels, paced = [2, 2, 1, 0], None
    seen = []
    for label in labels:
        paced = live.decide(label, 8e6, paced)
        seen.append(paced)
    assert seen == [4e6, 2e6, 2e6, 3e6]
    assert live.decide(0, 5.0, None) is None and live.react(7.0, False, "mimd") == 4.0 and live.react(10.0, True, "mimd") == 13.0


def test_interpolation_is_clamped(spark):
    series = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0)], "k long, x_us long, tput_bps double")
    grid = spark.createDataFrame([(1, x) for x in (0, 10, 15, 30)], "k long, at long")
    assert [r.tput_bps for r in fairness.interpolate(series, grid, ["k"]).orderBy("at").collect()] == [1.0, 1.0, 2.0, 3.0]


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-3000, -100, 0, 0, 0, 50, 100, 700, 2**31]), st.sampled_from([0, 1, 100, 100, 1448])), min_size=1, max_size=30), st.integers(0, 30), st.integers(2**32 - 4000, 2**32 - 1))
def test_gap_losses_against_one_packet_after_another(steps, cut, origin):
    seq, b, at = [], [], origin
    for jump, payload in steps:
        at = max(0, at + jump) % 2**32
        seq.append(at)
        b.append(payload)
        at += payload
    want, high = [], 0
    for i in range(1, len(seq)):
        high = max(high, seq[i - 1])
        end = seq[i - 1] + b[i - 1]
        if b[i] and b[i - 1] and end > 2**32:
            high = 0
            want.append(0)
        else:
            want.append(round((seq[i] - end) / b[i]) if b[i] and b[i - 1] and end < seq[i] and high == seq[i - 1] else 0)
    s, p = np.array(seq, np.int64), np.array(b, np.int64)
    lost, last = recurrences.gap_losses(s, p)
    assert lost.tolist() == want and (len(seq) < 2 or last == high)
    # In two parts that share a packet, as batches do.
    k = min(cut, len(seq) - 1)
    first, high = recurrences.gap_losses(s[: k + 1], p[: k + 1])
    second, _ = recurrences.gap_losses(s[k:], p[k:], highest=high)
    assert [*first.tolist(), *second.tolist()] == want


@settings(deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1, 3, 40]), st.integers(0, 500), st.sampled_from([-1.0, 0.0, 3.0, 50.0, 400.0])), min_size=1, max_size=40))
def test_packets_between_losses_are_counted_at_once(steps):
    windows = (4, 8, 16)
    a, b = recurrences.LossEvents(windows), recurrences.LossEvents(windows)
    t = np.cumsum([1000, *[g for _, g, _ in steps]]).astype(float)
    got = a.follow(np.array([x for x, _, _ in steps]), t, np.array([0.0, *[r for _, _, r in steps]]))
    for i, (lost, _, rtt) in enumerate(steps):
        slow_events(b, lost, t[i], t[i + 1], rtt)
        assert np.allclose(got[i], b.rates(), rtol=1e-12)
    assert [e[1] for e in a.events] == [e[1] for e in b.events]


def test_long_flows_go_through_in_batches(spark):
    """State is handed on from batch to batch: the result does not depend on the batches' size."""
    rows = spark.range(3000).select((F.col("id") % 3).alias("exp_id"), F.lit(1).alias("sender_port"), F.lit(1).alias("receiver_port"), F.floor(F.col("id") / 3).alias("pkt_idx"), (F.col("id") * 100 + F.when(F.col("id") % 50 == 0, 700).otherwise(0)).alias("seq"), (F.col("id") * 1000).alias("arrival_us"), F.lit(100).alias("payload_b"), F.when(F.col("id") % 7 != 0, 5000.0 + F.col("id") % 11).alias("rtt_us"))
    found, limit = [], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for n in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            found.append([sorted(map(tuple, df.collect())) for df in (recurrences.ewma_features(rows, ["rtt_us"], [0.1, 0.9]), recurrences.loss_event_features(rows, (4, 8)))])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    assert found[0] == found[1] and len(found[0][0]) == 3000
