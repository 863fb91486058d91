"""Round trips, late rows, idle flows, timers and sender decisions in chained keyed state."""

from __future__ import annotations

from math import sqrt

import pytest
from pyspark.sql import functions as F

from flowtally.streaming import flows as live, online

S = 1_000_000
RAW = "sender_port long, direction int, arrival_us long, tsval long, tsecr long, seq long, payload_b long, wire_b long"
TRIPS = "sender_port long, arrival_us long, seq long, payload_b long, wire_b long, rtt_us double"


def source(spark, path, batches, schema):
    """A stream of one micro-batch for each list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("arrival_us")).coalesce(1).write.mode("append").parquet(path)
    full = spark.read.parquet(path).schema
    return spark.readStream.schema(full).option("maxFilesPerTrigger", 1).parquet(path)


def watch(frame, tmp_path, name, trigger=None, until=None):
    """Runs a stream into memory; its rows and the number of state rows after each batch."""
    with live.state_in_rocksdb(frame.sparkSession):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(**(trigger or {"availableNow": True})).start()
    if until:
        until(query)
        query.stop()
    else:
        query.awaitTermination()
    sizes = [sum(o.numRowsTotal for o in p.stateOperators) for p in query.recentProgress if p.stateOperators]
    return [r.asDict() for r in frame.sparkSession.table(name).collect()], sizes


def sent(port, t, tsval):
    return (port, 1, t, tsval, None, None, None, None)


def got(port, t, tsecr, seq=0):
    return (port, 0, t, None, tsecr, seq, 100, 166)


def test_the_last_send_of_a_tsval_wins_and_every_packet_stays(spark, tmp_path):
    batches = [
        [sent(1, S, 7), sent(1, 1_400_000, 7), got(1, 2 * S, 7), got(1, 2 * S + 1, 99), sent(2, S, 5)],
        [got(1, 3 * S, 7), sent(1, 3 * S + 5, 7), got(1, 3 * S + 5, 7), got(1, 4 * S, 7), got(2, 3 * S, 5), got(2, 3 * S + 1, None), got(3, 3 * S, 7)],
        [got(1, 5 * S, 7), got(1, 2 * S, 7)],
    ]
    rows = live.run_to_end(online.round_trips(online.watched(source(spark, str(tmp_path / "in"), batches, RAW), "1 second")), "trips").collect()
    want = [
        (1, 2 * S, 7, 600_000.0), (1, 2 * S + 1, 99, None), (1, 3 * S, 7, 1_600_000.0), (1, 3 * S + 5, 7, 1_600_005.0), (1, 4 * S, 7, 999_995.0),
        (2, 3 * S, 5, 2_000_000.0), (2, 3 * S + 1, None, None), (3, 3 * S, 7, None), (1, 5 * S, 7, 1_999_995.0), (1, 2 * S, 7, None),
    ]
    assert sorted(map(repr, ((r.sender_port, r.arrival_us, r.tsecr, r.rtt_us) for r in rows))) == sorted(map(repr, want))


def test_sends_are_forgotten_behind_the_watermark(spark, tmp_path):
    batches = [[sent(1, k * S, k) for k in range(100)], [got(1, 5_000 * S, 3)], [got(1, 5_001 * S, 4), sent(1, 5_001 * S, 4)], [got(1, 5_002 * S, 4)]]
    frame = online.round_trips(online.watched(source(spark, str(tmp_path / "in"), batches, RAW), "1 second"), keep_s=60)
    rows, sizes = watch(frame, tmp_path, "forget")
    assert max(sizes) >= 100 and sizes[-1] < 10
    assert sorted(r["rtt_us"] or 0 for r in rows)[-1] >= S and rows[-1]["rtt_us"] == S


def trip(port, t, k, rtt=50_000.0):
    return (port, t, k * 100, 100, 166, rtt)


def account(rows, given):
    """Packets in and packets that a row speaks for or the state took."""
    return sum(len(b) for b in given), sum(r["packets"] for r in rows if r["event"] == "late")


def test_late_rows_on_both_sides_of_the_watermark_are_counted(spark, tmp_path):
    batches = [
        [trip(1, k * S, k) for k in range(20)] + [trip(4, k * S, k) for k in range(5)],
        [trip(2, 1000 * S + k * S, k) for k in range(20)],
        [trip(2, 1019 * S + 1, 20), trip(2, 1015 * S, 21), trip(2, 1016 * S, 22)],  # late, not behind the watermark
        [trip(2, 1100 * S, 23), trip(1, 3 * S, 30), trip(1, 4 * S, 31), trip(4, 2 * S, 9)],  # of flows gone: theirs is a new start
        [trip(2, 2 * S, 24), trip(2, 1101 * S, 25), trip(3, 10 * S, 0)],  # late and far behind the watermark
    ]
    frame = online.decide_live(source(spark, str(tmp_path / "in"), batches, TRIPS), [8], late="10 seconds", smoothing=5, idle_s=60, announce=True)
    rows, sizes = watch(frame, tmp_path, "late")
    late = [(r["sender_port"], r["packets"]) for r in rows if r["event"] == "late"]
    assert sorted(late) == [(2, 1), (2, 2)]
    opened = sorted((r["sender_port"], r["packets"]) for r in rows if r["event"] == "open")
    assert opened == [(1, 2), (1, 20), (2, 20), (3, 1), (4, 1), (4, 5)]
    # Every packet is in a flow's first batch, in a later batch of it, or late.
    assert sum(map(len, batches)) == sum(n for _, n in opened) + 3 + sum(n for _, n in late)
    removed = sorted((r["sender_port"], r["arrival_us"]) for r in rows if r["event"] == "removed")
    assert removed == [(1, 4 * S), (1, 19 * S), (3, 10 * S), (4, 2 * S), (4, 4 * S)]
    assert sizes[-1] < sizes[0]


def test_a_flow_without_rtt_keeps_a_bounded_buffer(spark, tmp_path):
    batches = [[trip(1, (i * 40 + k) * S, i * 40 + k, None) for k in range(40)] for i in range(10)]
    frame = online.decide_live(source(spark, str(tmp_path / "in"), batches, TRIPS), [8], late="10 seconds", smoothing=5, idle_s=3600, most=50)
    rows, sizes = watch(frame, tmp_path, "bounded")
    assert {r["event"] for r in rows} == {"trimmed"}
    gone = sum(r["packets"] for r in rows)
    assert 400 - 100 <= gone <= 400 - 50 and max(sizes) < 12


def test_a_slow_flow_is_evaluated_by_time_alone(spark, tmp_path):
    """Flow 1 has few packets and is due half a second of event time after it is ready; flow 2 has enough."""
    batches = [[trip(1, k * S, k) for k in range(12)] + [trip(2, k * S // 10, k) for k in range(120)], [trip(2, 13 * S + k, 120 + k) for k in range(5)], [trip(2, 30 * S, 130)], [trip(2, 31 * S, 131)]]
    frame = online.decide_live(source(spark, str(tmp_path / "in"), batches, TRIPS), [8], late="1 second", smoothing=5, idle_s=600, enough=100, wait_s=0.5)
    rows, _ = watch(frame, tmp_path, "slow")
    by_flow = {p: sorted(r["arrival_us"] for r in rows if r["sender_port"] == p and r["event"] == "features") for p in (1, 2)}
    assert by_flow[1] == [k * S for k in range(7, 12)] and by_flow[2][:5] == [k * S // 10 for k in range(115, 120)]


def test_the_wall_clock_evaluates_and_removes(spark, tmp_path):
    import time

    batches = [[trip(1, k * S, k) for k in range(12)]]
    frame = online.decide_live(source(spark, str(tmp_path / "in"), batches, TRIPS), [8], late="1 second", smoothing=5, enough=100, wait_s=0.3, idle_s=2, clock="ProcessingTime")

    def until(query):
        end = time.time() + 60
        while time.time() < end and not (spark.catalog.tableExists("wall") and spark.table("wall").where("event = 'removed'").count()):
            time.sleep(0.5)

    rows, _ = watch(frame, tmp_path, "wall", {"processingTime": "200 milliseconds"}, until)
    assert [r["event"] for r in rows] == ["features"] * 5 + ["removed"]


# Senders ------------------------------------------------------------------------------

SENDER = "sender_id long, sender_port long, event string, epoch long, n_flows long, arrival_us long, rtt_us double, loss_event_rate double, loss_rate double, tput_bps double, min_rtt_us double"


def member(sender, port, epoch, t, n=2):
    return (sender, port, "features", epoch, n, t, 10.0 * port + t, 0.1 / port, 0.2 * port, 100.0 * port + t, 5.0 * port)


def test_sender_decisions_equal_the_batch_form(spark, tmp_path):
    """Epoch 1 is complete, epoch 2 of sender 7 is not and is discarded by epoch 3; a late row of epoch 2 changes nothing."""
    batches = [
        [member(s, p, 1, t) for s in (7, 8) for p in (1, 2) for t in range(0, 50, 10)],
        [member(7, 1, 2, t) for t in range(60, 90, 10)] + [member(8, p, 2, t) for p in (1, 2) for t in range(60 + p, 90, 10)],
        [member(7, p, 3, t) for p in (1, 2) for t in range(100 + p, 140, 10)],
        [member(7, 2, 2, 95), member(8, 1, 3, 100)],
    ]
    stream = source(spark, str(tmp_path / "in"), batches, SENDER)
    rows, _ = watch(online.decide_senders(online.watched(stream, "1 hour"), 3), tmp_path, "senders")
    assert sorted({(r["sender_id"], r["epoch"]) for r in rows}) == [(7, 1), (7, 3), (8, 1), (8, 2)]
    batch = live.sender_merge(spark.createDataFrame([r for b in batches for r in b if not (r[0] == 7 and r[3] == 2)], SENDER), 3)
    newest = {(r.sender_id, r.arrival_us): r.asDict() for r in batch.collect()}
    mine = {(r["sender_id"], r["arrival_us"]): r for r in rows if (r["sender_id"], r["epoch"]) in {(7, 3), (8, 2)}}
    assert mine.keys() == newest.keys() and len(mine) == 6
    for at, w in newest.items():
        for c in ("epoch", *online.MERGED, "mathis_bps"):
            assert mine[at][c] == pytest.approx(w[c]), (at, c)
    last = spark.createDataFrame([max((r for r in rows if (r["sender_id"], r["epoch"]) == e), key=lambda r: r["arrival_us"]) for e in ((7, 3), (8, 2))], "sender_id long, epoch long, arrival_us long, rtt_us double, loss_event_rate double, loss_rate double, tput_bps double, min_rtt_us double, mathis_bps double, n_flows long, target_bps double, rwnd_b long, changed boolean")
    for r in live.decide_sender(last.drop("target_bps", "loss_rate", "rwnd_b").withColumnRenamed("loss_event_rate", "loss_rate").join(last.select("sender_id", F.col("target_bps").alias("mine")), "sender_id")).collect():
        assert r.mine == pytest.approx(r.target_bps)


def test_raw_packets_to_sender_decisions(spark, tmp_path):
    """Two flows of a sender, in both directions, through three chained states; a third flow holds the sender back until it is removed."""
    rows = []
    for port in (1, 2):
        for k in range(60):
            rows += [(5, *sent(port, k * S, k)), (5, *got(port, k * S + 100_000 * port, k, (k + k // 7) * 100))]
    first = [r for r in rows if r[3] < 30 * S] + [(5, *got(3, S, None))]
    later = [r for r in rows if r[3] >= 30 * S]
    after = [(6, *got(9, 300 * S, None)), (6, *got(9, 301 * S, None))]
    again = [(5, *got(port, 302 * S + k * S, 1000, (200 + k) * 100)) for port in (1, 2) for k in range(20)] + [(5, *sent(port, 301 * S + k * S, 1000)) for port in (1, 2) for k in range(20)]
    stream = source(spark, str(tmp_path / "in"), [first, later, after, again], "sender_id long, " + RAW)
    key = ["sender_id", "sender_port"]
    trips = online.round_trips(online.watched(stream, "1 second"), key, keep_s=60)
    decided = online.decide_live(trips, [8], late=None, key=key, smoothing=5, idle_s=100, announce=True)
    rows, _ = watch(online.decide_senders(online.sender_rows(decided, F.floor(F.col("arrival_us") / (1000 * S))), 5), tmp_path, "chain")
    assert rows and {r["sender_id"] for r in rows} == {5} and {r["n_flows"] for r in rows} == {2}
    r = max(rows, key=lambda r: r["arrival_us"])
    assert r["arrival_us"] >= 302 * S
    soft = r["loss_event_rate"] / (4 + 5e4 * r["loss_event_rate"])
    assert r["target_bps"] == pytest.approx(8e6 * 1448 * sqrt(1.5) / r["rtt_us"] / sqrt(soft) / 2)
