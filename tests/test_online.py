"""Live features, labels and decisions against a packet-by-packet account of the same micro-batches."""

from __future__ import annotations

from math import sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.streaming import flows as live, online

S, WINDOWS, SMOOTHING = 1_000_000, [2, 8], 5


def packets():
    """Two flows with gaps, repeats, pauses and unknown RTTs, in four batches; flow 2 has too few packets at first, flow 3 never an RTT."""
    rng, rows = np.random.default_rng(4), []
    for port, n in ((1, 160), (2, 60), (3, 40)):
        t, seq = 0, 0
        for k in range(n):
            t += int(rng.integers(0, 2 * S))
            payload = int(rng.integers(1, 4)) * 100
            seq += 0 if k % 13 == 5 else int(rng.integers(0, 3)) * 200 if k % 4 == 0 else 0
            rtt = None if port == 3 or k % 9 == 0 else float(rng.integers(2 * S, 4 * S))
            rows.append((port, t, max(0, seq - (300 if k % 17 == 9 else 0)), payload, payload + 66, rtt))
            seq += payload
    return rows


def mean(xs):
    return sum(xs) / len(xs) if xs else None


def account(batches):
    """Features and decisions of one flow, one packet after another."""
    buffer, first, low, last, high, events, ewma, paced, done, out = [], None, None, None, 0, [[0.0, 0]], {}, None, (None, None), []
    for batch in batches:
        for t, seq, payload, wire, rtt in batch:
            lost, rate = 0, 0.0
            if last:
                high = max(high, last[1])
                if last[1] + last[2] < seq and high == last[1]:
                    lost = round((seq - last[1] - last[2]) / payload)
                for k in range(lost):
                    at = last[0] + (k + 1) * (t - last[0]) / lost
                    if at > events[0][0] + (rtt or -1.0):
                        events.insert(0, [at, 0])
                        del events[9:]
                    events[0][1] += 1
                events[0][1] += 1
                w = [1 - i / 8 for i in range(8)]
                sizes = [e[1] for e in events]
                rate = sum(w[: len(sizes[:8])]) / max(sum(a * b for a, b in zip(sizes[:8], w)), sum(a * b for a, b in zip(sizes[1:9], w)))
            first = t if first is None else first
            low = rtt if low is None or (rtt and rtt < low) else low
            last = (t, seq, payload)
            buffer.append((t, payload, wire, rtt, lost, rate))
        if len(buffer) <= SMOOTHING or low is None or buffer[-SMOOTHING][0] - first < low * max(WINDOWS):
            continue
        need = buffer[-SMOOTHING][0] - low * max(WINDOWS)
        at = next(i for i, p in enumerate(buffer) if p[0] >= need)
        buffer = buffer[min(at, len(buffer) - SMOOTHING - 1) :]
        paths = []
        for i, (t, payload, wire, rtt, lost, rate) in enumerate(buffer):
            values = {"rtt": rtt, "gap": max(t - buffer[i - 1][0], 1) if i else None}
            for name, x in values.items():
                e = ewma.get(name)
                ewma[name] = x if e in (None, 0) else e if x in (None, 0) else 0.1 * x + 0.9 * e
            paths.append(dict(ewma))
        rows, shares = [], []
        for j in range(len(buffer) - SMOOTHING, len(buffer)):
            t, payload, wire, rtt, lost, rate = buffer[j]
            row = {"arrival_us": t, "packets": len(buffer), "min_rtt_us": low, "loss_event_rate": rate, "rtt_us_ewma_a0_1": paths[j]["rtt"], "interarrival_us_ewma_a0_1": paths[j]["gap"]}
            for k in WINDOWS:
                s = min(next(i for i, p in enumerate(buffer) if p[0] >= t - k * low), j - 1)
                whole, inside, span = t - buffer[0][0] >= k * low, buffer[s + 1 : j + 1], t - buffer[s][0]
                gone = sum(p[4] for p in inside)
                loss = gone / (gone + j - s)
                row |= {
                    f"interarrival_us_w{k}": span / (j - s) if whole else None,
                    f"tput_bps_w{k}": sum(p[2] for p in inside) * 8e6 / span if whole and span else None,
                    f"rtt_us_w{k}": mean([p[3] for p in buffer[s : j + 1] if p[3] is not None]) if whole else None,
                    f"loss_rate_w{k}": loss if whole else None,
                    f"mathis_tput_bps_w{k}": 8e6 * payload * sqrt(1.5) / rtt / sqrt(loss) if whole and loss and rtt else None,
                }
            if row["tput_bps_w8"] is not None and row["mathis_tput_bps_w8"]:
                shares.append(row["tput_bps_w8"] / row["mathis_tput_bps_w8"])
            rows.append(row)
        r, measured = mean(shares), rows[-1]["tput_bps_w8"]
        label = None if r is None else 0 if r < 0.9 else 1 if r <= 1.1 else 2
        if label is not None and measured is not None:
            if label == 2:
                paced = (paced if paced is not None else measured) / 2
            elif label == 0 and paced is not None:
                paced += 1e6
        now = (1, None) if paced is None else (0, max(round(paced / 8 * low / 1e6), 2000))
        out += [row | {"label": label, "decision": now[0], "target_bps": paced, "rwnd_b": now[1], "changed": now != done} for row in rows]
        done, buffer = now, []
    return out


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("live") / "in")
    rows = packets()
    df = spark.createDataFrame(rows, "sender_port long, arrival_us long, seq long, payload_b long, wire_b long, rtt_us double").withColumn("ts", F.timestamp_micros("arrival_us"))
    for k in range(4):
        df.where(F.least(F.floor(F.col("arrival_us") / (40 * S)), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    late = spark.createDataFrame([(1, 5, 0, 100, 166, None)] * 3, "sender_port long, arrival_us long, seq long, payload_b long, wire_b long, rtt_us double").withColumn("ts", F.timestamp_micros("arrival_us"))
    late.coalesce(1).write.mode("append").parquet(path)
    return rows, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_live_features_and_decisions(stream):
    rows, source = stream
    out = [r.asDict() for r in live.run_to_end(online.decide_live(source, WINDOWS, late="1 hour", smoothing=SMOOTHING, idle_s=3600), "online").collect()]
    assert {(r["sender_port"], r["event"], r["packets"]) for r in out if r["event"] != "features"} == {(1, "late", 3)}
    features, changes = {}, 0
    for r in out:
        if r["event"] == "features":
            features.setdefault(r["sender_port"], {})[(r["arrival_us"], r["packets"])] = r
    assert 3 not in features
    for port in (1, 2):
        own = [p for p in rows if p[0] == port]
        batches = [[(t, seq, b, w, rtt) for _, t, seq, b, w, rtt in own if min(t // (40 * S), 3) == k] for k in range(4)]
        want = account(batches)
        got = features[port]
        assert len(want) == sum(1 for r in out if r["event"] == "features" and r["sender_port"] == port) and len(want) >= 10
        for w in want:
            g = got[(w["arrival_us"], w["packets"])]
            for name, x in w.items():
                assert (g[name] is None) if x is None else g[name] == pytest.approx(x), (port, w["arrival_us"], name)
            changes += g["changed"]
    assert changes


def test_idle_flows_leave_a_row(spark, tmp_path):
    rows = [(1, k * S, k * 100, 100, 166, 50_000.0) for k in range(30)] + [(2, k * S, k * 100, 100, 166, 50_000.0) for k in range(300)]
    df = spark.createDataFrame(rows, "sender_port long, arrival_us long, seq long, payload_b long, wire_b long, rtt_us double").withColumn("ts", F.timestamp_micros("arrival_us"))
    for k in range(3):
        df.where(F.floor(F.col("arrival_us") / (100 * S)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.run_to_end(online.decide_live(stream, [8], late="10 seconds", idle_s=60), "online").where("event = 'removed'").collect()
    assert [(r.sender_port, r.arrival_us) for r in out] == [(1, 29 * S)] and out[0].packets == 1
