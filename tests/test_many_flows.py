"""Work on many small flows is done for all of them at once, and costs no step per flow."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from flowtally.operators import windows as win
from flowtally.streaming import online


def brute_starts(rows, k, forward):
    """rows: (key, idx, t, width) in order; the start of each by looking at all packets of its key."""
    out, far = [], {}
    for key, i, t, w in rows:
        own = [r for r in rows if r[0] == key]
        # An unknown width reaches no further than the packet before.
        start = i - 1 if w is None else min([r[1] for r in own if r[2] >= t - k * w] + [i - 1])
        start = max(start, 0)
        if forward:
            start = far[key] = max(start, far.get(key, 0))
        out.append(start if i else None)
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("step", [1, 7, 10_000])
def test_starts_of_many_flows_in_one_stream(forward, step):
    draw, rows = random.Random(step), []
    for key in [None, *range(40)]:
        t = 1_700_000_000_000_000 + draw.randrange(10**9)
        for i in range(draw.choice([1, 2, 9, 30])):
            rows.append((key, i, t, draw.choice([0.0, 1.5, 20.0, 1e18, None]) if draw.random() < 0.5 else float(draw.randrange(50))))
            t += draw.choice([0, 1, 3, 40])
    table = pa.table({"f": pa.array([r[0] for r in rows], pa.int64()), "i": [r[1] for r in rows], "arrival_us": [r[2] for r in rows], "w": pa.array([r[3] for r in rows], pa.float64())})
    got = pa.Table.from_batches(win.stream_starts(iter(table.to_batches(max_chunksize=3)), [1, 8], ["f"], "i", "w", forward, ["arrival_us"], step))
    assert got["f"].to_pylist() == [r[0] for r in rows] and got["i"].to_pylist() == [r[1] for r in rows]
    times = {(r[0], r[1]): r[2] for r in rows}
    for k in (1, 8):
        want = brute_starts(rows, k, forward)
        assert got[f"s_w{k}"].to_pylist() == want
        assert got[f"arrival_us_at_w{k}"].to_pylist() == [times.get((r[0], s)) for r, s in zip(rows, want)]


def test_starts_of_flows_far_apart_in_time():
    """Spans whose sum does not fit 62 bits are searched in parts."""
    t = np.array([0, 2**61, 0, 5, 2**61, 0, 2**61], np.int64)
    first = np.array([0, 0, 2, 2, 2, 5, 5])
    assert win.search_starts(t, np.array([0.0, 1, 0, 9, 1, 0, 2.0**62]), first, [1], 1)[0].tolist() == [0, 2, 2, 3, 5, 5]


@pytest.mark.parametrize("name", ["d20_window_errors", "d20_window_errors_all", "d20_global_window", "w_flow_windows_all", "w7_flow_windows_online", "d27_avg_flow_throughput"])
def test_no_python_step_per_flow(spark, sf_dir, name):
    """Flows' windows come from one pass over many flows, and errors are counted once and read back."""
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapGroupsInArrow" not in plan and plan.count("MapInArrow") == (0 if name.startswith("d20") else 1)


class CountedMap:
    """A map state in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        held = self.__dict__["held"]
        self.calls += 1
        work = {"exists": lambda: bool(held), "containsKey": lambda k: k in held, "getValue": lambda k: held[k], "updateValue": held.__setitem__, "removeKey": held.pop, "clear": held.clear, "iterator": lambda: iter(list(held.items()))}
        return work[name]


class Handle:
    def __init__(self, state):
        self.state, self.timers = state, []

    def getMapState(self, *_):
        return self.state

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, ms):
        self.timers.append(ms)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_sends_of_many_flows_take_few_steps_of_state():
    """A batch's state steps are bounded by the slots, not by its packets; flows are told apart, and all is forgotten in time."""
    state = CountedMap()
    trips = online.RoundTrips(["sender_id", "sender_port"], keep_s=60, slots=16)
    trips.init(Handle(state))

    def packets(rows):
        return pd.DataFrame(rows, columns=["sender_id", "sender_port", "direction", "arrival_us", "tsval", "tsecr", "seq", "payload_b", "wire_b"])

    sends = packets([(1, port, 1, 1_000_000 + 10 * v + port, v * 512, None, None, None, None) for port in range(50) for v in range(40)])
    assert list(trips.handleInputRows((0,), iter([sends]), Clock(0))) == [] and state.calls <= 16 + 2
    state.calls = 0
    again = packets([(1, 7, 1, 2_000_000, 3 * 512, None, None, None, None), (1, 7, 0, 2_500_000, None, 3 * 512, 0, 100, 166), (1, 8, 0, 2_500_000, None, 3 * 512, 0, 100, 166), (2, 8, 0, 2_500_000, None, 3 * 512, 0, 100, 166), (1, None, 0, 2_500_000, None, None, 0, 100, 166)])
    rows = pd.concat(trips.handleInputRows((0,), iter([again]), Clock(0)))
    assert [None if x is pd.NA or x != x else x for x in rows["rtt_us"]] == [500_000.0, 1_499_962.0, None, None] and state.calls <= 8
    list(trips.handleExpiredTimer((0,), Clock(61_500), None))
    left = [(k, t) for v in state.held.values() for k, t in zip(v[1], v[-1])]
    assert left == [(7, 2_000_000)]
    list(trips.handleExpiredTimer((0,), Clock(62_000), None))
    assert not state.held


def test_no_task_holds_a_sender(spark, sf_dir):
    """What is one per sender meets its packets in parts, so no shuffle of packets is by sender or epoch alone."""
    plan = entry.queries()["j10_sender_merge"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("_deal" in line for line in joins)


def test_a_sender_keeps_only_what_a_merge_can_reach(monkeypatch):
    """Of many packets per flow and frame few rows are held on, and the merge is that of all packets."""
    monkeypatch.setattr(online, "GATHERED", 50)
    draw, policy = random.Random(3), online.SenderPolicy(4)
    rows = [(port, "features", 1, 6, t, *(draw.random() for _ in online.MERGED)) for port in range(6) for t in sorted(draw.randrange(400 if port else 40) for _ in range(60))]
    draw.shuffle(rows)
    table = pd.DataFrame(rows, columns=["sender_port", "event", "epoch", "n_flows", "arrival_us", *online.MERGED]).sort_values(["sender_port", "arrival_us"], kind="stable", ignore_index=True)
    kept, given, opened, removed = policy.gather(iter([table[i : i + 20] for i in range(0, len(table), 20)]))
    assert len(kept) <= 6 + 4 + 5 and given == {1: 6} and not opened and not removed

    def merged(rows):
        flows = [own.sort_values("arrival_us", kind="stable") for _, own in rows.groupby("sender_port")]
        return policy.merge((1,), 1, [tuple(own[c].tolist() for c in ("arrival_us", *online.MERGED)) for own in flows], None)

    assert merged(kept) == merged(table)


def test_many_flows_of_a_part_take_few_steps_of_state():
    """A part's flows are read, evaluated and written with steps of state that grow with the slots, and are removed by one timer."""

    class Value:
        def __init__(self):
            self.now, self.calls = None, 0

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, x):
            self.now, self.calls = x, self.calls + 1

        def clear(self):
            self.now = None

    class States(Handle):
        def __init__(self):
            self.maps, self.value, self.timers = {"flows": CountedMap(), "buffer": CountedMap()}, Value(), []

        def getMapState(self, name, *_):
            return self.maps[name]

        def getValueState(self, *_):
            return self.value

        def deleteTimer(self, ms):
            self.timers.remove(ms)

    class Fired:
        def getExpiryTimeInMs(self):
            return states.timers[0]

    states, flows = States(), online.Evaluator(["sender_port"], [8], [("rtt_us", 0.1)], smoothing=5, idle_s=60, slots=4)
    flows.init(states)
    rows = pd.DataFrame([(port, 0, k * 1_000_000 + port, k * 100, 100, 166, 50_000.0) for port in range(300) for k in range(20 if port else 3)], columns=["sender_port", "none", "arrival_us", "seq", "payload_b", "wire_b", "rtt_us"])
    out = pd.concat(flows.handleInputRows((0,), iter([rows.sample(frac=1, random_state=1)]), Clock(0)))
    assert len(out) == 299 * 5 and states.maps["flows"].calls <= 3 * 4 and states.value.calls == 1 and len(states.timers) == 1
    assert list(states.maps["buffer"].held) == [(0, 0, 0)]
    gone = pd.concat(flows.handleExpiredTimer((0,), Clock(90_000), Fired()))
    assert set(gone["event"]) == {"removed"} and len(gone) == 300 and not states.maps["flows"].held and not states.maps["buffer"].held and states.value.now is None


def test_averages_of_many_flows_are_those_of_each():
    from flowtally.operators.recurrences import STEPS, ewma_flows, ewma_paths

    rng = np.random.default_rng(5)
    lengths = np.array([1, 7, 0, STEPS + 3, 40])
    heads, x = np.cumsum(lengths) - lengths, rng.random((lengths.sum(), 2))
    x[rng.random(x.shape) < 0.3] = np.nan
    x[rng.random(x.shape) < 0.1] = 0
    alphas, start = np.array([0.1, 0.5]), np.array([[np.nan, 1.0] * 2, [0.0, np.nan] * 2, [3.0, 3.0] * 2, [np.nan, np.nan] * 2, [2.0, 0.0] * 2])
    got = ewma_flows(x, heads, lengths, alphas, start)
    for h, n, e in zip(heads, lengths, start):
        if n:
            np.testing.assert_array_equal(got[h : h + n], ewma_paths(x[h : h + n], alphas, e))


def test_no_python_step_per_flow_in_averages(spark, sf_dir):
    """The averages of many flows come from one pass over them."""
    plan = entry.queries()["w10_all_ewmas"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapGroupsInArrow" not in plan


def test_what_a_step_of_windows_holds_is_small():
    """A long stream leaves in steps of at most 16,384 rows, since wide rows of a step are held several times over."""
    n = 40_000
    table = pa.table({"f": np.arange(n) // 50, "i": np.arange(n) % 50, "arrival_us": np.arange(n), "w": np.ones(n)})
    out = list(win.stream_starts(iter(table.to_batches(max_chunksize=1000)), [8], ["f"], "i", "w", False, []))
    assert max(b.num_rows for b in out) <= 16_384 and sum(b.num_rows for b in out) == n
