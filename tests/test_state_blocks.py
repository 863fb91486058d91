"""What the state of round trips holds of many sends is blocks of numbers, and only what a query asks for travels with its packets."""

from __future__ import annotations

from array import array

import pandas as pd

import __spark_entry__ as entry
from flowtally.streaming import online
from tests.test_many_flows import Clock, CountedMap, Handle


def packets(rows):
    return pd.DataFrame(rows, columns=["a", "b", "direction", "arrival_us", "tsval", "tsecr"])


def test_sends_lie_in_blocks_and_unknown_keys_come_back():
    state = CountedMap()
    trips = online.RoundTrips(["a", "b"], keep_s=60, slots=4, carry=[])
    trips.init(Handle(state))
    keys = [(1, 0), (1, None), (None, 0), (None, None)]
    sends = [(*key, 1, 1_000_000 + 1000 * i + v, v, None) for i, key in enumerate(keys) for v in range(20)]
    assert list(trips.handleInputRows((0,), iter([packets(sends)]), Clock(0))) == []
    assert state.held and all(isinstance(c, array) for row in state.held.values() for c in row)
    asked = [(*key, 0, 2_000_000, None, 7) for key in keys] + [(0, 0, 0, 2_000_000, None, 7)]
    rows = pd.concat(trips.handleInputRows((0,), iter([packets(asked)]), Clock(0)))
    assert list(rows.columns) == ["a", "b", "arrival_us", "tsecr", "rtt_us"]
    # Flows of whose key nothing is known are told apart from those of key 0.
    assert [None if x is pd.NA or x != x else x for x in rows["rtt_us"]] == [1_000_000.0 - 1000 * i - 7 for i in range(4)] + [None]
    list(trips.handleExpiredTimer((0,), Clock(61_002), None))
    left = sorted(t for row in state.held.values() for t in row[-1])
    assert left == [1_003_000 + v for v in range(20)] and all(isinstance(c, array) for row in state.held.values() for c in row)


def test_what_a_query_leaves_out_does_not_travel(spark, sf_dir):
    seen = []
    run = online.round_trips
    try:
        online.round_trips = lambda *a, **k: seen.append(run(*a, **k)) or seen[-1]
        rows = entry.queries()["j1_stream_rtt_all"](spark, sf_dir)
    finally:
        online.round_trips = run
    assert seen[0].columns == ["sender_port", "arrival_us", "tsecr", "rtt_us"] and rows.columns == ["sender_port", "arrival_us", "tsecr", "rtt_us"]
