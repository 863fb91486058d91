"""From raw live packets to decisions: chained keyed state with timers.

``round_trips`` remembers, for parts of all flows, when each TSval of a flow was last sent and gives every received packet
its RTT, or none.  ``decide_live`` buffers a flow's packets: a flow that is ready (``smoothing``
packets, and the longest window before them has passed since its first packet) is evaluated
once ``enough`` packets wait or ``wait_s`` has passed since it became ready.  Its
buffer is cut to what the longest window of the last ``smoothing`` packets needs, the
features of these packets are emitted, the EWMAs go on from where the last evaluation ended, the
mean ratio of measured to modelled throughput gives the label, the label and the decision
before give the next decision, and the buffer is cleared.  Windows follow the online rules: a
start is at most the packet before, and a window counts if its whole width lies after the
buffer's first packet.  ``decide_senders`` gathers the evaluated flows of a sender.

Time.  The watermark comes from ``ts``, which is dropped right behind it (``watched``): Spark then
hands over rows of any age instead of dropping those behind the watermark, and the state
functions see the watermark and set timers by it.  So packets in = packets buffered + packets in
"late" rows, whatever the lateness.  ``clock="ProcessingTime"`` takes the wall clock instead.

State.  Flows are dealt to parts, and what changes with every packet is small and lies in a few rows for all flows
of a part; the packets of a flow that waits are added to its newest row, or to a new one if that is long.  A flow idle for ``idle_s`` leaves a "removed" row and no state,
also one that is already that far behind when its packets come.  A flow that is never
ready keeps its newest ``most`` to 2 ``most`` packets; a "trimmed" row counts what it lets go.

Cases: packets older than what was seen of their flow are left out and counted in a "late" row; a
flow without an RTT is never ready; a null RTT, a payload of 0 or an unknown ratio leaves the
label out, and a flow without a label keeps its decision; repeated packets count each; an
empty batch changes nothing.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtally.functions.registry import ewma_name
from flowtally.functions.unknown import FAIR_BAND, MATHIS_C, MIN_RWND_B, MSS_B
from flowtally.operators.recurrences import LossEvents, ewma_flows, gap_losses
from flowtally.streaming.flows import IDLE_S, NOT_PACED, PACED, SMOOTHING, decide

FLOW_STATE = "first_us long, newest_us long, min_rtt_us double, evaluations long, last_seq long, last_payload long, highest_seq long, event_starts array<double>, event_sizes array<long>, ewmas array<double>, paced_bps double, decision int, rwnd_b long, waiting long, recent array<long>, due_ms long, timer_ms long, chunks int, tail int"
# Bits for the columns of a key that are unknown.
NONE = "none"
CHUNK = "arrivals array<long>, wires array<long>, payloads array<long>, rtts array<double>, losses array<long>, rates array<double>"
KINDS = (np.int64, np.int64, np.int64, float, np.int64, float)
CHUNKED = 1024
MOST = 1 << 17
WHOLE = ("arrival_us", "seq", "payload_b", "wire_b")
METRICS = ("interarrival_us", "tput_bps", "rtt_us", "loss_rate", "mathis_tput_bps")


def ratio(above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """above / below; unknown (NaN) over 0, infinite or unknown values."""
    ok = np.isfinite(below) & (below != 0)
    return np.where(ok, above / np.where(ok, below, 1), np.nan)


def mathis(payload: np.ndarray, rtt: np.ndarray, loss: np.ndarray) -> np.ndarray:
    return ratio(8e6 * payload * MATHIS_C, rtt * np.sqrt(np.where(loss > 0, loss, np.nan)))


def packet_values(arrival: np.ndarray, payload: np.ndarray, rtt: np.ndarray, lost: np.ndarray, low: float) -> dict[str, np.ndarray]:
    """The regular features of a buffer's packets; two packets at one time count as 1 us apart."""
    gap = np.maximum(np.diff(arrival, prepend=np.nan), 1)
    loss = lost / (lost + 1)
    return {
        "interarrival_us": gap,
        "inv_interarrival_bps": ratio(8e6 * payload, gap),
        "rtt_us": rtt,
        "rtt_ratio": ratio(rtt, np.full(len(rtt), low)),
        "loss_rate": loss,
        "inv_sqrt_loss_rate": np.where(loss > 0, 1 / np.sqrt(np.where(loss > 0, loss, 1)), 1.0),
        "mathis_tput_bps": mathis(payload, rtt, loss),
    }


def window_values(at: np.ndarray, k: int, arrival: np.ndarray, wire: np.ndarray, payload: np.ndarray, rtt: np.ndarray, lost: np.ndarray, low: float) -> dict[str, np.ndarray]:
    """The windowed features of width k * ``low`` that end at the packets ``at`` (above 0) of a buffer."""
    start = np.minimum(np.searchsorted(arrival, arrival[at] - k * low), at - 1)
    whole = lambda x: np.where(arrival[at] - arrival[0] >= k * low, x, np.nan)
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    between = lambda x: total(x)[at + 1] - total(x)[start + 1]
    n, span = (at - start).astype(float), (arrival[at] - arrival[start]).astype(float)
    seen = np.isfinite(rtt)
    rtts = total(np.where(seen, rtt, 0))[at + 1] - total(np.where(seen, rtt, 0))[start]
    loss = whole(between(lost) / (between(lost) + n))
    return {
        "interarrival_us": whole(span / n),
        "tput_bps": whole(ratio(between(wire) * 8e6, span)),
        "rtt_us": whole(ratio(rtts, (total(seen)[at + 1] - total(seen)[start]).astype(float))),
        "loss_rate": loss,
        "mathis_tput_bps": mathis(payload[at], rtt[at], loss),
    }


def output_fields(key: list[str], windows: list[int], ewmas: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """Names and types of the rows that a flow emits."""
    return [
        *((c, "long") for c in key), ("event", "string"), ("arrival_us", "long"), ("packets", "long"), ("min_rtt_us", "double"), ("loss_event_rate", "double"),
        *((f"{m}_w{k}", "double") for k in windows for m in METRICS), *((ewma_name(m, a), "double") for m, a in ewmas),
        ("label", "int"), ("decision", "int"), ("target_bps", "double"), ("rwnd_b", "long"), ("changed", "boolean"),
    ]


def class_of(x: float) -> int | None:
    """0 below, 1 near, 2 above the fair share; None for an unknown ratio."""
    return None if not np.isfinite(x) else 0 if x < 1 - FAIR_BAND else 1 if x <= 1 + FAIR_BAND else 2


def typed(rows: pd.DataFrame, fields: list[tuple[str, str]]) -> pd.DataFrame:
    """Columns in nullable types, with NaN as null."""
    kinds = {"long": np.int64, "int": np.int32, "double": np.float64, "boolean": np.bool_}
    made = {"double": pd.arrays.FloatingArray, "boolean": pd.arrays.BooleanArray}
    out = {}
    for n, k in fields:
        if k == "string":
            out[n] = pd.array(rows[n], dtype="string")
        else:
            unknown = rows[n].isna().to_numpy()
            values = rows[n].to_numpy(object) if rows[n].dtype == object or unknown.any() else rows[n].to_numpy()
            out[n] = made.get(k, pd.arrays.IntegerArray)(np.where(unknown, 0, values).astype(kinds[k]), unknown)
    return pd.DataFrame(out)


def typed_blocks(blocks: list[dict[str, Any]], fields: list[tuple[str, str]]) -> pd.DataFrame:
    """Blocks of columns, one below the other; numbers with a fraction carry NaN for null, which Spark reads as such."""
    kinds, out = {"long": np.int64, "int": np.int32, "boolean": np.bool_}, {}
    for n, k in fields:
        if k == "double":
            out[n] = np.concatenate([np.asarray(b[n], float) for b in blocks])
            continue
        values = [x for b in blocks for x in (b[n].tolist() if isinstance(b[n], np.ndarray) else b[n])]
        if k == "string":
            out[n] = np.array(values, object)
            continue
        unknown = np.array([x is None or x != x for x in values])
        array = pd.arrays.BooleanArray if k == "boolean" else pd.arrays.IntegerArray
        out[n] = array(np.array([0 if u else x for x, u in zip(values, unknown.tolist())], kinds[k]), unknown)
    return pd.DataFrame(out)


def watched(stream: DataFrame, late: str) -> DataFrame:
    """The stream with a watermark by ``ts``, without the column, so that no row is dropped for its age."""
    return stream.withWatermark("ts", late).drop("ts")


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def in_order(frames: Iterator[pd.DataFrame], key: list[str], columns: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys and columns (NaN: null) of a batch's packets, by flow and in order of time."""
    parts = list(frames)
    whole = lambda c: np.concatenate([p[c].to_numpy(np.int64) for p in parts])
    keys, given = [whole(c) for c in key], [whole(c) if c in WHOLE else np.concatenate([p[c].to_numpy(float, na_value=np.nan) for p in parts]) for c in columns]
    # Unknown TSvals last.
    ties = [np.concatenate([p["tsecr"].to_numpy(float, na_value=np.inf) for p in parts])] if "tsecr" in parts[0] else []
    order = np.lexsort([*ties, given[columns.index("arrival_us")], *keys[::-1]])
    return [k[order] for k in keys], [x[order] for x in given]


# Round trips --------------------------------------------------------------------------

RECEIVED, SENT = 0, 1
CARRIED = ["seq", "payload_b", "wire_b"]


def longs(values: np.ndarray) -> array:
    """Whole numbers as one block of bytes, which goes to the state as it is; a list is pickled number by number."""
    return array("l", np.ascontiguousarray(values, np.int64).tobytes())


def trip_fields(key: list[str], carry: list[str]) -> list[tuple[str, str]]:
    """Names and types of what ``round_trips`` gives."""
    return [*((c, "long") for c in [*key, "arrival_us", "tsecr", *carry]), ("rtt_us", "double")]


class RoundTrips(StatefulProcessor):
    """For a part of the flows, when each flow last sent each TSval; one row for each received packet.

    All flows of a part are matched at once.  What they sent lies in ``slots`` rows of the state by TSval,
    so a batch reads and writes at most that many rows, however many packets it brings.  A row is blocks of numbers;
    ``NONE`` marks unknown keys.
    """

    def __init__(self, key: list[str], keep_s: float, slots: int, carry: list[str] = CARRIED) -> None:
        self.key, self.keep_ms, self.slots = key, int(keep_s * 1000), slots
        self.names, self.fields = [*key, NONE, "tsval", "sent_us"], trip_fields(key, carry)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "slot int", ", ".join(f"{c} array<long>" for c in self.names))

    def slot(self, tsvals: pd.Series) -> np.ndarray:
        v = tsvals.to_numpy(np.int64)
        return (v ^ (v >> 7) ^ (v >> 14)) % self.slots

    def frame(self, values: list[tuple]) -> pd.DataFrame:
        """Sends of some slots."""
        held = {n: np.concatenate([np.zeros(0, np.int64), *(np.asarray(v[i], np.int64) for v in values)]) for i, n in enumerate(self.names)}
        none = held.pop(NONE)
        unknown = {c: none >> i & 1 == 1 for i, c in enumerate(self.key)}
        return pd.DataFrame({n: pd.arrays.IntegerArray(x, unknown.get(n, np.zeros(len(x), bool))) for n, x in held.items()})

    def remembered(self, tsvals: pd.Series) -> pd.DataFrame:
        """What is held in the slots of these TSvals."""
        slots = np.unique(self.slot(tsvals))
        return self.frame([self.sent.getValue((int(v),)) for v in slots if self.sent.containsKey((int(v),))])

    def remember(self, sends: pd.DataFrame) -> None:
        """Writes the slots of ``sends``, which holds all that they held before."""
        sends = sends.assign(slot=self.slot(sends["tsval"])).sort_values("slot", kind="stable")
        slot = sends["slot"].to_numpy()
        starts = np.flatnonzero(np.diff(slot, prepend=-1))
        held = {n: sends[n].to_numpy(np.int64, na_value=0) for n in self.names if n != NONE}
        held[NONE] = sum(sends[c].isna().to_numpy().astype(np.int64) << i for i, c in enumerate(self.key))
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(slot)]):
            self.sent.updateValue((int(slot[i]),), tuple(longs(held[n][i:j]) for n in self.names))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values("arrival_us", kind="stable", ignore_index=True)
        batch = batch.astype({c: "Int64" for c in [*self.key, "tsval", "tsecr"]})
        fresh, by = not self.sent.exists(), [*self.key, "tsval"]
        got = batch[batch["direction"] == RECEIVED].reset_index(drop=True)
        sends = batch.loc[(batch["direction"] == SENT) & batch["tsval"].notna(), [*by, "arrival_us"]].reset_index(drop=True)
        echoes = got.loc[got["tsecr"].notna(), [*self.key, "tsecr", "arrival_us"]].rename(columns={"tsecr": "tsval"})
        echoes = echoes.rename_axis("at").reset_index()
        # The last send before the packet: of this batch, else the one remembered.
        both = pd.concat([echoes[by], sends[by]])
        same = both.groupby(by, dropna=False, sort=False).ngroup().to_numpy()
        times = pd.DataFrame({"arrival_us": sends["arrival_us"].to_numpy(np.int64), "_same": same[len(echoes) :]})
        times["sent_us"] = times["arrival_us"].astype(float)
        asked = pd.DataFrame({"arrival_us": echoes["arrival_us"].to_numpy(np.int64), "_same": same[: len(echoes)]})
        start = pd.merge_asof(asked, times, on="arrival_us", by="_same", allow_exact_matches=False)["sent_us"].to_numpy(float)
        if not fresh:
            unmet = np.flatnonzero(np.isnan(start))
            known = echoes.iloc[unmet][by].merge(self.remembered(echoes["tsval"].iloc[unmet]), on=by, how="left")
            start[unmet] = known["sent_us"].to_numpy(float, na_value=np.nan)
        rtt = echoes["arrival_us"].to_numpy(float) - start
        rtts = np.full(len(got), np.nan)
        rtts[echoes["at"].to_numpy(np.int64)] = np.where(rtt > 0, rtt, np.nan)
        if len(sends):
            new = sends.rename(columns={"arrival_us": "sent_us"}).astype({"sent_us": "Int64"})
            held = new if fresh else pd.concat([self.remembered(new["tsval"]), new])
            self.remember(held.groupby(by, dropna=False, sort=False)["sent_us"].max().reset_index())
            if not any(True for _ in self.handle.listTimers()):
                self.handle.registerTimer(int(sends["arrival_us"].min() // 1000) + self.keep_ms)
        if len(got):
            yield typed(got.assign(rtt_us=rtts), self.fields)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Forgets what was sent longer than ``keep_s`` before the watermark; looks again when the oldest of the rest is due."""
        now, oldest, gone = timerValues.getCurrentWatermarkInMs(), None, []
        for (slot,), values in list(self.sent.iterator()):
            sent_us = np.asarray(values[-1], np.int64)
            kept = np.flatnonzero(sent_us // 1000 + self.keep_ms > now)
            if not len(kept):
                gone.append(slot)
                continue
            if len(kept) < len(sent_us):
                self.sent.updateValue((slot,), tuple(longs(np.asarray(v, np.int64)[kept]) for v in values))
            least = int(sent_us[kept].min())
            oldest = least if oldest is None else min(oldest, least)
        if oldest is None:
            self.sent.clear()
        else:
            for slot in gone:
                self.sent.removeKey((slot,))
            self.handle.registerTimer(oldest // 1000 + self.keep_ms)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def round_trips(packets: DataFrame, key: list[str] = ["sender_port"], keep_s: float = 3600, parts: int = 256, slots: int = 128, carry: list[str] = CARRIED) -> DataFrame:
    """Every received packet with the time since the last send before it of the TSval it echoes, null without one.

    ``packets`` is a ``watched`` stream of both directions: key, direction (0 received, 1 sent), arrival_us,
    tsval, tsecr, and what a received packet carries on (``carry``).  Sends are remembered until ``keep_s`` behind the watermark.
    A packet that comes in an earlier batch than a send before it has no RTT from it.
    Flows are dealt to ``parts`` keys of the state; neither number may change while a stream has state.
    """
    schema = ", ".join(f"{n} {k}" for n, k in trip_fields(key, carry))
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")
    rows = packets.select(part, *key, "direction", "arrival_us", "tsval", "tsecr", *carry)
    return rows.groupBy("part").transformWithStateInPandas(RoundTrips(key, keep_s, slots, carry), schema, "Append", "EventTime", eventTimeColumnName="")


# Flows --------------------------------------------------------------------------------


class Evaluator(StatefulProcessor):
    """The flows of a part; ``judge`` is the window (one of ``windows``) whose ratio gives the label.

    A flow is told by its key and ``NONE``, which marks unknown keys.  The small state of all flows of a part lies in ``slots`` rows
    and there is one timer, for the first flow that is due, so steps of state grow with the slots and not with the flows.
    A flow's packets are stored only while they wait, in rows of ``CHUNKED`` packets at least but for the newest.
    """

    def __init__(self, key: list[str], windows: list[int], ewmas: list[tuple[str, float]], smoothing: int = SMOOTHING, idle_s: float = IDLE_S, strategy: str = "aimd", judge: int = 8, enough: int = 0, wait_s: float = 0.1, most: int = MOST, announce: bool = False, clock: str = "EventTime", slots: int = 32) -> None:
        self.key, self.windows, self.ewmas, self.smoothing, self.idle_ms = key, windows, ewmas, smoothing, int(idle_s * 1000)
        self.strategy, self.judge, self.enough, self.wait_ms, self.most, self.announce, self.clock = strategy, judge, enough, int(wait_s * 1000), most, announce, clock
        self.slots, self.flow_key = slots, [*key, NONE]
        self.fields = output_fields(key, windows, ewmas)
        self.names = [n for n, _ in self.fields]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        flow = ", ".join(f"{c}: long" for c in self.flow_key) + ", " + ", ".join(": ".join(x.split()) for x in FLOW_STATE.split(", "))
        self.flows = handle.getMapState("flows", "slot int", f"flows array<struct<{flow}>>")
        self.buffer = handle.getMapState("buffer", ", ".join(f"{c} long" for c in self.flow_key) + ", n int", CHUNK)
        self.due = handle.getValueState("due", "timer_ms long, slots array<long>")

    def slot(self, keys: list[np.ndarray]) -> np.ndarray:
        v = np.zeros(len(keys[0]), np.int64)
        for k in keys:
            v = v * 1_000_003 + k
        return (v ^ (v >> 7) ^ (v >> 14)) % self.slots

    def load(self, slots: Iterable[int], fresh: bool) -> dict[int, dict[tuple, dict]]:
        """The flows of some slots: what is held of each, by flow."""
        names, n, out = names_of(FLOW_STATE), len(self.flow_key), {}
        for s in slots:
            rows = self.flows.getValue((s,))[0] if not fresh and self.flows.containsKey((s,)) else []
            out[s] = {tuple(r[:n]): dict(zip(names, r[n:])) for r in rows}
        return out

    def keep(self, loaded: dict[int, dict[tuple, dict]], timer: int | None, due: list[int | None]) -> None:
        """Writes the slots, and sets the timer to the first time at which a flow is due."""
        names = names_of(FLOW_STATE)
        for s, flows in loaded.items():
            if flows:
                self.flows.updateValue((s,), ([(*flow, *(held[n] for n in names)) for flow, held in flows.items()],))
            elif due[s] is not None:
                self.flows.removeKey((s,))
            due[s] = min((held["timer_ms"] for held in flows.values()), default=None)
        first = min((t for t in due if t is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if first is None:
            self.due.clear()
        else:
            self.due.update((first, due))

    def known(self, flow: tuple) -> list[int | None]:
        """The key of a flow, with None for what is unknown."""
        return [None if flow[-1] >> i & 1 else x for i, x in enumerate(flow[:-1])]

    def plain(self, flow: tuple, event: str, packets: int, held: dict) -> dict[str, list]:
        """One row, as columns."""
        values = dict(zip(self.key, self.known(flow))) | {"event": event, "arrival_us": held["newest_us"], "packets": packets, "min_rtt_us": held["min_rtt_us"]}
        return {n: [values.get(n)] for n in self.names}

    def waiting(self, flow: tuple, held: dict, fresh: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """The whole buffer, as arrays in the order of ``CHUNK``, with packets that are not stored yet; what is stored goes."""
        chunks = [self.buffer.getValue((*flow, n)) for n in range(held["chunks"])]
        self.forget(flow, held)
        return [np.concatenate([np.zeros(0, kind), *(np.asarray(c[i], kind) for c in chunks), *([] if fresh is None else [fresh[i]])]) for i, kind in enumerate(KINDS)]

    def forget(self, flow: tuple, held: dict) -> None:
        for n in range(held["chunks"]):
            self.buffer.removeKey((*flow, n))
        held["chunks"] = held["tail"] = 0

    def store(self, flow: tuple, held: dict, packets: list[np.ndarray]) -> None:
        """Packets join the newest row of their flow while it is short, else they are a new one."""
        added = [x.tolist() for x in packets]
        if 0 < held["tail"] < CHUNKED:
            added = [[*a, *b] for a, b in zip(self.buffer.getValue((*flow, held["chunks"] - 1)), added)]
        else:
            held["chunks"] += 1
        self.buffer.updateValue((*flow, held["chunks"] - 1), tuple(added))
        held["tail"] = len(added[0])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        keys, values = in_order(rows, self.flow_key, [*WHOLE, "rtt_us"])
        starts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        slots = self.slot([k[starts] for k in keys]).tolist()
        fresh = not self.due.exists()
        timer, due = (None, [None] * self.slots) if fresh else self.due.get()
        loaded, out, ready = self.load(sorted(set(slots)), fresh), [], []
        for i, j, s, flow in zip(starts.tolist(), [*starts[1:].tolist(), len(keys[0])], slots, zip(*(k[starts].tolist() for k in keys))):
            held = loaded[s].setdefault(flow, dict.fromkeys(names_of(FLOW_STATE)) | {"evaluations": 0, "highest_seq": 0, "waiting": 0, "recent": [], "chunks": 0, "tail": 0})
            self.take(flow, held, [x[i:j] for x in values], timerValues, out, ready)
        out += self.evaluate(ready)
        self.keep(loaded, timer, list(due))
        if out:
            yield typed_blocks(out, self.fields)

    def take(self, flow: tuple, held: dict, packets: list[np.ndarray], timerValues: Any, out: list[dict], ready: list[tuple]) -> None:
        """A flow's packets of a batch in order of time: losses, minimum RTT, and whether the flow is to be evaluated now."""
        newest = held["newest_us"]
        late = 0 if newest is None else int(np.searchsorted(packets[0], newest))
        t, seq, b, wire, rtt = (x[late:] for x in packets)
        if late:
            out.append(self.plain(flow, "late", late, held))
        mine = None
        if len(t):
            events = [[a, n] for a, n in zip(held["event_starts"] or [], held["event_sizes"] or [])]
            tracker, lost, rates = LossEvents(events=events or None), np.zeros(len(t), np.int64), np.zeros(len(t))
            joined = lambda last, x: x if newest is None else np.concatenate([[last], x])
            gaps, high = gap_losses(joined(held["last_seq"], seq), joined(held["last_payload"], b), highest=held["highest_seq"])
            lost[len(t) - len(gaps) :] = gaps
            rates[len(t) - len(gaps) :] = tracker.follow(gaps, joined(newest, t), joined(-1.0, np.nan_to_num(rtt, nan=-1.0)))[:, 0]
            mine = [t, wire, b, rtt, lost, rates]
            low = np.min(np.where(rtt > 0, rtt, np.inf), initial=np.inf if held["min_rtt_us"] is None else held["min_rtt_us"])
            held |= {"first_us": int(t[0]) if newest is None else held["first_us"], "newest_us": int(t[-1]), "min_rtt_us": float(low) if np.isfinite(low) else None, "last_seq": int(seq[-1]), "last_payload": int(b[-1]), "highest_seq": int(high)}
            held |= {"event_starts": [float(a) for a, _ in tracker.events], "event_sizes": [int(n) for _, n in tracker.events], "waiting": held["waiting"] + len(t), "recent": [*held["recent"], *t[-self.smoothing :].tolist()][-self.smoothing :]}
            if newest is None and self.announce:
                out.append(self.plain(flow, "open", len(t), held))
        now = timerValues.getCurrentProcessingTimeInMs() if self.clock == "ProcessingTime" else held["newest_us"] // 1000
        if self.ready(held) and held["waiting"] >= self.enough:
            ready.append((flow, held, self.waiting(flow, held, mine)))
            # The evaluation that was due is this one.
            held["due_ms"] = None
        else:
            if self.ready(held):
                held["due_ms"] = now + self.wait_ms if held["due_ms"] is None else held["due_ms"]
            elif held["waiting"] > 2 * self.most:
                mine = [x[-self.most :] for x in self.waiting(flow, held, mine)]
                out.append(self.plain(flow, "trimmed", held["waiting"] - self.most, held))
                held["waiting"] = self.most
            if mine:
                self.store(flow, held, mine)
        self.settle(held, now + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        wall, out, ready, gone = self.clock == "ProcessingTime", [], [], []
        clock = timerValues.getCurrentProcessingTimeInMs() if wall else timerValues.getCurrentWatermarkInMs()
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), clock - 1)
        if self.due.exists():
            _, due = self.due.get()
            loaded = self.load([s for s, t in enumerate(due) if t is not None and t <= upto], False)
            for s, flows in loaded.items():
                for flow, held in flows.items():
                    if held["timer_ms"] > upto:
                        continue
                    now = clock if wall else held["newest_us"] // 1000
                    idle = held["due_ms"] is None or (not wall and clock >= now + self.idle_ms)
                    if held["due_ms"] is not None and held["timer_ms"] >= held["due_ms"]:
                        ready.append((flow, held, self.waiting(flow, held)))
                        held["due_ms"] = None
                    if idle:
                        gone.append((s, flow, held))
                    else:
                        self.settle(held, now + self.idle_ms)
            out = self.evaluate(ready)
            for s, flow, held in gone:
                self.forget(flow, held)
                out.append(self.plain(flow, "removed", held["evaluations"], held))
                del loaded[s][flow]
            # The timer that fired is gone by itself.
            self.keep(loaded, None, list(due))
        yield typed_blocks(out, self.fields) if out else pd.DataFrame()

    def close(self) -> None:
        pass

    def settle(self, held: dict, idle_ms: int) -> None:
        """The time at which the flow is looked at again: for the evaluation that is due or else for its end."""
        held["timer_ms"] = idle_ms if held["due_ms"] is None else min(idle_ms, held["due_ms"])

    def ready(self, held: dict) -> bool:
        return held["waiting"] > self.smoothing and held["min_rtt_us"] is not None and held["recent"][0] - held["first_us"] >= held["min_rtt_us"] * max(self.windows)

    def evaluate(self, ready: list[tuple]) -> list[dict[str, Any]]:
        """Features, label and decision of ready flows, whose buffers end here; the averages of all of them are followed together."""
        n, cut, values = self.smoothing, [], []
        for _, held, buffer in ready:
            arrival, low = buffer[0], held["min_rtt_us"]
            keep = min(int(np.searchsorted(arrival, arrival[-n] - low * max(self.windows))), len(arrival) - n - 1)
            arrival, wire, payload, rtts, losses, rates = (x[keep:] for x in buffer)
            cut.append((arrival, wire, payload, rtts, losses, rates))
            own = packet_values(arrival, payload, rtts, losses, low)
            values.append(np.column_stack([own[m] for m, _ in self.ewmas]) if self.ewmas else np.zeros((len(arrival), 0)))
        if not ready:
            return []
        lengths = np.array([len(x) for x in values])
        heads = np.cumsum(lengths) - lengths
        held_on = np.array([[np.nan if x is None else x for x in held["ewmas"] or [None] * len(self.ewmas)] for _, held, _ in ready], float).reshape(len(ready), len(self.ewmas))
        x = np.concatenate(values)
        paths = np.hstack([np.zeros((len(x), 0)), *(ewma_flows(x[:, [i]], heads, lengths, np.array([a]), held_on[:, [i]]) for i, (_, a) in enumerate(self.ewmas))])
        out = []
        for (flow, held, _), (arrival, wire, payload, rtts, losses, rates), head in zip(ready, cut, heads.tolist()):
            at, low, path = np.arange(len(arrival) - n, len(arrival)), held["min_rtt_us"], paths[head : head + len(arrival)]
            block = {c: [v] * n for c, v in zip(self.key, self.known(flow))} | {"event": ["features"] * n, "arrival_us": arrival[at], "packets": np.full(n, len(arrival)), "min_rtt_us": np.full(n, low), "loss_event_rate": rates[at]}
            for k in self.windows:
                block |= {f"{m}_w{k}": x for m, x in window_values(at, k, arrival, wire, payload, rtts, losses, low).items()}
            block |= {ewma_name(m, a): path[at, i] for i, (m, a) in enumerate(self.ewmas)}
            shares = ratio(block[f"tput_bps_w{self.judge}"], block[f"mathis_tput_bps_w{self.judge}"])
            label = class_of(float(np.mean(shares[np.isfinite(shares)])) if np.isfinite(shares).any() else np.nan)
            measured, paced = block[f"tput_bps_w{self.judge}"][-1], held["paced_bps"]
            if label is not None and np.isfinite(measured):
                paced = decide(label, float(measured), paced, self.strategy)
            chosen = NOT_PACED if paced is None else PACED
            size = None if paced is None else max(int(np.round(paced / 8 * low / 1e6)), MIN_RWND_B)
            out.append(block | {"label": [label] * n, "decision": [chosen] * n, "target_bps": [paced] * n, "rwnd_b": [size] * n, "changed": [(chosen, size) != (held["decision"], held["rwnd_b"])] * n})
            held |= {"paced_bps": paced, "decision": chosen, "rwnd_b": size, "evaluations": held["evaluations"] + 1, "ewmas": [float(x) if np.isfinite(x) else None for x in path[-1]], "waiting": 0, "recent": [], "due_ms": None}
        return out


def decide_live(stream: DataFrame, windows: list[int] = [8], ewmas: list[tuple[str, float]] = [("rtt_us", 0.1), ("interarrival_us", 0.1)], late: str | None = "1 minute", key: list[str] = ["sender_port"], parts: int = 256, **options) -> DataFrame:
    """Features, labels and decisions of live flows; the stream has the key, arrival_us, seq, payload_b, wire_b, rtt_us (null: none)
    and ``ts``, unless ``late`` is None: then it is ``watched`` already, as what ``round_trips`` gives is.
    Flows are dealt to ``parts`` keys of the state; the number may not change while a stream has state."""
    evaluator = Evaluator(key, windows, ewmas, **options)
    rows = stream if late is None else watched(stream, late)
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")
    none = reduce(add, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(key)]).cast("long").alias(NONE)
    others = [c for c in [*WHOLE, "rtt_us", "tsecr"] if c in rows.columns]
    dealt = rows.select(part, *[F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in key], none, *others)
    return dealt.groupBy("part").transformWithStateInPandas(evaluator, ", ".join(f"{n} {k}" for n, k in evaluator.fields), "Append", evaluator.clock, eventTimeColumnName="")


# Senders ------------------------------------------------------------------------------

MERGED = {"rtt_us": np.nanmean, "loss_event_rate": np.nanmin, "loss_rate": np.nanmean, "tput_bps": np.nansum, "min_rtt_us": np.nanmin}
GATHERED = 100_000
SENDER_FIELDS = [("sender_id", "long"), ("epoch", "long"), ("arrival_us", "long"), *((c, "double") for c in MERGED), ("mathis_bps", "double"), ("n_flows", "long"), ("target_bps", "double"), ("rwnd_b", "long"), ("changed", "boolean")]


class SenderPolicy(StatefulProcessor):
    """The evaluated flows of a sender wait for each other; a complete epoch is merged and decided."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.room = handle.getValueState("room", "epoch long, rwnd_b long, done long")
        self.flows = handle.getMapState("flows", "sender_port long", "newest_us long")
        self.waiting = handle.getMapState("waiting", "sender_port long", "arrivals array<long>, " + ", ".join(f"{c} array<double>" for c in MERGED))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        epoch, size, done = self.room.get() if self.room.exists() else (None, None, None)
        features, given, opened, removed = self.gather(rows)
        for port, newest in opened.items():
            self.flows.updateValue((port,), (newest,))
        for port in removed:
            self.flows.removeKey((port,))
        out = []
        for e in sorted(given):
            if (epoch is not None and e < epoch) or (done is not None and e < done):
                continue
            if e != epoch:
                self.waiting.clear()
                held = {}
            else:
                held = {port: values for (port,), values in self.waiting.iterator()}
            epoch, new = e, {}
            for port, own in features[features["epoch"] == e].groupby("sender_port"):
                new[int(port)] = (own["arrival_us"].astype(int).tolist(), *(own[c].to_numpy(float, na_value=np.nan).tolist() for c in MERGED))
            held |= new
            expected = int(given[e]) if given[e] == given[e] and given[e] is not None else sum(1 for _ in self.flows.keys())
            if held and len(held) >= expected:
                rows_, size = self.merge(key, epoch, [held[port] for port in sorted(held)], size)
                out += rows_
                self.waiting.clear()
                epoch, done = None, e
            else:
                for port, values in new.items():
                    self.waiting.updateValue((port,), values)
        self.room.update((epoch, size, done))
        if out:
            yield typed(pd.DataFrame(out, columns=[n for n, _ in SENDER_FIELDS]), SENDER_FIELDS)
        else:
            yield pd.DataFrame()

    def gather(self, frames: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, dict[int, float], dict[int, int], set[int]]:
        """A batch frame by frame: the rows of flows that a merge can reach, in order of time, each epoch's number of flows, and the flows opened and removed."""
        kept, waiting, given, opened, removed = None, [], {}, {}, set()
        for frame in frames:
            for port, newest in frame[frame["event"] == "open"].groupby("sender_port")["arrival_us"].max().items():
                opened[int(port)] = max(opened.get(int(port), int(newest)), int(newest))
            removed |= set(frame["sender_port"][frame["event"] == "removed"])
            features = frame[frame["event"] == "features"]
            for e, n in features.groupby("epoch")["n_flows"].max().items():
                known = [x for x in (given.get(int(e)), n) if x is not None and x == x]
                given[int(e)] = max(known) if known else np.nan
            waiting.append(features[features["sender_port"].notna()])
            if sum(map(len, waiting)) > max(GATHERED, 0 if kept is None else len(kept)):
                kept, waiting = self.reachable([*([] if kept is None else [kept]), *waiting]), []
        return self.reachable([*([] if kept is None else [kept]), *waiting]), given, opened, removed

    def reachable(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Per epoch the rows from the ``window``-th last time on and of each flow the last one before it: later rows only move that time on."""
        rows = pd.concat(parts, ignore_index=True).sort_values("arrival_us", kind="stable")
        out = [rows[:0]]
        for _, own in rows.groupby("epoch"):
            t = own["arrival_us"].to_numpy(np.int64)
            late = t >= t[max(len(t) - self.window, 0)]
            out += [own[~late].groupby("sender_port").tail(1), own[late]]
        return pd.concat(out)

    def merge(self, key: Any, epoch: int, held: list[tuple], size: int | None) -> tuple[list[tuple], int | None]:
        """Rows at the last ``window`` times of all flows, with the decision of the last one, and its window."""
        times = np.sort(np.concatenate([np.asarray(f[0], np.int64) for f in held]))[-self.window :]
        columns = {}
        for i, (c, how) in enumerate(MERGED.items()):
            at = np.array([np.interp(times, np.asarray(f[0], float), np.array([np.nan if x is None else x for x in f[i + 1]], float)) for f in held])
            known = np.isfinite(at).any(axis=0)
            columns[c] = np.where(known, how(np.where(known, at, 0.0), axis=0), np.nan)
        model = lambda loss: ratio(8e6 * MSS_B * MATHIS_C, columns["rtt_us"] * np.sqrt(np.where(loss > 0, loss, np.nan)))
        columns["mathis_bps"] = model(columns["loss_event_rate"])
        softened = columns["loss_event_rate"] / (4 + 5e4 * columns["loss_event_rate"])
        rate = model(softened)[-1] / len(held)
        low = columns["min_rtt_us"].min()
        now = max(int(np.round(rate / 8 * low / 1e6)), MIN_RWND_B) if np.isfinite(rate * low) else None
        rows = [(key[0], epoch, int(t), *(columns[c][i] for c in (*MERGED, "mathis_bps")), len(held), rate, now, now != size) for i, t in enumerate(times)]
        return rows, now

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def decide_senders(flows: DataFrame, window: int = SMOOTHING) -> DataFrame:
    """One paced rate per sender and epoch from rows of its flows: sender_id, sender_port, event, epoch, n_flows, arrival_us and the merged columns.

    Rows of a flow and epoch come in one batch.  An epoch counts once all of the sender's flows are
    there: ``n_flows``, or where that is null all with an "open" row and no "removed" row
    since.  A newer epoch discards what waits of an older one.  Every flow is interpolated at the last
    ``window`` times of all; mean RTT and loss rate, least loss event rate and minimum RTT, summed
    throughput; the rate is the model's for the softened loss event rate, shared by the flows.
    """
    rows = flows.select("sender_id", "sender_port", "event", "epoch", "n_flows", "arrival_us", *MERGED)
    return rows.groupBy("sender_id").transformWithStateInPandas(SenderPolicy(window), ", ".join(f"{n} {k}" for n, k in SENDER_FIELDS), "Append", "EventTime", eventTimeColumnName="")


def sender_rows(decided: DataFrame, epoch: Column, judge: int = 8) -> DataFrame:
    """Rows of ``decide_live`` (with ``announce``, by sender_id and sender_port) as ``decide_senders`` takes them."""
    features = {c: f"{c}_w{judge}" for c in ("rtt_us", "loss_rate", "tput_bps")}
    return decided.where("event in ('open', 'features', 'removed')").select("sender_id", "sender_port", "event", epoch.cast("long").alias("epoch"), F.lit(None).cast("long").alias("n_flows"), "arrival_us", *(F.col(x).alias(c) for c, x in features.items()), "loss_event_rate", "min_rtt_us")
