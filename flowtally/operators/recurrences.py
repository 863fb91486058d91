"""Recurrences along a flow: EWMAs that hold over unknown values, and loss events.

Both stream narrow rows through Python in Arrow batches, in packet order (loss events in a grouped map), and hand the
state on from batch to batch, so a flow of any length needs the memory of a batch.  EWMAs
also hand it on from range to range of a flow, so that one flow fills many tasks.  The helpers are plain numpy and are shared with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtally.functions.registry import ALPHAS, ewma_name
from flowtally.functions.unknown import MATHIS_C
from flowtally.operators.windows import key_starts, steps
from flowtally.sources.shared import stored
from flowtally.sources.tables import FLOW


def in_packet_order(rows: DataFrame):
    """``rows`` grouped by flow; a grouped map sees each flow's rows in packet order, batch by batch.

    The sort within partitions starts with the grouping key, so Spark adds no sort of its own.
    """
    return rows.repartition(*FLOW).sortWithinPartitions(*FLOW, "pkt_idx").groupBy(*FLOW)


BLOCK, STEPS, AVERAGED = 64, 2048, 8192


def ewma_paths(x: np.ndarray, alphas: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """EWMA of each column of x after each row, for all alphas at once (NaN: unknown); shape rows x (columns * alphas).

    An unknown or zero average takes x as it is; else unknown, zero and infinite x leave it.
    ``start`` holds the averages to go on from.

    Every row is the map e -> kept * e + added, and maps compose.  More than ``STEPS`` rows are laid
    out in blocks that advance side by side, the blocks' maps are followed one after another, and
    each row is applied to what its block starts from: steps of Python grow with the block and
    the number of blocks, not with the rows.  Fewer rows are followed one by one.
    """
    x = x.reshape(len(x), -1)
    n, columns = x.shape
    e = np.full(columns * len(alphas), np.nan) if start is None else np.asarray(start, float).copy()
    usable = np.isfinite(x) & (x != 0)
    if n <= STEPS:
        out, a = np.empty((n, len(e))), np.tile(alphas, columns)
        wide, on = np.repeat(x, len(alphas), axis=1), np.repeat(usable, len(alphas), axis=1)
        added, kept = np.where(on, a * np.where(on, wide, 0), 0), np.where(on, 1 - a, 1)
        open_ = True
        for i in range(n):
            if open_:
                fresh = np.isnan(e) | (e == 0)
                e = np.where(fresh, wide[i], added[i] + kept[i] * e)
                # Once every average is known and not zero, it stays so.
                open_ = bool((np.isnan(e) | (e == 0)).any())
            else:
                e = added[i] + kept[i] * e
            out[i] = e
        return out
    # An average that is not open yet takes the first usable value, or an unusable one as it is.
    first = np.where(usable.any(axis=0), usable.argmax(axis=0), n)
    seed = np.where(first < n, x[np.minimum(first, n - 1), np.arange(columns)], 0.0)
    fresh = np.isnan(e) | (e == 0)
    before = np.where(fresh, np.repeat(seed, len(alphas)), e)
    size = max(1, min(BLOCK, int(np.sqrt(n)) + 1))
    blocks = -(-n // size)
    pad = lambda v, fill: np.concatenate([v, np.full((blocks * size - n, columns), fill)]).reshape(blocks, size, columns)
    ok, value = pad(usable, False), pad(np.where(usable, x, 0.0), 0.0)
    # Maps from the start of a block to each of its rows.
    kept, added = np.empty((blocks, size, len(e))), np.empty((blocks, size, len(e)))
    k, b = np.ones((blocks, len(e))), np.zeros((blocks, len(e)))
    for i in range(size):
        on, v = np.repeat(ok[:, i], len(alphas), axis=1), np.repeat(value[:, i], len(alphas), axis=1)
        a = np.where(on, np.tile(alphas, columns), 0.0)
        k, b = k * (1 - a), b * (1 - a) + a * v
        kept[:, i], added[:, i] = k, b
    starts = np.empty((blocks, len(e)))
    for i in range(blocks):
        starts[i] = before
        before = kept[i, -1] * before + added[i, -1]
    out = (kept * starts[:, None] + added).reshape(blocks * size, len(e))[:n]
    closed = np.arange(n)[:, None] < np.repeat(first, len(alphas))
    unknown = fresh & closed
    return np.where(unknown, np.repeat(x, len(alphas), axis=1), out) if unknown.any() else out


def ewma_flows(x: np.ndarray, heads: np.ndarray, lengths: np.ndarray, alphas: np.ndarray, start: np.ndarray) -> np.ndarray:
    """``ewma_paths`` of many flows at once: flow j has ``lengths[j]`` rows of x from ``heads[j]`` on and goes on from ``start[j]``.

    The first rows of all flows make a step, then their second rows, and so on, so steps of Python grow with the
    longest flow; flows of more than ``STEPS`` rows are followed by themselves.
    """
    out, factors = np.empty((len(x), x.shape[1] * len(alphas))), np.tile(alphas, x.shape[1])
    for j in np.flatnonzero(lengths > STEPS).tolist():
        own = slice(int(heads[j]), int(heads[j] + lengths[j]))
        out[own] = ewma_paths(x[own], alphas, start[j])
    order = np.argsort(-lengths, kind="stable")
    order = order[(lengths[order] <= STEPS) & (lengths[order] > 0)]
    heads, lengths, e = heads[order], lengths[order], start[order].astype(float)
    open_ = True
    for i in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -i))
        at = heads[:n] + i
        v, now = np.repeat(x[at], len(alphas), axis=1), e[:n]
        on = np.isfinite(v) & (v != 0)
        after = np.where(on, factors * np.where(on, v, 0) + (1 - factors) * now, now)
        if open_:
            fresh = np.isnan(now) | (now == 0)
            open_ = bool(fresh.any())
            after = np.where(fresh, v, after)
        out[at] = e[:n] = after
    return out


def _metrics_of(batch: pa.RecordBatch, metrics: list[str]) -> np.ndarray:
    x = np.column_stack([batch.column(m).to_numpy(zero_copy_only=False) for m in metrics]).astype(float)
    for k, m in enumerate(metrics):
        if m == "inv_sqrt_loss_rate":
            x[:, k] = np.where(np.isnan(x[:, k]), 1.0, x[:, k])
    return x


def ewma_carries(ranges: DataFrame, metrics: list[str], alphas: list[float]) -> DataFrame:
    """(flow, _part, start): the averages that each range of a flow goes on from, for flows of several ranges.

    A range is reduced to one small row: per metric its first usable value and the number of
    usable ones, and its averages from an open start; these rows compose along the flow.
    """
    keys, a = [*FLOW, "_part"], np.tile(alphas, len(metrics))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, seed, key = None, np.zeros(len(metrics), np.int64), np.full(len(metrics), np.nan), None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = key or [batch.column(c)[:1] for c in keys]
            x = _metrics_of(batch, metrics)
            usable = np.isfinite(x) & (x != 0)
            first = x[usable.argmax(axis=0), np.arange(len(metrics))]
            seed = np.where(np.isnan(seed) & usable.any(axis=0), first, seed)
            n = n + usable.sum(axis=0)
            last = ewma_paths(x, np.array(alphas), last)[-1]
        if key:
            yield pa.RecordBatch.from_arrays([*key, pa.array([last.tolist()]), pa.array([n.tolist()]), pa.array([seed.tolist()])], names=[*keys, "last", "n", "seed"])

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("_part")
        e, starts = np.full(len(a), np.nan), []
        for last, n, seed in zip(*(table[c].to_pylist() for c in ("last", "n", "seed"))):
            starts.append(e.tolist())
            n, seed, last = np.repeat(n, len(alphas)), np.repeat(np.array(seed, float), len(alphas)), np.array(last, float)
            e = np.where(n == 0, np.where(np.isnan(e), last, e), np.where(np.isnan(e) | (e == 0), last, last + (1 - a) ** n * (e - seed)))
        return table.select(keys).append_column("start", pa.array(starts, pa.list_(pa.float64())))

    kinds = {f.name: f.dataType.simpleString() for f in ranges.schema}
    named = ", ".join(f"{c} {kinds[c]}" for c in keys)
    long = ranges.groupBy(*FLOW).agg(F.min("_part").alias("_low"), F.max("_part").alias("_high")).where("_low < _high").select(*FLOW)
    small = ranges.join(long, FLOW, "left_semi").repartition(*keys).sortWithinPartitions(*keys, "pkt_idx").groupBy(*keys).applyInArrow(reduce, f"{named}, last array<double>, n array<long>, seed array<double>")
    return small.groupBy(*FLOW).applyInArrow(compose, f"{named}, start array<double>")


def ewma_features(rows: DataFrame, metrics: list[str], alphas: list[float] = ALPHAS) -> DataFrame:
    """Flow key, pkt_idx and one column per metric and alpha; unknown inverse-sqrt loss rates count as 1.

    Narrow rows are cut into ranges of (flow, pkt_idx) and stored; a range goes on from what
    ``ewma_carries`` hands it, so a flow is spread over as many tasks as its packets fill.
    Ranges stream through in order and those of a step of ``AVERAGED`` rows are followed together.
    """
    names, keys = [ewma_name(m, a) for m in metrics for a in alphas], [*FLOW, "_part"]
    narrow = rows.select(*FLOW, "pkt_idx", *[F.col(m).cast("double").alias(m) for m in metrics])
    ranges = stored(narrow.repartitionByRange(*FLOW, "pkt_idx").withColumn("_part", F.spark_partition_id()), "ewma-ranges")
    starts = stored(ewma_carries(ranges, metrics, alphas), "ewma-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, last = None, np.full(len(names), np.nan)
        for step in steps(batches, lambda: 0, AVERAGED):
            batch = step.combine_chunks().to_batches()[0]
            heads = np.flatnonzero(key_starts(step, keys) == np.arange(len(batch)))
            begun, given = np.full((len(heads), len(names)), np.nan), batch.column("start").is_valid().to_numpy(zero_copy_only=False)
            if [batch.column(c)[0].as_py() for c in keys] == open_key:
                begun[0] = last
            for i in np.flatnonzero(given).tolist():
                begun[np.searchsorted(heads, i, "right") - 1] = batch.column("start")[i].as_py()
            lengths, open_key = np.add.reduceat(~given, heads, dtype=np.int64), [batch.column(c)[len(batch) - 1].as_py() for c in keys]
            rows = batch.filter(pa.array(~given))
            paths = ewma_flows(_metrics_of(rows, metrics), np.cumsum(lengths) - lengths, lengths, np.array(alphas), begun)
            last = paths[-1] if lengths[-1] else begun[-1]
            # from_pandas: NaN becomes NULL.
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in [*FLOW, "pkt_idx"]), *(pa.array(c, from_pandas=True) for c in np.ascontiguousarray(paths.T))], names=[*FLOW, "pkt_idx", *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*FLOW, "pkt_idx"]), *(f"{n} double" for n in names)])
    # A range's start comes before its packets.
    both = ranges.withColumn("_at", F.lit(1)).unionByName(starts.withColumn("_at", F.lit(0)), allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions(*keys, "_at", "pkt_idx").mapInArrow(run, schema)


def gap_losses(seq: np.ndarray, payload: np.ndarray, packet_seq: bool = False, highest: int = 0) -> tuple[np.ndarray, int]:
    """Packets lost before each packet but the first, and the highest sequence number that holds after the last.

    A gap counts if it follows the highest number so far, so a repeat, or what follows one, has
    none: within a lap of the numbers a repeat never exceeds the highest.  A packet whose
    predecessor ends past 2^32 has no loss and starts a new lap, in which equal numbers are
    new data.  Packets without payload have no loss on either side.  The count is rounded
    half to even.
    """
    before, after = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    full = (payload[:-1] > 0) & (payload[1:] > 0)
    step = np.ones(len(before), np.int64) if packet_seq else payload[:-1].astype(np.int64)
    wraps = full & (before + step > 2**32)
    # Laps lie far apart on this axis, so one running maximum serves all of them.
    lap = (np.cumsum(wraps) - wraps) << 33
    high = np.maximum(np.maximum.accumulate(before + lap) - lap, np.where(lap == 0, highest, 0)) if len(before) else before
    gap = after - step - before
    unit = np.ones(len(before)) if packet_seq else np.maximum(payload[1:], 1)
    lost = np.where(full & ~wraps & (high == before) & (gap > 0), np.round(gap / unit), 0).astype(np.int64)
    return lost, (highest if not len(before) else 0 if wraps[-1] else int(high[-1]))


class LossEvents:
    """Loss events of one flow: start and number of packets of each of the latest ``largest + 1`` events, newest first."""

    def __init__(self, windows: tuple[int, ...] = (8,), events: list[list[float]] | None = None):
        self.windows, self.events = windows, events or [[0.0, 0]]

    def add(self, lost: int, prev_us: float, now_us: float, rtt_us: float) -> None:
        """Spreads the losses evenly between two arrivals; a loss over an RTT after its event's start opens a new one.

        Whole runs of losses inside one event are added at once, so a huge gap costs as many steps as it opens events.
        """
        k, gap, most = 0, (now_us - prev_us) / lost if lost else 0.0, max(self.windows) + 1
        while k < lost:
            limit = self.events[0][0] + rtt_us
            if gap > 0:
                inside = min(lost, max(k, int((limit - prev_us) // gap)))
                # Where division and product differ in the last bit, the product decides.
                while inside < lost and prev_us + (inside + 1) * gap <= limit:
                    inside += 1
                while inside > k and prev_us + inside * gap > limit:
                    inside -= 1
            else:
                inside = lost if prev_us <= limit else k
            if inside > k:
                self.events[0][1] += inside - k
                k = inside
                continue
            if rtt_us < gap and lost - k > most:
                # From here each loss opens an event of its own and only the newest count.
                k = lost - most
            self.events.insert(0, [prev_us + (k + 1) * gap, 1])
            del self.events[most:]
            k += 1
        self.events[0][1] += 1

    def rates(self) -> list[float]:
        """The loss event rate over each number of events: weights fall linearly; the newest event counts if it lowers the rate."""
        return self._rates(np.array([self.events[0][1]], float))[0].tolist()

    def _rates(self, newest: np.ndarray) -> np.ndarray:
        """The rates for each size of the newest event, beside the older ones; sizes x windows."""
        older, out = np.array([e[1] for e in self.events[1:]], float), np.empty((len(newest), len(self.windows)))
        for k, n in enumerate(self.windows):
            weights = 1 - np.arange(n) / n
            m = min(len(older) + 1, n)
            with_newest = newest + float((older[: m - 1] * weights[1:m]).sum())
            without = float((older[:n] * weights[: len(older[:n])]).sum())
            out[:, k] = weights[:m].sum() / np.maximum(with_newest, without)
        return out

    def follow(self, lost: np.ndarray, arrival_us: np.ndarray, rtt_us: np.ndarray) -> np.ndarray:
        """The rates after each packet but the first of the arrays; packets between two losses are counted at once."""
        out, hits = np.empty((len(lost), len(self.windows))), np.flatnonzero(lost)
        for start, end in zip([0, *hits.tolist()], [*hits.tolist(), len(lost)]):
            if start == end:
                continue
            held = self.events[0][1]
            if lost[start]:
                self.add(int(lost[start]), float(arrival_us[start]), float(arrival_us[start + 1]), float(rtt_us[start + 1]))
                held = self.events[0][1] - 1
            sizes = held + np.arange(1, end - start + 1)
            out[start:end] = self._rates(sizes.astype(float))
            self.events[0][1] = int(sizes[-1])
        return out


def loss_event_features(rows: DataFrame, windows: tuple[int, ...] = (8,)) -> DataFrame:
    """Flow key, pkt_idx, and per n: loss_event_rate_cw<n>, inv_sqrt_loss_event_rate_cw<n>, mathis_ler_bps_cw<n>; the first packet's rate is 0."""
    names, keys = [f"loss_event_rate_cw{n}" for n in windows], [*FLOW, "pkt_idx", "payload_b", "rtt_us"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker, high, last = LossEvents(windows), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, t, b, rtt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "arrival_us", "payload_b", "rtt_us"))
            rtt = np.nan_to_num(rtt.astype(float), nan=-1.0)
            if last is not None:
                seq, t, b, rtt = (np.concatenate([[x], y]) for x, y in zip(last, (seq, t, b, rtt)))
            lost, high = gap_losses(seq, b, highest=high)
            rates = tracker.follow(lost, t, rtt)
            rates = rates if last is not None else np.vstack([np.zeros((1, len(windows))), rates])
            last = (seq[-1], t[-1], b[-1], rtt[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), *map(pa.array, rates.T)], names=[*keys, *names])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"rtt_us": "double"}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), *(f"{n} double" for n in names)])
    rates = in_packet_order(rows.select(*FLOW, "pkt_idx", "seq", "arrival_us", "payload_b", F.col("rtt_us").cast("double").alias("rtt_us"))).applyInArrow(run, schema)
    known = lambda n: F.when(F.col(n) > 0, F.col(n))
    extra = {}
    for w, n in zip(windows, names):
        extra[f"inv_sqrt_loss_event_rate_cw{w}"] = F.lit(1.0) / F.sqrt(known(n))
        extra[f"mathis_ler_bps_cw{w}"] = F.lit(8e6 * MATHIS_C) * F.col("payload_b") / F.when(F.col("rtt_us") > 0, F.col("rtt_us")) / F.sqrt(known(n))
    return rates.withColumns(extra).select(*FLOW, "pkt_idx", *names, *extra)
