"""Joins between packets, ACKs, flows and experiments.

As-of and per-row-width joins come in two forms: a union of both sides with
``last(ignorenulls)`` over a sorted window, which spills and suits any size, and in
``windows.py`` a vectorised form for groups that fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtally.operators.running import running
from flowtally.sources.tables import FLOW, flow_window


def attach_flow_meta(packets: DataFrame, flows: DataFrame) -> DataFrame:
    """Adds congestion control, sender and receiver by flow key."""
    return packets.join(flows, FLOW, "left")


def attach_exp_meta(packets: DataFrame, experiments: DataFrame) -> DataFrame:
    """Adds bandwidth and emulation flag by experiment."""
    return packets.join(experiments, "exp_id", "left")


def is_retransmission(packets: DataFrame) -> DataFrame:
    """Adds seq_epoch, prev_seq, prev_payload_b, highest_seq and is_retrans.

    An epoch ends with a packet whose end passes 2^32; what was seen before stays known.
    """
    w, seen = flow_window(), Window.partitionBy(*FLOW, "seq").orderBy("pkt_idx")
    wraps = F.lag(F.coalesce((F.col("seq") + F.col("payload_b") > 2**32).cast("int"), F.lit(0)), 1, 0).over(w)
    epoch = packets.withColumn("_wraps", wraps).withColumn("seq_epoch", F.sum("_wraps").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_wraps")
    we = Window.partitionBy(*FLOW, "seq_epoch").orderBy("pkt_idx")
    out = epoch.withColumns({"prev_seq": F.lag("seq").over(we), "prev_payload_b": F.lag("payload_b").over(we), "highest_seq": F.max("seq").over(we.rowsBetween(Window.unboundedPreceding, -1))})
    again = (F.row_number().over(seen) > 1) & F.col("seq").isNotNull()
    back = F.coalesce(F.col("prev_seq") + F.col("prev_payload_b") > F.col("seq"), F.lit(False))
    return out.withColumn("is_retrans", again | back)


def match_rtt_tcp(packets: DataFrame, acks: DataFrame) -> DataFrame:
    """Adds rtt_us: the time since the first ACK whose TSval the packet echoes.

    Matching only moves forward in ACK order.  First packets, retransmissions and packets
    without seq have no RTT and reset it; a packet without a match carries the one before.
    ``packets`` has is_retrans.
    """
    # One exchange by flow deals packets and ACKs; all windows below keep it.
    sent = acks.where("tsval is not null").select(*FLOW, F.col("tsval").alias("tsecr"), F.struct("ack_us", "ack_idx").alias("_sent"), F.lit(0).alias("_kind"))
    both = packets.withColumn("_kind", F.lit(1)).unionByName(sent, allowMissingColumns=True).repartition(*FLOW)
    same = Window.partitionBy(*FLOW, "tsecr").orderBy("_kind", "_sent.ack_idx").rowsBetween(Window.unboundedPreceding, 0)
    w = flow_window()
    eligible = (F.col("pkt_idx") > 0) & ~F.col("is_retrans") & F.col("seq").isNotNull()
    first = F.first("_sent", ignorenulls=True).over(same)
    joined = both.withColumn("_first", first).where("_kind = 1").withColumns({"_eligible": eligible, "ack_us": F.col("_first.ack_us"), "ack_idx": F.col("_first.ack_idx")})
    ahead = F.max(F.when(F.col("_eligible"), F.col("ack_idx"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    hit = F.col("_eligible") & F.col("ack_idx").isNotNull() & (F.col("ack_idx") >= F.coalesce(ahead, F.lit(-1)))
    # A struct is a value even when the RTT in it is unknown: that is the reset.
    value = F.when(F.col("_hit"), F.struct((F.col("arrival_us") - F.col("ack_us")).cast("double").alias("rtt"))).when(~F.col("_eligible"), F.struct(F.lit(None).cast("double").alias("rtt")))
    marked = joined.withColumn("_hit", hit).withColumn("_value", value)
    carried = F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("rtt_us", carried["rtt"]).drop("ack_us", "ack_idx", "_first", "_sent", "_kind", "_eligible", "_hit", "_value")


def match_rtt_asof(packets: DataFrame, acks: DataFrame) -> DataFrame:
    """Adds rtt_us: the RTT that the last ACK sent before the packet carries (tsval); 0 is unknown.

    Before the first ACK the first one counts; after all of them, the last but one.
    """
    n = acks.groupBy(*FLOW).agg(F.count(F.lit(1)).alias("_acks"), F.min_by(F.col("tsval"), "ack_idx").alias("_first"), F.max("ack_us").alias("_end"))
    last_two = acks.withColumn("_back", F.row_number().over(Window.partitionBy(*FLOW).orderBy(F.desc("ack_idx")))).where("_back = 2 or _back = 1").groupBy(*FLOW).agg(F.max_by("tsval", "_back").alias("_late"))
    probes = packets.select(*FLOW, F.col("arrival_us").alias("_t"), F.lit(0).alias("_kind"), "pkt_idx", F.lit(None).cast("long").alias("tsval"))
    marks = acks.select(*FLOW, F.col("ack_us").alias("_t"), F.lit(1).alias("_kind"), F.col("ack_idx").alias("pkt_idx"), "tsval")
    # At equal time the packet comes first, so only ACKs strictly before it count.
    order = Window.partitionBy(*FLOW).orderBy("_t", "_kind", "pkt_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = probes.unionByName(marks).withColumn("_seen", F.last("tsval", ignorenulls=True).over(order)).where("_kind = 0").select(*FLOW, "pkt_idx", "_seen")
    rtt = F.when(F.col("arrival_us") > F.col("_end"), F.col("_late")).otherwise(F.coalesce("_seen", "_first"))
    return packets.join(found, [*FLOW, "pkt_idx"], "left").join(n, FLOW, "left").join(last_two, FLOW, "left").withColumn("rtt_us", F.nullif(rtt, F.lit(0)).cast("double")).drop("_seen", "_acks", "_first", "_end", "_late")


SPANS = 1024


def active_flows(packets: DataFrame) -> DataFrame:
    """Adds active_flows: flows of the experiment whose [first, last] holds the packet's time, both ends inclusive.

    A sweep: +1 at a flow's first, -1 after its last, a running sum over all of them in
    time order; it needs neither a cross join nor bounds that fit a broadcast.  The sum
    runs over distinct times only, within ``SPANS`` equal parts of the experiment's time
    whose sums are carried on, so an experiment is spread over many tasks; packets join
    their time's count back.
    """
    bounds = packets.groupBy(*FLOW).agg(F.min("arrival_us").alias("first"), F.max("arrival_us").alias("last"))
    moves = bounds.select("exp_id", F.col("first").alias("t"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(bounds.select("exp_id", F.col("last").alias("t"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    times = packets.select("exp_id", F.col("arrival_us").alias("t"), F.lit(0).alias("up"), F.lit(0).alias("down")).unionByName(moves).groupBy("exp_id", "t").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    ends = bounds.groupBy("exp_id").agg(F.min("first").alias("_lo"), F.max("last").alias("_hi"))
    # In doubles: monotone in t, which is all that the sums need.
    part = F.floor((F.col("t") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1) * SPANS)
    placed = times.join(ends, "exp_id").select("exp_id", part.alias("_part"), "t", "up", "down")
    change = F.sum(F.col("up") - F.col("down"))
    before = placed.groupBy("exp_id", "_part").agg(change.alias("_net")).select("exp_id", "_part", F.coalesce(F.sum("_net").over(Window.partitionBy("exp_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # A flow that ends at t is still open then.
    own = change.over(Window.partitionBy("exp_id", "_part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)) + F.col("down")
    counts = placed.withColumn("_own", own).join(before, ["exp_id", "_part"]).select("exp_id", F.col("t").alias("arrival_us"), (F.col("_own") + F.col("_before")).alias("active_flows"))
    return packets.join(counts, ["exp_id", "arrival_us"])


def find_bound(rows: DataFrame, probes: DataFrame, key: list[str], value: str, target: str, direction: str) -> DataFrame:
    """Adds ``bound`` to probes: an index into the rows of the same key, sorted by ``idx``.

    after: the first index whose value is at or past the target, at most n - 1.
    before: the index just before that one, at least 0; n - 1 if every value is less.
    Unknown values are skipped; a key without rows gives NULL.
    """
    sizes = rows.groupBy(*key).agg(F.max("idx").alias("_last"))
    # Each probe travels whole through the union, so nothing has to be joined back.
    columns = probes.columns
    asks = probes.select(*key, F.col(target).cast("double").alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("idx"), F.struct(*columns).alias("_row"))
    side = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).cast("double").alias("_v"), F.lit(1).alias("_kind"), F.col("idx").cast("long").alias("idx"), F.lit(None).cast(asks.schema["_row"].dataType).alias("_row"))
    # Values at the target come before the probe here, so the least index so far is the first at or past it.
    w = Window.partitionBy(*key).orderBy(F.desc("_v"), F.desc("_kind"), F.desc("idx")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = side.unionByName(asks).withColumn("_next", F.min("idx").over(w)).where("_kind = 0").select("_row.*", "_next")
    out = ahead.join(sizes, key, "left")
    bound = F.least(F.coalesce("_next", "_last"), "_last") if direction == "after" else F.when(F.col("_next").isNotNull(), F.greatest(F.col("_next") - 1, F.lit(0))).otherwise(F.col("_last"))
    return out.withColumn("bound", F.when(F.col("_last").isNotNull(), bound)).select(*columns, "bound")


def pair_experiments(experiments: DataFrame, flag: str = "unfair") -> tuple[DataFrame, DataFrame]:
    """Pairs each enabled experiment with the first disabled one of the same name but for the flag and the final token.

    Returns the pairs (pair_key, enabled_name, disabled_name) and the enabled names without a partner.
    """
    stem = F.regexp_replace(F.regexp_replace("exp_name", "-[^-]*$", ""), f"{flag}(True|False)", f"{flag}*")
    named = experiments.select("exp_name", stem.alias("pair_key"), F.col("exp_name").contains(f"{flag}True").alias("enabled"))
    off = named.where("not enabled").groupBy("pair_key").agg(F.min("exp_name").alias("disabled_name"))
    on = named.where("enabled").select("pair_key", F.col("exp_name").alias("enabled_name"))
    return on.join(off, "pair_key"), on.join(off, "pair_key", "left_anti")


def schedule_at(times: DataFrame, schedule: DataFrame, lookup: str = "next") -> DataFrame:
    """Adds rwnd_b from a schedule (start_s, rwnd_b): the next entry at or after the time (parity), or the one in force ("current").

    Past the end the last entry holds; before the start "current" takes the first.  Entries and
    times are one union in order of time, in which each time carries the entry before it
    along: neither side is collected, and equal starts keep the entry of the largest window ("current") or smallest ("next").
    """
    ahead = lookup == "next"
    columns = times.columns
    entry = schedule.select(F.col("start_s").alias("_t"), F.col("rwnd_b").cast("long").alias("_w"), F.lit(0).alias("_ask"))
    asked = times.select(F.struct(*columns).alias("_row"), F.col("now_s").alias("_t"), F.lit(1).alias("_ask")).withColumn("_id", F.monotonically_increasing_id())
    union = asked.unionByName(entry, allowMissingColumns=True)
    order = [F.desc("_t") if ahead else F.asc("_t"), F.asc("_ask"), F.desc("_w") if ahead else F.asc("_w"), F.asc("_id")]
    met = running(union, [], order, {"_found": ("last", F.col("_w"))}).where("_ask = 1")
    pick = F.max_by if ahead else F.min_by
    edge = schedule.agg(pick(F.col("rwnd_b").cast("long"), F.struct("start_s", "rwnd_b")).alias("_edge"))
    return met.join(F.broadcast(edge)).select("_row.*", F.coalesce("_found", "_edge").alias("rwnd_b"))


def not_yet_done(work: DataFrame, done: DataFrame, key: str = "exp_name") -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def flows_of_sender(flows: DataFrame, chosen: DataFrame, active: Column | None = None) -> DataFrame:
    """All flows whose sender address is among ``chosen``, optionally only active ones."""
    rows = flows.where(active) if active is not None else flows
    return rows.join(chosen.select("remote_addr").distinct(), "remote_addr", "left_semi")


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only: keys and side (left or right)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))
