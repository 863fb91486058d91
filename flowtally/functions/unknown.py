"""Arithmetic with unknown values.  Unknown is NULL; files that mark it by -1 are converted at the edges."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, functions as F

# Fixed values of the data model.
MATHIS_C = sqrt(3 / 2)
MSS_B, PACKET_B, MIN_RWND_B = 1448, 1514, 2000
FAIR_BAND = 0.1
NO_RTT = 9223372036854775807.0


def from_marker(c: Column) -> Column:
    """-1 becomes NULL."""
    return F.when(c != -1, c)


def to_marker(c: Column) -> Column:
    """NULL becomes -1."""
    return F.coalesce(c, F.lit(-1))


def known(c: Column) -> Column:
    """NULL for 0 and infinity too, which several rules treat as unknown."""
    return F.when((c != 0) & (F.abs(c) < float("inf")), c)


def safe_div(n: Column, d: Column) -> Column:
    """n / d; unknown if either is unknown or d is 0 or infinite."""
    return n.cast("double") / known(d.cast("double"))


def safe_least(a: Column, b: Column) -> Column:
    """The smaller of the operands that are known and neither 0 nor infinite."""
    return F.least(known(a), known(b))


def safe_greatest(a: Column, b: Column) -> Column:
    return F.greatest(known(a), known(b))


def bits_per_second(n_bytes: Column, us: Column) -> Column:
    """Rate of ``n_bytes`` in ``us`` microseconds; unknown over no time."""
    return safe_div(n_bytes * F.lit(8e6), us)


def mathis_bps(mss_b: Column, rtt_us: Column, loss: Column) -> Column:
    """Throughput of the Mathis model; unknown without an RTT or without loss."""
    return safe_div(F.lit(8e6) * mss_b, rtt_us) * F.lit(MATHIS_C) / F.sqrt(known(loss))


def mathis_label(actual_bps: Column, model_bps: Column) -> Column:
    """1 if the flow is faster than the model, else 0; unknown if either is."""
    return (actual_bps > model_bps).cast("int")


def fairness_class(ratio: Column) -> Column:
    """0 below, 1 near, 2 above the fair share (band of 10 %)."""
    return F.when(ratio < 1 - FAIR_BAND, 0).when(ratio <= 1 + FAIR_BAND, 1).when(ratio > 1 + FAIR_BAND, 2).cast("int")


def binary_class(ratio: Column) -> Column:
    return (ratio > 1).cast("int")


def hex_or_int(text: Column) -> Column:
    """A number written in hex (0x..) or decimal."""
    t = F.trim(text)
    return F.when(t.startswith("0x"), F.conv(F.substring(t, 3, 16), 16, 10)).otherwise(t).cast("long")


def dotted_quad(address: Column) -> Column:
    """A little-endian 32-bit address as text."""
    return F.concat_ws(".", *[F.shiftright(address, 8 * k).bitwiseAND(255) for k in range(4)])


def little_endian(quad: Column) -> Column:
    """The little-endian number of a dotted quad."""
    parts = F.split(quad, r"\.")
    return sum((F.shiftleft(F.element_at(parts, k + 1).cast("long"), 8 * k) for k in range(4)), F.lit(0).cast("long"))


def flow_text(local_addr: Column, local_port: Column, remote_addr: Column, remote_port: Column) -> Column:
    return F.format_string("%s:%d->%s:%d", dotted_quad(remote_addr), remote_port, dotted_quad(local_addr), local_port)


def queue_multiple(queue_bdp: Column) -> Column:
    """Whole multiples of the BDP; below one: a half."""
    return F.when(F.floor(queue_bdp) == 0, 0.5).otherwise(F.floor(queue_bdp).cast("double"))


def seeded_order(seed: int, *keys: str) -> Column:
    """A portable pseudo-random sort key of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
