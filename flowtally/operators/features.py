"""Row-level feature columns of each received packet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowtally.functions.unknown import NO_RTT, bits_per_second, known, mathis_bps, safe_div
from flowtally.sources.tables import flow_window


def row_features(packets: DataFrame) -> DataFrame:
    """Adds the regular features; packets come from ``match_rtt_tcp`` and ``active_flows`` with bw_bps and use_bess."""
    w = flow_window()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    clean = F.col("prev_seq").isNotNull() & (F.col("payload_b") > 0) & (F.col("prev_payload_b") > 0) & (F.col("highest_seq") == F.col("prev_seq")) & ~F.col("is_retrans")
    lost = F.when(clean, F.bround((F.col("seq") - F.col("prev_payload_b") - F.col("prev_seq")) / F.col("payload_b")))
    gap = F.col("arrival_us") - F.lag("arrival_us").over(w)
    first = packets.withColumns({
        "total_so_far_b": F.sum("wire_b").over(upto),
        "payload_so_far_b": F.sum("payload_b").over(upto),
        "pkts_lost": lost,
        "interarrival_us": gap.cast("double"),
        "min_rtt_us": F.coalesce(F.min(known(F.col("rtt_us"))).over(upto), F.lit(NO_RTT)),
    })
    loss = F.col("pkts_lost") / (F.col("pkts_lost") + 1)
    second = first.withColumns({
        "pkts_lost_total": F.coalesce(F.sum("pkts_lost").over(upto), F.lit(0.0)),
        "loss_rate": loss,
        "inv_sqrt_loss_rate": F.lit(1.0) / F.sqrt(known(loss)),
        "inv_interarrival_bps": bits_per_second(F.col("wire_b"), F.col("interarrival_us")),
        "rtt_ratio": safe_div(F.col("rtt_us"), F.col("min_rtt_us")),
        "has_rtt": F.col("min_rtt_us") < NO_RTT,
        "fair_share_frac": F.lit(1.0) / F.col("active_flows"),
        "fair_share_bps": F.when(F.col("use_bess"), F.col("bw_bps") / F.col("active_flows")),
        "mathis_tput_bps": mathis_bps(F.col("payload_b"), F.col("rtt_us"), loss),
    })
    return second


def online_features(packets: DataFrame) -> DataFrame:
    """The variants for live packets: no gap counts as 1 us, the RTT ratio is against the given min_rtt_us, losses are given (pkts_lost)."""
    w = flow_window()
    gap = F.col("arrival_us") - F.lag("arrival_us").over(w)
    loss = F.col("pkts_lost") / (F.col("pkts_lost") + 1)
    return packets.withColumns({
        "interarrival_us": F.when(gap == 0, 1).otherwise(gap).cast("double"),
        "rtt_ratio": safe_div(F.col("rtt_us"), F.col("min_rtt_us")),
        "loss_rate": loss,
        "mathis_tput_bps": mathis_bps(F.col("payload_b"), F.col("rtt_us"), loss),
    }).withColumn("inv_interarrival_bps", bits_per_second(F.col("wire_b"), F.col("interarrival_us")))
