"""Experiments: names, parameters and derived link physics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowtally.functions.unknown import PACKET_B

# Positions of the tokens in a name, by the number of tokens (0-based).
GRAMMARS = {
    11: {"cca_1": 1, "cca_2": 2, "bw": 3, "rtt": 4, "queue": 5, "flows_1": 6, "flows_2": 7, "unfair": 8},
    13: {"cca_1": 1, "cca_2": 2, "bw": 3, "rtt": 4, "queue": 5, "flows_1": 6, "flows_2": 7, "ping": 8, "unfair": 9, "bess": 10},
    15: {"cca_1": 1, "cca_2": 2, "bw": 3, "rtt": 4, "queue": 5, "flows_1": 6, "flows_2": 7, "bitrate_1": 8, "bitrate_2": 9, "ping": 10, "unfair": 11, "bess": 12},
    18: {"cca_1": 1, "cca_2": 2, "cca_back": 3, "bw": 4, "rtt": 5, "queue": 6, "flows_1": 7, "flows_2": 8, "flows_back": 9, "bitrate_1": 10, "bitrate_2": 11, "bitrate_back": 12, "ping": 13, "unfair": 14, "bess": 15},
}
ID_GRAMMAR = {"bw": 1, "rtt": 2, "queue": 3, "ccas": 4, "flows": 5, "ping": 6, "unfair": 7, "bess": 8}
UNITS = {"bw": "bw", "rtt": "rtt", "queue": "q", "ping": "ping", "bitrate_1": "bitrate", "bitrate_2": "bitrate", "bitrate_back": "bitrate"}


def parse_names(names: DataFrame, column: str = "exp_name") -> tuple[DataFrame, DataFrame]:
    """Parsed experiments, and the names that follow no grammar.

    Five grammars: names with an ``-id`` token (lists of congestion controls and flow
    counts), and names of 11, 13, 15 or 18 tokens.
    """
    base = F.regexp_replace(F.element_at(F.split(F.col(column), "/"), -1), r"(\.tar\.gz|\.npz)$", "")
    rows = names.withColumn("exp_name", base).withColumn("_t", F.split("exp_name", "-")).withColumn("_id", F.contains(F.col("exp_name"), F.lit("-id")))
    token = lambda k: F.get("_t", F.lit(k))
    good = F.when(F.col("_id"), F.size("_t") == 11).otherwise(F.size("_t").isin(*GRAMMARS))

    def value(field: str, default: Column) -> Column:
        if field in ID_GRAMMAR:
            c = F.when(F.col("_id"), token(ID_GRAMMAR[field]))
        else:
            c = F.when(F.col("_id"), default)
        for n, places in GRAMMARS.items():
            c = c.when(F.size("_t") == n, token(places[field]) if field in places else default)
        return c

    number = lambda field, default="0": F.regexp_extract(value(field, F.lit(default)), r"^([0-9.]+)", 1).try_cast("double")
    ccas, flows = F.split(token(ID_GRAMMAR["ccas"]), ","), F.split(token(ID_GRAMMAR["flows"]), ",")
    count = lambda field: F.regexp_extract(value(field, F.lit("0")), r"^([0-9]+)", 1).try_cast("int")
    out = rows.select(
        "exp_name",
        good.alias("_good"),
        F.when(F.col("_id"), F.get(ccas, F.lit(0))).otherwise(value("cca_1", F.lit(""))).alias("cca_1"),
        F.when(F.col("_id"), F.coalesce(F.get(ccas, F.lit(1)), F.get(ccas, F.lit(0)))).otherwise(value("cca_2", F.lit(""))).alias("cca_2"),
        value("cca_back", F.lit("")).alias("cca_back"),
        F.when(F.col("_id"), F.get(flows, F.lit(0)).try_cast("int")).otherwise(count("flows_1")).alias("flows_1"),
        F.when(F.col("_id"), F.when(F.size(ccas) == 2, F.get(flows, F.lit(1)).try_cast("int")).otherwise(0)).otherwise(count("flows_2")).alias("flows_2"),
        count("flows_back").alias("flows_back"),
        number("bw").alias("bw_mbps"),
        (number("rtt") * 1000).alias("rtt_us"),
        number("queue").alias("queue_pkts"),
        (number("ping") * 1000).alias("ping_us"),
        number("bitrate_1").alias("bitrate_mbps_1"),
        number("bitrate_2").alias("bitrate_mbps_2"),
        number("bitrate_back").alias("bitrate_mbps_back"),
        F.endswith(value("unfair", F.lit("unfairFalse")), F.lit("True")).alias("use_monitor"),
        F.endswith(value("bess", F.lit("bessTrue")), F.lit("True")).alias("use_bess"),
    ).withColumn("tot_flows", F.col("flows_1") + F.col("flows_2") + F.col("flows_back"))
    return physics(out.where("_good").drop("_good")), out.where("not coalesce(_good, false)").select("exp_name")


def physics(experiments: DataFrame) -> DataFrame:
    """Adds link physics; unknown without bottleneck emulation."""
    emulated = lambda c: F.when(F.col("use_bess"), c)
    bw, bdp = F.col("bw_mbps") * 1e6, F.col("bw_mbps") * (F.col("rtt_us") + F.col("ping_us"))
    packets = bdp / 8 / PACKET_B
    return experiments.withColumns({
        "bw_bps": emulated(bw),
        "bdp_bits": emulated(bdp),
        "queue_bdp": emulated(F.col("queue_pkts") / F.nullif(packets, F.lit(0.0))),
        "max_rtt_us": emulated((F.col("queue_pkts") + 1) * PACKET_B * 8 / F.nullif(bw, F.lit(0.0)) * 1e6 + F.col("rtt_us") + F.col("ping_us")),
        "fair_mbps": emulated(F.col("bw_mbps") / F.nullif(F.col("tot_flows"), F.lit(0))),
    })
