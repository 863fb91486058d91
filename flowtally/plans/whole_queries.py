"""Queries over whole sets of columns and windows, and the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowtally.functions import unknown as u
from flowtally.operators import fairness, joins, models, packets as pk, reports, windows as win
from flowtally.plans.packet_queries import KEY, O_FEATURES, O_LABELLED, O_SERIES, _oracle_flow_window, _oracle_window_errors, _window_errors, with_features
from flowtally.plans.registry import query
from flowtally.plans.report_queries import O_PAIRS, _jain_pairs
from flowtally.sources.tables import FLOW, ORACLE_PACKETS, bandwidths, data_packets, paired_packets, table

WIDE = [1, 8, 32, 1024]
WIDE_DIGITS = {"interarrival_us": 3, "inv_interarrival_bps": 6, "tput_bps": 9, "rtt_us": 3, "rtt_ratio": 6, "loss_rate": 9, "inv_sqrt_loss_rate": 6, "mathis_tput_bps": 6}


def _oracle_all_windows(mode: str) -> str:
    """Every windowed column of a flow's own packets; ``mode`` picks the loss of the Mathis value."""
    views = O_FEATURES + "".join(_oracle_flow_window(k).removeprefix(O_FEATURES) for k in WIDE)
    parts = []
    for k in WIDE:
        ratios = f"(SELECT avg(q.rtt_ratio) FROM feat q WHERE q.exp_id = v.exp_id AND q.sender_port = v.sender_port AND q.receiver_port = v.receiver_port AND q.pkt_idx BETWEEN v.pkt_idx - v.n AND v.pkt_idx)"
        loss = "lost / (lost + n)"
        model = "v.mathis_tput_bps" if mode == "offline" else f"8e6 * f.payload_b / nullif(f.rtt_us, 0) * sqrt(1.5::DOUBLE) / sqrt(nullif({loss}, 0))"
        columns = {
            "interarrival_us": "span / n::DOUBLE", "inv_interarrival_bps": "f.wire_b * 8e6 / nullif(span / n::DOUBLE, 0)", "tput_bps": "CASE WHEN NOT v.use_bess OR tput <= v.bw_bps THEN tput END",
            "rtt_us": "rtt_mean", "rtt_ratio": ratios, "loss_rate": loss, "inv_sqrt_loss_rate": f"1 / sqrt(nullif({loss}, 0))", "mathis_tput_bps": model,
        }
        parts.append(f"""x{k} AS (SELECT v.exp_id, v.sender_port, v.receiver_port, v.pkt_idx, {", ".join(f"round(CASE WHEN ok THEN {x} END, {WIDE_DIGITS[c]}) AS {c}_w{k}" for c, x in columns.items())} FROM v{k} v JOIN feat f USING ({KEY}, pkt_idx))""")
    return f"WITH {views}, {', '.join(parts)} SELECT * FROM x{WIDE[0]} " + " ".join(f"JOIN x{k} USING ({KEY}, pkt_idx)" for k in WIDE[1:])


def _all_windows(spark, sf_dir: str, mode: str) -> DataFrame:
    rows = win.flow_windows(with_features(spark, sf_dir), WIDE, mode)
    return rows.select(*FLOW, "pkt_idx", *[F.round(f"{c}_w{k}", d).alias(f"{c}_w{k}") for k in WIDE for c, d in WIDE_DIGITS.items()])


@query(_oracle_all_windows("offline"))
def w_flow_windows_all(spark, sf_dir):
    """All eight windowed columns at four widths, from the shortest to the longest (W1 to W7)."""
    return _all_windows(spark, sf_dir, "offline")


@query(_oracle_all_windows("online"))
def w7_flow_windows_online(spark, sf_dir):
    """The same with the Mathis value from the window's own loss."""
    return _all_windows(spark, sf_dir, "online")


@query(_oracle_window_errors().replace("SELECT *, coalesce(min(k) FILTER (n_errors = 0) OVER (PARTITION BY exp_id), 0) AS safe_k FROM er", "SELECT max(safe_k) AS safe_k FROM (SELECT exp_id, coalesce(min(k) FILTER (n_errors = 0), 0) AS safe_k FROM er GROUP BY exp_id)"))
def d20_global_window(spark, sf_dir):
    """The smallest safe window over all experiments."""
    return win.global_safe_window(_window_errors(spark, sf_dir, win.WINDOWS))


@query(f"WITH {ORACLE_PACKETS}, f AS (SELECT exp_id, sender_id, CASE WHEN sender_port % 2 = 0 THEN 'cubic' ELSE 'bbr' END AS cca FROM data) SELECT exp_id, sender_id, string_agg(DISTINCT cca, ',' ORDER BY cca) AS ccas FROM f GROUP BY ALL HAVING count(DISTINCT cca) > 1")
def d7_mixed_senders(spark, sf_dir):
    """Senders whose flows run different congestion controls (even ports cubic, odd ones bbr)."""
    flows = data_packets(spark, sf_dir).select("exp_id", "sender_id", "sender_port").distinct()
    return fairness.mixed_senders(flows.withColumn("cca", F.when(F.col("sender_port") % 2 == 0, "cubic").otherwise("bbr")))


@query(f"""{O_PAIRS}, cu AS (SELECT enabled, exp_id, CASE WHEN sender_id = 0 THEN 'incumbent' WHEN sender_id = 1 THEN 'newcomer' END AS c, sum(all_b) * 8e6 / nullif(max(z) - min(a), 0) / max(bw_bps) AS util FROM fl JOIN bw USING (exp_id) GROUP BY ALL),
w AS (SELECT exp_id, {", ".join(f"max(util) FILTER (c = '{c}' AND {e}) AS {c}_{s}" for c in ("incumbent", "newcomer") for s, e in (("off", "NOT enabled"), ("on", "enabled")))} FROM cu WHERE c IS NOT NULL GROUP BY exp_id)
SELECT exp_id, {", ".join(f"round({c}_off, 9) AS {c}_off, round({c}_on, 9) AS {c}_on, round({c}_on - {c}_off, 9) AS {c}_delta, round(({c}_on - {c}_off) / nullif({c}_off, 0) * 100, 6) AS {c}_pct" for c in ("incumbent", "newcomer"))} FROM w""")
def d13_class_deltas(spark, sf_dir):
    """Utilisation of incumbents and newcomers without and with the mechanism."""
    flows = joins.attach_exp_meta(fairness.flow_throughput(paired_packets(data_packets(spark, sf_dir)), ["enabled", "sender_id"]), bandwidths(spark))
    kind = F.when(F.col("sender_id") == 0, "incumbent").when(F.col("sender_id") == 1, "newcomer")
    used = fairness.class_utilisation(flows, ["enabled", "exp_id"], kind)
    out = reports.class_deltas(used, ["exp_id"], ["incumbent", "newcomer"])
    return out.select("exp_id", *[F.round(c, 6 if c.endswith("pct") else 9).alias(c) for c in out.columns[1:]])


@query(O_PAIRS + """, x AS (SELECT f.jain AS jain_off, n.jain AS jain_on FROM jn f JOIN jn n ON f.exp_id = n.exp_id AND NOT f.enabled AND n.enabled WHERE f.exp_id % 5 <> 4), l AS (UNPIVOT (SELECT jain_off, jain_on FROM x) ON jain_off, jain_on INTO NAME metric VALUE v)
SELECT metric, round(v, 9) AS value, round(sum(count(*)) OVER (PARTITION BY metric ORDER BY v) / sum(count(*)) OVER (PARTITION BY metric), 9) AS cdf FROM l GROUP BY metric, v""")
def d16_pooled_cdfs(spark, sf_dir):
    """CDFs of Jain's index over all pairs; the fifth experiment stands for a pair with dctcp, which is left out."""
    rows = _jain_pairs(spark, sf_dir).withColumns({"cca_1": F.when(F.col("exp_id") % 5 == 4, "dctcp").otherwise("cubic"), "cca_2": F.lit("bbr")})
    return reports.pooled_cdfs(rows, ["jain_off", "jain_on"]).select("metric", F.round("value", 9).alias("value"), F.round("cdf", 9).alias("cdf"))


@query(f"WITH {O_FEATURES}, u AS (UNPIVOT (SELECT count(*) - count(rtt_us) AS rtt_us, count(*) - count(loss_rate) AS loss_rate, count(*) AS never FROM feat) ON rtt_us, loss_rate, never INTO NAME feature VALUE n_unknown) SELECT feature, n_unknown, n_unknown = (SELECT count(*) FROM feat) AS all_unknown FROM u")
def b16_unknown_report(spark, sf_dir):
    """Unknown values per column, and columns that are unknown throughout."""
    return pk.unknown_report(with_features(spark, sf_dir).withColumn("never", F.lit(None).cast("double")), ["rtt_us", "loss_rate", "never"])


@query(f"WITH {O_FEATURES} SELECT {KEY}, pkt_idx, rtt_us IS NULL AS rtt_nan, loss_rate IS NULL AS loss_nan, coalesce(rtt_us, 0) AS rtt_us FROM feat")
def b16_unknowns_for_trees(spark, sf_dir):
    """Unknown values as NaN, which trees take as missing."""
    rows = pk.replace_unknowns(with_features(spark, sf_dir), ["rtt_us", "loss_rate"], "trees")
    return rows.select(*FLOW, "pkt_idx", F.isnan("rtt_us").alias("rtt_nan"), F.isnan("loss_rate").alias("loss_nan"), F.nanvl("rtt_us", F.lit(0.0)).alias("rtt_us"))


@query("WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 1000)), 999) AS INT) AS bin, lo, hi FROM events, s WHERE value IS NOT NULL), h AS (SELECT bin, lo, hi, count(*) AS n FROM b GROUP BY ALL) SELECT bin, round(lo + (bin + 1) * ((hi - lo) / 1000), 6) AS upper, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 9) AS cdf FROM h")
def d9_binned_cdf(spark, sf_dir):
    """The CDF of events' values over a thousand bins."""
    return reports.binned_cdf(table(spark, sf_dir, "events"), "value").select("bin", F.round("upper", 6).alias("upper"), F.round("cdf", 9).alias("cdf"))


@query("WITH a AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE value > 90) SELECT user_id, day, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT user_id, day, 'right' FROM (FROM b EXCEPT FROM a)")
def h5_day_differences(spark, sf_dir):
    """Users' days with errors against days with high values: keys on one side only."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return joins.key_differences(events.where("event_type = 'error'"), events.where("value > 90"), ["user_id", "day"])


@query("SELECT DISTINCT user_id AS exp_name FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)")
def c11_not_yet_done(spark, sf_dir):
    """Users still to do when every third one with an error is done."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("exp_name"), "event_type")
    return joins.not_yet_done(users.select("exp_name").distinct(), users.where("event_type = 'error' and exp_name % 3 = 0"))


@query("SELECT event_id, CASE WHEN floor(value / 20) = 0 THEN 0.5 ELSE floor(value / 20) END AS multiple FROM events")
def i_queue_multiple(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", u.queue_multiple(F.col("value") / 20).alias("multiple"))


@query(f"WITH {O_LABELLED} SELECT {KEY}, pkt_idx, CASE WHEN ok THEN CAST(flow_tput > mathis_tput_bps AS INT) END AS faster FROM labelled")
def b21_mathis_label(spark, sf_dir):
    """Whether a flow is faster than the Mathis model says."""
    # The flow's own windows suffice; those of the whole experiment are not part of this label.
    rows = win.flow_windows(with_features(spark, sf_dir), [8], metrics=["tput_bps", "mathis_tput_bps"])
    return rows.select(*FLOW, "pkt_idx", u.mathis_label(F.col("tput_bps_w8"), F.col("mathis_tput_bps_w8")).alias("faster"))


DAY_US = 86_400_000_000


@query(f"""WITH RECURSIVE {O_SERIES}, sp AS (SELECT exp_id, min(x_us) AS lo, max(x_us) AS hi FROM series GROUP BY exp_id),
gr AS (SELECT exp_id, unnest(range(CAST(ceil(lo / {DAY_US}) AS BIGINT) * {DAY_US}, CAST(floor(hi) AS BIGINT) + 1, {DAY_US})) AS t FROM sp),
fl AS (SELECT DISTINCT {KEY} FROM series), br AS (SELECT fl.*, t, (SELECT max(x_us) FROM series s WHERE s.exp_id = fl.exp_id AND s.sender_port = fl.sender_port AND x_us <= t) AS xb, (SELECT min(x_us) FROM series s WHERE s.exp_id = fl.exp_id AND s.sender_port = fl.sender_port AND x_us >= t) AS xa FROM fl JOIN gr USING (exp_id))
SELECT br.exp_id, t::DOUBLE AS "at", round(sum(CASE WHEN xb IS NULL THEN a.tput WHEN xa IS NULL OR xa = xb THEN b.tput ELSE b.tput + (t - xb) / (xa - xb) * (a.tput - b.tput) END), 9) AS tput_bps
FROM br LEFT JOIN series b ON b.exp_id = br.exp_id AND b.sender_port = br.sender_port AND b.x_us = xb LEFT JOIN series a ON a.exp_id = br.exp_id AND a.sender_port = br.sender_port AND a.x_us = xa GROUP BY br.exp_id, t""")
def h6_group_series(spark, sf_dir):
    """The summed series of an experiment's flows, each interpolated on a common daily grid."""
    series = fairness.throughput_series(data_packets(spark, sf_dir), DAY_US)
    return fairness.group_series(series, FLOW, ["exp_id"], DAY_US).withColumn("tput_bps", F.round("tput_bps", 9))


SPEARMAN = ["payload_b", "interarrival_us", "pkts_lost_total", "active_flows"]


def _oracle_spearman() -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS rho FROM rk" for a in SPEARMAN for b in SPEARMAN)
    return f"WITH {O_FEATURES}, fi AS (SELECT {', '.join(f'coalesce({c}, avg({c}) OVER ()) AS {c}' for c in SPEARMAN)} FROM feat), rk AS (SELECT {', '.join(map(rank, SPEARMAN))} FROM fi) {pairs}"


@query(_oracle_spearman())
def g11_spearman(spark, sf_dir):
    """Rank correlation of all pairs of features, unknown values imputed."""
    rows = with_features(spark, sf_dir).select(*[F.col(c).cast("double").alias(c) for c in SPEARMAN])
    return models.spearman_matrix(rows, SPEARMAN).withColumn("rho", F.round("rho", 6))
