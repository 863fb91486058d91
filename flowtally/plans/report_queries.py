"""Queries for reports, scores, samples, models, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtally.functions import unknown as u
from flowtally.operators import experiments as ex, fairness, joins, models, packets as pk, reports, sampling, scoring, windows as win
from flowtally.operators.running import join_spread, running
from flowtally.plans.packet_queries import CLASS, KEY, O_LABELLED, TRAINING_METRICS, TRAINING_ROW, labelled, loss_event_oracle, with_features
from flowtally.plans.registry import query
from flowtally.sources import files
from flowtally.sources.shared import stored, work_path
from flowtally.sources.tables import FLOW, ORACLE_PACKETS, data_packets, paired_packets, raw_packets, table, wall_micros
from flowtally.streaming import flows as live, online

DAY_US = 86_400_000_000


# Distributions ------------------------------------------------------------------------


@query("SELECT l_returnflag, p, round(value, 4) AS value FROM (SELECT l_returnflag, unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999]) AS p, unnest(quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999])) AS value FROM lineitem GROUP BY l_returnflag)")
def d8_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    return reports.percentiles(rows, "price", ["l_returnflag"]).withColumn("value", F.round("value", 4))


@query("SELECT event_type, n_chars AS size, round(cdf, 9) AS cdf FROM (SELECT event_type, n_chars, sum(n) OVER (PARTITION BY event_type ORDER BY n_chars) / sum(n) OVER (PARTITION BY event_type) AS cdf FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS n_chars, count(*) AS n FROM events GROUP BY ALL))")
def d9_cdf(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.floor("value").alias("size"))
    return reports.cdf(rows, "size", ["event_type"]).withColumn("cdf", F.round("cdf", 9))


@query("WITH s AS (SELECT min(CAST(l_quantity AS DOUBLE)) AS lo, max(CAST(l_quantity AS DOUBLE)) AS hi, count(l_quantity) AS n FROM lineitem), c AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1) SELECT bin, c.n, round(c.n / (s.n * (hi - lo) / 20), 9) AS density FROM c, s")
def d10_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"))
    return reports.histogram(rows, "q", 20).select("bin", "n", F.round("density", 9).alias("density"))


@query("WITH s AS (SELECT min(CAST(l_quantity AS DOUBLE)) AS lo, max(CAST(l_quantity AS DOUBLE)) AS hi FROM lineitem) SELECT round(lo + least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9) * (hi - lo) / 10, 6) AS category, count(*) AS n, round(avg(CAST(l_extendedprice AS DOUBLE)), 3) AS mean, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 3) AS median FROM lineitem, s GROUP BY 1")
def d11_group_by_parameter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("price"))
    out = reports.group_by_parameter(rows, "q", "price")
    return out.select(F.round("category", 6).alias("category"), "n", F.round("mean", 3).alias("mean"), F.round("median", 3).alias("median"))


@query("WITH l AS (UNPIVOT (SELECT event_type, value, CAST(user_id AS DOUBLE) AS user_no FROM events) ON value, user_no INTO NAME metric VALUE v) SELECT event_type, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(var_pop(v), 4) AS var FROM l GROUP BY ALL")
def d12_summary_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.col("user_id").cast("double").alias("user_no"))
    out = reports.summary_stats(rows, ["value", "user_no"], ["event_type"])
    return out.select("event_type", "metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("var", 4).alias("var"))


O_PAIRS = f"""WITH {ORACLE_PACKETS},
pairs AS (SELECT *, false AS enabled FROM data UNION ALL SELECT *, true FROM data WHERE tsecr % 2 = 0),
fl AS (SELECT enabled, {KEY}, any_value(sender_id) AS sender_id, sum(wire_b) AS all_b, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(arrival_us) - min(arrival_us), 0) AS tput, min(arrival_us) AS a, max(arrival_us) AS z FROM pairs GROUP BY enabled, {KEY}),
jn AS (SELECT enabled, exp_id, pow(sum(tput), 2) / nullif(count(tput) * sum(tput * tput), 0) AS jain FROM fl GROUP BY ALL)"""


def _jain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = fairness.flow_throughput(paired_packets(data_packets(spark, sf_dir)), ["enabled", "sender_id"])
    jain = fairness.jain_index(flows, ["enabled", "exp_id"])
    names = jain.select("exp_id", "enabled", "jain", F.concat(F.lit("unfair-e"), "exp_id", F.lit("-unfair"), F.when(F.col("enabled"), "True").otherwise("False"), F.lit("-"), F.when(F.col("enabled"), "t2").otherwise("t1")).alias("exp_name"))
    pairs, _ = joins.pair_experiments(names)
    value = names.select("exp_name", "exp_id", "jain")
    on = value.select(F.col("exp_name").alias("enabled_name"), "exp_id", F.col("jain").alias("jain_on"))
    off = value.select(F.col("exp_name").alias("disabled_name"), F.col("jain").alias("jain_off"))
    return pairs.join(on, "enabled_name").join(off, "disabled_name")


@query(O_PAIRS + " SELECT f.exp_id, round(f.jain, 9) AS jain_off, round(n.jain, 9) AS jain_on, round(n.jain - f.jain, 9) AS jain_delta, round((n.jain - f.jain) / f.jain * 100, 6) AS jain_pct FROM jn f JOIN jn n ON f.exp_id = n.exp_id AND NOT f.enabled AND n.enabled")
def c8_paired_deltas(spark, sf_dir):
    out = reports.paired_deltas(_jain_pairs(spark, sf_dir), "jain")
    return out.select("exp_id", *[F.round(c, d).alias(c) for c, d in (("jain_off", 9), ("jain_on", 9), ("jain_delta", 9), ("jain_pct", 6))])


@query(O_PAIRS + ", x AS (SELECT f.exp_id, f.jain AS jain_off, n.jain AS jain_on, CASE WHEN f.exp_id % 2 = 0 THEN 'cubic' ELSE 'bbr' END AS cca_1, 'bbr' AS cca_2 FROM jn f JOIN jn n ON f.exp_id = n.exp_id AND NOT f.enabled AND n.enabled) SELECT cca_1, cca_2, round(avg(jain_off), 9) AS jain_off, round(avg(jain_on), 9) AS jain_on, round(avg(jain_on - jain_off), 9) AS change, count(*) AS n FROM x GROUP BY ALL")
def d16_cca_pair_summary(spark, sf_dir):
    rows = _jain_pairs(spark, sf_dir).withColumns({"cca_1": F.when(F.col("exp_id") % 2 == 0, "cubic").otherwise("bbr"), "cca_2": F.lit("bbr")})
    return reports.cca_pair_summary(rows).select("cca_1", "cca_2", *[F.round(c, 9).alias(c) for c in ("jain_off", "jain_on", "change")], "n")


@query(f"WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, any_value(sender_id) AS sender_id FROM data GROUP BY {KEY}) SELECT exp_id, count(*) FILTER (sender_id = 0) * 100.0 / count(*) AS expected_pct FROM f GROUP BY exp_id")
def d14_expected_class_share(spark, sf_dir):
    flows = data_packets(spark, sf_dir).select(*FLOW, "sender_id").distinct()
    return reports.expected_class_share(flows, F.col("sender_id") == 0)


# Bottlenecks --------------------------------------------------------------------------

O_BOTTLE = f"""WITH {ORACLE_PACKETS}, t0 AS (SELECT exp_id, min(arrival_us) AS t0, (max(arrival_us) - min(arrival_us)) / 1e6 AS end_s FROM data GROUP BY exp_id),
two AS (SELECT data.*, arrival_us - t0 AS rel_us FROM data JOIN t0 USING (exp_id) WHERE sender_id < 2),
ch(sender_id, time_s, rate_mbps) AS (VALUES (0, 0.0, 0.0), (1, 0.0, 0.0), (0, 600000.0, 0.000001), (1, 1200000.0, 0.000002)),
ti AS (SELECT DISTINCT time_s FROM ch), iv AS (SELECT exp_id, sender_id, time_s, coalesce(lead(time_s) OVER (PARTITION BY exp_id, sender_id ORDER BY time_s), end_s) AS to_s,
  last_value((SELECT rate_mbps FROM ch c WHERE c.sender_id = s.sender_id AND c.time_s = ti.time_s) IGNORE NULLS) OVER (PARTITION BY exp_id, sender_id ORDER BY time_s) AS rate FROM t0, ti, (SELECT DISTINCT sender_id FROM ch) s),
fn AS (SELECT exp_id, sender_id, count(DISTINCT sender_port) AS flows FROM two GROUP BY ALL),
mr AS (SELECT a.exp_id, a.sender_id, a.time_s AS from_s, a.to_s, CASE WHEN nullif(a.rate, 0) IS NULL AND nullif(b.rate, 0) IS NULL THEN 0.000004 / (fa.flows + fb.flows) WHEN nullif(a.rate, 0) IS NULL THEN (0.000004 - b.rate) / fa.flows ELSE a.rate / fa.flows END AS maxmin_mbps
 FROM iv a JOIN iv b ON a.exp_id = b.exp_id AND a.time_s = b.time_s AND a.sender_id <> b.sender_id JOIN fn fa ON fa.exp_id = a.exp_id AND fa.sender_id = a.sender_id JOIN fn fb ON fb.exp_id = b.exp_id AND fb.sender_id = b.sender_id)"""


def _maxmin(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    packets = pk.relative_time(data_packets(spark, sf_dir)).where("sender_id < 2")
    ends = pk.relative_time(data_packets(spark, sf_dir)).groupBy("exp_id").agg((F.max("arrival_us") / 1e6).alias("end_s"))
    plan = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (0, 600000.0, 0.000001), (1, 1200000.0, 0.000002)], "sender_id long, time_s double, rate_mbps double")
    intervals = fairness.bottleneck_intervals(ends.select("exp_id").join(F.broadcast(plan)), ends)
    links = ends.select("exp_id", F.lit(0.000004).alias("link_mbps"))
    rates = fairness.maxmin_rates(intervals, packets.select(*FLOW, "sender_id").distinct(), links)
    return packets, rates


@query(O_BOTTLE + " SELECT exp_id, sender_id, from_s, to_s, round(maxmin_mbps * 1e6, 9) AS maxmin_bps FROM mr")
def h8_maxmin_rates(spark, sf_dir):
    return _maxmin(spark, sf_dir)[1].select("exp_id", "sender_id", "from_s", "to_s", F.round(F.col("maxmin_mbps") * 1e6, 9).alias("maxmin_bps"))


O_SHARES = O_BOTTLE + f", sh AS (SELECT t.exp_id, t.sender_port, t.receiver_port, from_s, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(rel_us) - min(rel_us), 0) / (max(maxmin_mbps) * 1e6) AS ratio FROM two t JOIN mr ON t.exp_id = mr.exp_id AND t.sender_id = mr.sender_id AND rel_us >= from_s * 1e6 AND rel_us < to_s * 1e6 GROUP BY ALL)"


@query(O_SHARES + f" SELECT {KEY}, from_s, round(ratio, 6) AS ratio FROM sh")
def c10_maxmin_shares(spark, sf_dir):
    packets, rates = _maxmin(spark, sf_dir)
    return fairness.maxmin_shares(packets, rates).select(*FLOW, "from_s", F.round("ratio", 6).alias("ratio"))


_ON = "SELECT t.exp_id, t.sender_port, t.receiver_port, from_s, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(rel_us) - min(rel_us), 0) / (max(maxmin_mbps) * 1e6) AS ratio FROM two t JOIN mr ON t.exp_id = mr.exp_id AND t.sender_id = mr.sender_id AND rel_us >= from_s * 1e6 AND rel_us < to_s * 1e6 WHERE tsecr % 2 = 0 GROUP BY ALL"


@query(O_SHARES + f", so AS ({_ON}), a AS (SELECT from_s, avg(ratio) AS off FROM sh GROUP BY from_s), b AS (SELECT from_s, avg(ratio) AS o FROM so GROUP BY from_s) SELECT from_s, round(off, 6) AS ratio_off, round(o, 6) AS ratio_on, round((o - off) / nullif(off, 0) * 100, 3) AS change_pct FROM a JOIN b USING (from_s)")
def d15_bottleneck_change(spark, sf_dir):
    packets, rates = _maxmin(spark, sf_dir)
    rates = stored(rates, "rates")
    out = fairness.bottleneck_change(fairness.maxmin_shares(packets, rates), fairness.maxmin_shares(packets.where("tsecr % 2 = 0"), rates))
    return out.select("from_s", F.round("ratio_off", 6).alias("ratio_off"), F.round("ratio_on", 6).alias("ratio_on"), F.round("change_pct", 3).alias("change_pct"))


@query(f"""WITH {ORACLE_PACKETS}, days AS (SELECT {KEY}, CAST(floor(arrival_us / 86400000000) AS BIGINT) AS x, CAST(sum(wire_b) AS DOUBLE) AS y FROM data GROUP BY ALL),
g AS (SELECT exp_id, sender_port, receiver_port, CAST(floor(arrival_us / 86400000000) AS BIGINT) + 0.5 AS pos FROM data GROUP BY ALL),
m AS (SELECT g.*, (SELECT max(x) FROM days d WHERE d.sender_port = g.sender_port AND d.exp_id = g.exp_id AND x <= pos) AS xb, (SELECT min(x) FROM days d WHERE d.sender_port = g.sender_port AND d.exp_id = g.exp_id AND x >= pos) AS xa FROM g)
SELECT m.exp_id, m.sender_port, m.receiver_port, CAST(pos AS DOUBLE) AS "at", round(CASE WHEN xb IS NULL THEN a.y WHEN xa IS NULL THEN b.y ELSE b.y + (pos - xb) / (xa - xb) * (a.y - b.y) END, 6) AS y
FROM m LEFT JOIN days b ON b.exp_id = m.exp_id AND b.sender_port = m.sender_port AND b.x = xb LEFT JOIN days a ON a.exp_id = m.exp_id AND a.sender_port = m.sender_port AND a.x = xa""")
def h6_interpolate(spark, sf_dir):
    day = F.floor(F.col("arrival_us") / DAY_US)
    series = data_packets(spark, sf_dir).groupBy(*FLOW, day.alias("x")).agg(F.sum("wire_b").cast("double").alias("y"))
    grid = series.select(*FLOW, (F.col("x") + 0.5).alias("at"))
    return fairness.interpolate(series, grid, FLOW, "x", "y").withColumn("y", F.round("y", 6))


# Scores -------------------------------------------------------------------------------


@query("WITH c(class) AS (VALUES (0), (1), (2)) SELECT class, count(quality) AS n, count(quality) * 100.0 / sum(count(quality)) OVER () AS percent FROM c LEFT JOIN labels ON quality = class GROUP BY class")
def d17_class_popularity(spark, sf_dir):
    return scoring.class_popularity(table(spark, sf_dir, "labels"), "quality", [0, 1, 2])


@query("SELECT doc_id, quality, round(1 - count(*) OVER (PARTITION BY quality) / (count(*) OVER ())::DOUBLE, 9) AS weight FROM labels")
def d18_class_weights(spark, sf_dir):
    rows = scoring.with_class_weights(table(spark, sf_dir, "labels"), "quality")
    return rows.select("doc_id", "quality", F.round("weight", 9).alias("weight"))


@query(f"WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, CAST(ceil(count(*) * (1 - 0.05::DOUBLE)) AS BIGINT) AS n FROM data GROUP BY {KEY}) SELECT exp_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_flows FROM f GROUP BY exp_id")
def d19_survey(spark, sf_dir):
    return scoring.survey(data_packets(spark, sf_dir), 0.05, FLOW)


O_REPORT = """WITH x AS (SELECT quality AS label, toxic AS predicted, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n) FILTER (label = predicted) AS hit FROM x), k AS (SELECT DISTINCT unnest([label, predicted]) AS class FROM x),
p AS (SELECT class, coalesce(sum(n) FILTER (label = class AND predicted = class), 0) AS tp, coalesce(sum(n) FILTER (label <> class AND predicted = class), 0) AS fp, coalesce(sum(n) FILTER (label = class AND predicted <> class), 0) AS fn FROM k, x GROUP BY class)
SELECT class, CAST(tp + fn AS BIGINT) AS support, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(fp / nullif(total - tp - fn, 0), 9) AS false_positive_rate, round(fn / nullif(tp + fn, 0), 9) AS false_negative_rate, round(hit / total, 9) AS accuracy FROM p, t"""


@query(O_REPORT)
def d21_classification_report(spark, sf_dir):
    out = scoring.classification_report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("class", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "false_positive_rate", "false_negative_rate", "accuracy")])


@query(f"WITH {O_LABELLED} SELECT active_flows, round(avg(CASE WHEN {CLASS.format('ratio')} = {CLASS.format('mathis_ratio')} THEN 1.0 WHEN ratio IS NOT NULL AND mathis_ratio IS NOT NULL THEN 0.0 END), 9) AS accuracy, count(*) AS n FROM labelled GROUP BY active_flows")
def d22_accuracy_by_num_flows(spark, sf_dir):
    return scoring.accuracy_by(labelled(spark, sf_dir), "label", "mathis_class", ["active_flows"]).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH r AS (SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS rn, value, CAST(event_type = 'error' AS INT) AS hit, count(*) OVER () AS n FROM events) SELECT CAST(floor(rn / greatest(1, n // 20)) AS BIGINT) AS bucket, round(avg(value), 6) AS mean_x, round(avg(hit), 9) AS accuracy, count(*) AS n FROM r GROUP BY 1")
def d23_accuracy_by_unfairness(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value", (F.col("event_type") == "error").cast("int").alias("hit"))
    return scoring.accuracy_by_unfairness(rows, "value", ["event_id"], "hit").select("bucket", F.round("mean_x", 6).alias("mean_x"), F.round("accuracy", 9).alias("accuracy"), "n")


@query("SELECT CASE WHEN l_quantity <= 1 THEN 1.0 WHEN l_quantity <= 10 THEN 10.0 WHEN l_quantity <= 30 THEN 30.0 WHEN l_quantity <= 50 THEN 50.0 WHEN l_quantity <= 1000 THEN 1000.0 END AS upto, round(avg(CAST(l_discount AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM lineitem GROUP BY 1")
def d24_accuracy_by_condition(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("bw_mbps"), F.col("l_discount").cast("double").alias("acc"))
    return scoring.accuracy_by_condition(rows, "bw_mbps", "acc").withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {O_LABELLED}, g AS (SELECT CAST(flow_tput > CASE WHEN ok THEN mathis_tput_bps END AS INT) AS guess, CAST(ratio > 1 AS INT) AS truth FROM labelled) SELECT count(*) FILTER (guess IS NOT NULL AND truth IS NOT NULL) AS used, count(*) FILTER (guess IS NULL OR truth IS NULL) AS left_out, round(count(*) FILTER (guess = truth) / nullif(count(*) FILTER (guess IS NOT NULL AND truth IS NOT NULL), 0), 9) AS accuracy_used, round(count(*) FILTER (guess = truth) / nullif(count(*), 0), 9) AS accuracy_all FROM g")
def d25_mathis_accuracy(spark, sf_dir):
    out = scoring.mathis_accuracy(labelled(spark, sf_dir), "tput_bps_w8", "mathis_tput_bps_w8", "binary")
    return out.select("used", "left_out", F.round("accuracy_used", 9).alias("accuracy_used"), F.round("accuracy_all", 9).alias("accuracy_all"))


O_SLIDE = f"""WITH {ORACLE_PACKETS}, m AS (SELECT exp_id, row_number() OVER (PARTITION BY exp_id ORDER BY arrival_us, sender_port) - 1 AS idx, arrival_us, gen_rtt_us AS rtt_us, CAST(k % 3 = 0 AS INT) AS predicted, (k % 5) / 2.0 AS ratio FROM data),
s AS (SELECT *, CASE WHEN idx > 0 THEN least(idx - 1, min(idx) OVER (PARTITION BY exp_id ORDER BY arrival_us RANGE BETWEEN (rtt_us - 1) PRECEDING AND CURRENT ROW)) END AS s0 FROM m),
t AS (SELECT *, max(s0) OVER (PARTITION BY exp_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS st, sum(predicted) OVER w AS cp, sum(ratio) OVER w AS cr FROM s WINDOW w AS (PARTITION BY exp_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
SELECT a.exp_id, round(avg(CASE WHEN ((a.cp - b.cp + b.predicted) / (a.idx - a.st + 1)::DOUBLE >= 0.4) = ((a.cr - b.cr + b.ratio) / (a.idx - a.st + 1)::DOUBLE > 1.0) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM t a JOIN t b ON a.exp_id = b.exp_id AND a.st = b.idx GROUP BY a.exp_id"""


@query(O_SLIDE)
def d26_sliding_accuracy(spark, sf_dir):
    narrow = data_packets(spark, sf_dir).select("exp_id", "sender_port", "pkt_idx", "arrival_us", "gen_rtt_us", "k")
    numbered = running(narrow, ["exp_id"], ["arrival_us", "sender_port", "pkt_idx"], {"_n": ("sum", F.lit(1))})
    rows = numbered.select("exp_id", (F.col("_n") - 1).alias("idx"), "arrival_us", F.col("gen_rtt_us").alias("rtt_us"), (F.col("k") % 3 == 0).cast("int").alias("predicted"), ((F.col("k") % 5) / 2).alias("ratio"))
    return win.sliding_accuracy(rows).withColumn("accuracy", F.round("accuracy", 9))


@query("WITH c AS (SELECT user_id, k, count(*) AS n FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS k FROM events) GROUP BY ALL) SELECT user_id, arg_max(k, n * 10 + k) AS label FROM c GROUP BY user_id")
def d29_label_mode(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 4).alias("label"))
    return scoring.label_mode(rows, ["user_id"])


@query("WITH r AS (SELECT user_id % 4 AS sims, user_id % 3 AS keep_pct, user_id % 2 AS iterations, CASE WHEN event_type <> 'error' THEN value / 1000 END AS loss, value AS seconds FROM events) SELECT sims, keep_pct, iterations, round(avg(1 - loss), 9) AS accuracy, round(avg(seconds), 6) AS seconds FROM r WHERE loss IS NOT NULL GROUP BY ALL")
def d28_sweep_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("sims"), (F.col("user_id") % 3).alias("keep_pct"), (F.col("user_id") % 2).alias("iterations"), F.when(F.col("event_type") != "error", F.col("value") / 1000).alias("loss"), F.col("value").alias("seconds"))
    out = reports.sweep_summary(rows)
    return out.select("sims", "keep_pct", "iterations", F.round("accuracy", 9).alias("accuracy"), F.round("seconds", 6).alias("seconds"))


@query("WITH s AS (SELECT l_returnflag AS a, l_linestatus AS b, avg(CAST(l_discount AS DOUBLE)) AS acc FROM lineitem GROUP BY ALL), o AS (SELECT l_returnflag AS a, avg(CAST(l_discount AS DOUBLE)) AS acc FROM lineitem GROUP BY ALL) SELECT s.a AS feature_1, round(max(CASE WHEN b = 'F' THEN s.acc / o.acc END), 6) AS \"F\", round(max(CASE WHEN b = 'O' THEN s.acc / o.acc END), 6) AS \"O\" FROM s JOIN o USING (a) GROUP BY s.a")
def d31_feature_pair_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feature_1"), F.col("l_linestatus").alias("feature_2"), F.col("l_discount").cast("double").alias("acc"))
    single = rows.groupBy(F.col("feature_1").alias("feature")).agg(F.avg("acc").alias("accuracy"))
    out = reports.feature_pair_ratio(single, rows.groupBy("feature_1", "feature_2").agg(F.avg("acc").alias("accuracy")))
    return out.select("feature_1", F.round("F", 6).alias("F"), F.round("O", 6).alias("O"))


# Samples, scaling, models -------------------------------------------------------------


@query(f"WITH {ORACLE_PACKETS}, r AS (SELECT {KEY}, pkt_idx, count(*) OVER (PARTITION BY exp_id) AS n, row_number() OVER (PARTITION BY exp_id ORDER BY md5(concat_ws('|', '1', exp_id, sender_port, receiver_port, pkt_idx)), exp_id, sender_port, receiver_port, pkt_idx) AS rn FROM data) SELECT {KEY}, pkt_idx, CASE WHEN rn <= floor(n * 0.35::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.35::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r WHERE rn <= floor(n * 0.35::DOUBLE) + floor(n * 0.05::DOUBLE) + floor(n * 0.1::DOUBLE)")
def g1_sample_splits(spark, sf_dir):
    rows = sampling.sample_splits(data_packets(spark, sf_dir), {"train": 0.7, "val": 0.1, "test": 0.2}, 0.5, [*FLOW, "pkt_idx"])
    return rows.select(*FLOW, "pkt_idx", "split")


@query("WITH e AS (SELECT DISTINCT user_id % 97 AS exp_id FROM events), r AS (SELECT exp_id, row_number() OVER (ORDER BY md5(concat_ws('|', '1', exp_id)), exp_id) AS rn, count(*) OVER () AS n FROM e) SELECT exp_id, CASE WHEN rn <= ceil(n * 0.3::DOUBLE) THEN 'test' WHEN rn <= ceil(n * 0.3::DOUBLE) + ceil(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def g2_disjoint_splits(spark, sf_dir):
    names = table(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("exp_id")).distinct()
    return sampling.disjoint_splits(names, {"train": 0.6, "val": 0.1, "test": 0.3})


@query("WITH s AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'high-fair-rate-a' ELSE event_type END AS subsplit FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY subsplit ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY subsplit) AS n FROM s) SELECT event_id, subsplit FROM r WHERE rn <= ceil(n * CASE WHEN contains(subsplit, 'high-fair-rate') THEN 0.25::DOUBLE ELSE 0.2::DOUBLE END)")
def g5_subsplit_fraction(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", "high-fair-rate-a").otherwise(F.col("event_type")).alias("subsplit"))
    return sampling.subsplit_fraction(rows, 0.2, ["event_id"])


@query(f"WITH {ORACLE_PACKETS} SELECT exp_id, CAST(ceil(count(*) * 0.1::DOUBLE) AS BIGINT) AS n FROM data GROUP BY exp_id")
def g6_random_percent(spark, sf_dir):
    return sampling.random_percent(data_packets(spark, sf_dir).select(*FLOW, "pkt_idx"), 10, [*FLOW, "pkt_idx"]).groupBy("exp_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH c AS (SELECT min(n) AS lo FROM (SELECT count(*) AS n FROM labels GROUP BY quality)), r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', '1', doc_id)), doc_id) AS rn FROM labels) SELECT doc_id, quality FROM r, c WHERE rn <= lo")
def g7_balance_drop(spark, sf_dir):
    return sampling.balance(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", ["doc_id"])


@query("WITH c AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) SELECT quality, n FROM (SELECT DISTINCT quality FROM labels), c")
def g7_balance_add(spark, sf_dir):
    return sampling.balance(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", ["doc_id"], "add").groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'value' AS feature, round(avg(value), 4) AS p1, round(stddev_pop(value), 4) AS p2 FROM events UNION ALL SELECT 'user_id', round(avg(user_id), 4), round(stddev_pop(user_id), 4) FROM events")
def g8_fit_scale(spark, sf_dir):
    return sampling.fit_scale(table(spark, sf_dir, "events"), ["value", "user_id"]).select("feature", F.round("p1", 4).alias("p1"), F.round("p2", 4).alias("p2"))


@query("WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events) SELECT event_id, round((value - a) / (b - a), 9) AS value FROM events, s")
def g9_apply_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    path = work_path(spark, "scale")
    files.save_scale_params(sampling.fit_scale(rows, ["value"], standardize=False), path)
    params = {r.feature: (r.p1, r.p2) for r in files.load_scale_params(spark, path).collect()}
    return sampling.apply_scale(rows, params, standardize=False).select("event_id", F.round("value", 9).alias("value"))


@query("WITH r AS (SELECT (rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) AS a, (rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0) AS b FROM lineitem) SELECT 'price' AS a, 'quantity' AS b, round(corr(a, b), 6) AS rho FROM r")
def g10_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"), F.lit(1.0).alias("constant"))
    return models.spearman_matrix(rows, ["quantity", "price", "constant"]).where("a < b").withColumn("rho", F.round("rho", 6))


def _training_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    rows = labelled(spark, sf_dir, columns=TRAINING_ROW, metrics=TRAINING_METRICS).where("label is not null").withColumn("label", F.col("label").cast("double"))
    columns = ["rtt_us_w8", "loss_rate_w8", "interarrival_us_w8", "tput_bps_w8"]
    return stored(rows.select(*FLOW, "pkt_idx", "label", *columns), "labelled"), columns


@query()
def g14_train_predict(spark, sf_dir):
    """Boosted trees against the rest on three quarters of the packets, scored on the others."""
    rows, columns = _training_rows(spark, sf_dir)
    ready = models.assemble(rows, columns, [*FLOW, "pkt_idx", "label"])
    model = models.train(ready.where("pkt_idx % 4 <> 0"), "trees", rounds=3)
    scored = models.predict(model, ready.where("pkt_idx % 4 = 0"))
    return scoring.classification_report(scored, "label", "prediction")


SELECTED = [f"{m}_w{k}" for k in (8, 32) for m in ("rtt_us", "loss_rate", "interarrival_us", "tput_bps", "mathis_tput_bps")]


def _wide_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled packets with the windows of 8 and 32."""
    rows = labelled(spark, sf_dir, [8, 32], TRAINING_ROW, TRAINING_METRICS).where("label is not null")
    return stored(rows.select(*FLOW, "pkt_idx", F.col("label").cast("double").alias("label"), *SELECTED), "wide-labelled")


@query()
def g14_train_predict_all(spark, sf_dir):
    """Ten rounds of boosted trees over the windows of 8 and 32."""
    rows = _wide_training_rows(spark, sf_dir)
    ready = models.assemble(rows, SELECTED, [*FLOW, "pkt_idx", "label"])
    model = models.train(ready.where("pkt_idx % 4 <> 0"), "trees", rounds=10)
    return scoring.classification_report(models.predict(model, ready.where("pkt_idx % 4 = 0")), "label", "prediction")


@query()
def g12_feature_selection(spark, sf_dir):
    """Clusters of correlated windows of 8 and 32, their importances to boosted trees over five repeats, and the best of each cluster."""
    rows = _wide_training_rows(spark, sf_dir)
    matrix = models.spearman_matrix(rows, SELECTED).toPandas().pivot(index="a", columns="b", values="rho")
    clusters = models.ward_clusters(matrix.to_numpy(), min(4, len(matrix)))
    model = models.train(models.assemble(rows, SELECTED, ["label"]), "trees", rounds=5)
    importances = models.permutation_importance(model, rows, SELECTED, "label", [*FLOW, "pkt_idx"], repeats=5)
    return models.select_features(importances, spark.createDataFrame([(f, int(c)) for f, c in zip(matrix.index, clusters)], "feature string, cluster int"))


# Bounds, schedules, key sets ----------------------------------------------------------


@query(f"WITH {ORACLE_PACKETS}, p AS (SELECT {KEY}, pkt_idx, arrival_us - 3600000000 AS target FROM data), n AS (SELECT {KEY}, max(pkt_idx) AS last FROM data GROUP BY {KEY}), nx AS (SELECT p.exp_id, p.sender_port, p.receiver_port, p.pkt_idx, min(d.pkt_idx) AS nxt FROM p LEFT JOIN data d ON d.exp_id = p.exp_id AND d.sender_port = p.sender_port AND d.arrival_us >= p.target GROUP BY ALL) SELECT exp_id, sender_port, receiver_port, pkt_idx, least(coalesce(nxt, last), last) AS after_idx, CASE WHEN nxt IS NULL THEN last ELSE greatest(nxt - 1, 0) END AS before_idx FROM nx JOIN n USING (exp_id, sender_port, receiver_port)")
def h2_find_bound(spark, sf_dir):
    data = data_packets(spark, sf_dir)
    rows = data.select(*FLOW, F.col("pkt_idx").alias("idx"), "arrival_us")
    probes = data.select(*FLOW, "pkt_idx", (F.col("arrival_us") - 3_600_000_000).alias("target"))
    after = joins.find_bound(rows, probes, FLOW, "arrival_us", "target", "after").select(*FLOW, "pkt_idx", F.col("bound").alias("after_idx"))
    before = joins.find_bound(rows, probes, FLOW, "arrival_us", "target", "before").select(*FLOW, "pkt_idx", F.col("bound").alias("before_idx"))
    return after.join(before, [*FLOW, "pkt_idx"])


@query("WITH s AS (SELECT user_id * 1.0 AS start_s, 2000 + user_id * 10 AS rwnd_b FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 0)), e AS (SELECT event_id, CAST(user_id AS DOUBLE) AS now_s FROM events) SELECT event_id, coalesce((SELECT arg_min(rwnd_b, start_s) FROM s WHERE start_s >= now_s), (SELECT arg_max(rwnd_b, start_s) FROM s)) AS rwnd_next, coalesce((SELECT arg_max(rwnd_b, start_s) FROM s WHERE start_s <= now_s), (SELECT arg_min(rwnd_b, start_s) FROM s)) AS rwnd_current FROM e")
def c9_schedule(spark, sf_dir):
    """A schedule written as CSV with comments, read back and looked up both ways."""
    events = table(spark, sf_dir, "events")
    path = work_path(spark, "schedule")
    lines = events.where("user_id % 10 = 0").select("user_id").distinct().select(F.format_string("%d.0,%d", "user_id", 2000 + F.col("user_id") * 10).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("# start,window").alias("value"))).write.text(path)
    schedule = files.read_schedule(spark, path)
    times = events.select("event_id", F.col("user_id").cast("double").alias("now_s"))
    ahead = joins.schedule_at(times, schedule).withColumnRenamed("rwnd_b", "rwnd_next")
    return joins.schedule_at(ahead, schedule, "current").select("event_id", "rwnd_next", F.col("rwnd_b").alias("rwnd_current"))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id FROM events WHERE value > 90) SELECT user_id, 'left' AS side FROM a WHERE user_id NOT IN (SELECT user_id FROM b) UNION ALL SELECT user_id, 'right' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)")
def h5_key_differences(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return joins.key_differences(events.where("event_type = 'error'"), events.where("value > 90"), ["user_id"])


@query("WITH f AS (SELECT user_id % 7 AS remote_addr, user_id AS remote_port, max(ts) AS seen FROM events GROUP BY ALL) SELECT remote_addr, remote_port FROM f WHERE remote_addr IN (SELECT user_id % 7 FROM events WHERE event_type = 'error' AND user_id % 7 < 3)")
def c12_flows_of_sender(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("remote_addr", F.col("user_id") % 7)
    flows = events.groupBy("remote_addr", F.col("user_id").alias("remote_port")).agg(F.max("ts").alias("seen")).drop("seen")
    return joins.flows_of_sender(flows, events.where("event_type = 'error' and remote_addr < 3"))


@query("WITH q AS (SELECT DISTINCT user_id, 16777343 + user_id * 256 AS a, user_id + 1000 AS p FROM events) SELECT user_id, concat(a & 255, '.', (a >> 8) & 255, '.', (a >> 16) & 255, '.', (a >> 24) & 255) AS quad, a AS number, concat('127.0.0.1:80->', a & 255, '.', (a >> 8) & 255, '.', (a >> 16) & 255, '.', (a >> 24) & 255, ':', p) AS flow FROM q")
def i_address_text(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("a", F.lit(16777343) + F.col("user_id") * 256)
    quad = u.dotted_quad(F.col("a"))
    return rows.select("user_id", quad.alias("quad"), u.little_endian(quad).alias("number"), u.flow_text(F.col("a"), F.col("user_id") + 1000, F.lit(16777343), F.lit(80)).alias("flow"))


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 17 ELSE 6 END AS protocol, CASE WHEN user_id % 3 = 0 THEN 22 ELSE 5201 END AS local_port, CASE WHEN user_id % 11 = 0 THEN 16777343 ELSE 1 END AS remote_addr FROM events) WHERE protocol = 6 AND local_port <> 22 AND remote_addr <> 16777343")
def b22_capture_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 5 == 0, 17).otherwise(6).alias("protocol"), F.when(F.col("user_id") % 3 == 0, 22).otherwise(5201).alias("local_port"), F.col("user_id").cast("int").alias("p"), F.when(F.col("user_id") % 11 == 0, 16777343).otherwise(1).alias("remote_addr"), F.lit(2).alias("local_addr")).withColumn("remote_port", F.col("p") + 10000)
    return pk.capture_filter(rows, [5201], True).select("event_id")


@query(f"WITH {ORACLE_PACKETS} SELECT {KEY}, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS direction, arrival_us, payload_b FROM data WHERE sender_port % 2 = 0")
def b3_normalize(spark, sf_dir):
    data = data_packets(spark, sf_dir)
    ack = F.col("k") % 2 == 0
    headers = data.select("exp_id", F.when(ack, 1).otherwise(2).alias("src_addr"), F.lit(1).alias("local_addr"), F.when(ack, F.col("receiver_port")).otherwise(F.col("sender_port")).alias("src_port"), F.when(ack, F.col("sender_port")).otherwise(F.col("receiver_port")).alias("dst_port"), F.floor(F.col("arrival_us") / 1_000_000).alias("sec"), (F.col("arrival_us") % 1_000_000).alias("usec"), (F.col("payload_b") + 52).alias("ip_len"), F.lit(5).alias("ihl"), F.lit(32).alias("transport_header_b"), "seq", F.lit(None).cast("long").alias("tsval"), "tsecr", "wire_b")
    return pk.normalize(headers, data.where("sender_port % 2 = 0")).select(*FLOW, "direction", "arrival_us", "payload_b")


# Text and JSON sources ----------------------------------------------------------------


@query("WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'deq' ELSE 'enq' END AS event, user_id AS port, CAST(floor(value) AS BIGINT) AS size, event_id FROM events) SELECT event, port, count(*) AS n, CAST(sum(size) AS BIGINT) AS payload_b, CAST(sum(event_id % 5) AS BIGINT) AS queued FROM e GROUP BY ALL")
def a3_queue_log(spark, sf_dir):
    """A queue log (numbers in hex and decimal) written as text and parsed."""
    path = work_path(spark, "queue-log")
    field = lambda c: F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex(c)))).otherwise(c.cast("string"))
    e = table(spark, sf_dir, "events").withColumn("size", F.floor("value"))
    line = F.concat_ws(",", F.when(F.col("event_type") == "error", "1").otherwise("0"), field(F.col("event_id") * 1000), field(F.col("user_id")), field(F.col("event_id")), field(F.col("size")), F.lit("7"), F.lit("0"), field(F.col("event_id") % 5), F.lit("1"))
    e.select(line.alias("value")).write.text(path)
    events, _ = files.read_queue_log(spark, path)
    return events.groupBy("event", "port").agg(F.count(F.lit(1)).alias("n"), F.sum("payload_b").alias("payload_b"), F.sum("queued").alias("queued"))


@query("SELECT p, round(value, 6) AS value FROM (SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]) AS p, unnest(quantile_cont(CAST(floor(value) AS DOUBLE), [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0])) AS value FROM events WHERE event_type <> 'error')")
def a6_skb_lengths(spark, sf_dir):
    path = work_path(spark, "skb")
    table(spark, sf_dir, "events").select(F.concat(F.when(F.col("event_type") == "error", "note").otherwise("len"), F.lit(",x,"), F.floor("value").cast("string")).alias("value")).write.text(path)
    return reports.percentiles(files.parse_skb_lengths(spark.read.text(path)), "len", [], reports.LENGTH_PERCENTILES).withColumn("value", F.round("value", 6))


@query("WITH u AS (SELECT user_id, sum(value) AS s, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS n, round(sum(s), 3) AS tput_bps, round(sum(n / 4.0), 6) AS retrans_per_s, 0.0 AS cpu_host_user FROM u")
def a7_load_reports(spark, sf_dir):
    """One JSON report per user, some fields missing."""
    path = work_path(spark, "reports")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    end = F.struct(F.struct(F.col("s").alias("bits_per_second")).alias("sum_received"), F.struct(F.col("n").alias("retransmits"), F.lit(1.0).alias("start"), F.lit(5.0).alias("end")).alias("sum_sent"))
    per.select(F.to_json(F.struct(end.alias("end"))).alias("value")).repartition("value").write.text(path)
    rows = files.read_load_reports(spark, path, one_per_line=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("tput_bps"), 3).alias("tput_bps"), F.round(F.sum("retrans_per_s"), 6).alias("retrans_per_s"), F.max("cpu_host_user").alias("cpu_host_user"))


@query("WITH x AS (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id) SELECT user_id, round(v, 2) AS accuracy FROM x")
def a8_training_logs(spark, sf_dir):
    """Tagged log lines; the last of each tag counts."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.explode(F.array(F.concat(F.lit("INFO Test accuracy: "), F.format_number("value", 2)), F.lit("INFO nothing"))).alias("value"))
    return files.parse_training_log(rows.withColumn("value", F.regexp_replace("value", ",", ""))).select(F.col("file").alias("user_id"), F.round("accuracy", 2).alias("accuracy"))


@query("SELECT round(avg(CAST(floor(value * 100) AS BIGINT)), 6) AS \"System_L2MISS\", round(avg(user_id), 6) AS \"Core0_L3MISS\" FROM events")
def a5_host_counters(spark, sf_dir):
    """A counter file with two header rows and a line to skip."""
    path = work_path(spark, "counters")
    body = table(spark, sf_dir, "events").select(F.concat_ws(",", F.floor(F.col("value") * 100).cast("string"), F.lit("1"), F.col("user_id").cast("string")).alias("value"))
    heads = F.lit("System,System,Core0\nL2MISS,L3MISS,L3MISS\nCounter X is disabled")
    whole = body.groupBy(F.spark_partition_id().alias("p")).agg(F.concat_ws("\n", heads, F.array_join(F.collect_list("value"), "\n")).alias("value"))
    whole.select("value", "p").repartition("p").select("value").write.option("lineSep", "\n").text(path)
    rows = files.read_host_counters(spark, path, [("System", "L2MISS"), ("Core0", "L3MISS")])
    return reports.counter_means(rows, ["System_L2MISS", "Core0_L3MISS"]).select(F.round("System_L2MISS", 6).alias("System_L2MISS"), F.round("Core0_L3MISS", 6).alias("Core0_L3MISS"))


@query("WITH u AS (SELECT DISTINCT user_id FROM events) SELECT concat('unfair-', 'pcc-cubic-', 1 + user_id % 9, 'bw-30rtt-64q-1pcc-', 1 + user_id % 3, 'cubic-unfairTrue-100s-', user_id) AS exp_name, 'cubic' AS cca_2, CAST(1 + user_id % 3 AS INT) AS flows_2, (1 + user_id % 9) * 1e6 AS bw_bps, round(64 / ((1 + user_id % 9) * 30000 / 8.0 / 1514), 9) AS queue_bdp, round(65 * 1514 * 8 / ((1 + user_id % 9) * 1e6) * 1e6 + 30000, 6) AS max_rtt_us, true AS use_monitor FROM u WHERE user_id % 4 <> 0")
def b1_experiment_names(spark, sf_dir):
    """Names by the 11-token grammar, a quarter of them broken."""
    ids = table(spark, sf_dir, "events").select("user_id").distinct()
    good = F.concat(F.lit("unfair-pcc-cubic-"), (1 + F.col("user_id") % 9).cast("string"), F.lit("bw-30rtt-64q-1pcc-"), (1 + F.col("user_id") % 3).cast("string"), F.lit("cubic-unfairTrue-100s-"), F.col("user_id").cast("string"))
    names = ids.select(F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("bad-"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("/data/"), good, F.lit(".tar.gz"))).alias("exp_name"))
    parsed, _ = ex.parse_names(names)
    return parsed.select("exp_name", "cca_2", "flows_2", "bw_bps", F.round("queue_bdp", 9).alias("queue_bdp"), F.round("max_rtt_us", 6).alias("max_rtt_us"), "use_monitor")


@query(f"WITH {ORACLE_PACKETS} SELECT exp_id, count(*) AS n FROM data WHERE exp_id > 1 GROUP BY exp_id")
def a9_write_features(spark, sf_dir):
    """Writes experiments 2 to 4 beside finished 0 and 1, and counts what is new."""
    data, path = data_packets(spark, sf_dir), work_path(spark, "features")
    files.write_features(data.where("exp_id < 2"), path)
    done = files.finished_experiments(spark, path)
    files.write_features(data, path, stored(done, "done"))
    return spark.read.parquet(path).where("exp_id > 1").groupBy(F.col("exp_id").cast("long").alias("exp_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ORACLE_PACKETS} SELECT 'train' AS split, count(*) AS n, list_sort(list(DISTINCT exp_id)) AS exp_ids FROM data WHERE k % 2 = 0 GROUP BY 1")
def a10_write_splits(spark, sf_dir):
    rows, path = data_packets(spark, sf_dir), work_path(spark, "splits")
    files.write_splits(rows.withColumns({"split": F.when(F.col("k") % 2 == 0, "train").otherwise("test"), "subsplit": F.concat(F.lit("part-"), F.col("sender_id").cast("string"))}), path)
    train = files.read_split(spark, path, "train")
    return files.split_manifest(train).join(train.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split").select("split", "n", "exp_ids")


@query("WITH u AS (SELECT user_id % 5 AS e, min(user_id) AS lo, max(user_id) AS hi, count(*) AS n FROM events GROUP BY ALL) SELECT CAST(e AS VARCHAR) AS exp_name, 'cubic' AS cca, unnest([lo, hi]) AS sender_port, CAST(n AS INT) AS n_flows, 12.5 AS rate_mbps FROM u")
def a2_params(spark, sf_dir):
    """Parameter documents of five experiments, written one per file and read into flows and bottleneck changes."""
    path = work_path(spark, "params")
    per = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("e")).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"), F.count(F.lit(1)).alias("n"))
    text = F.format_string('{"category": "shared", "bess_bw_Mbps": 100, "sender_bottlenecks": {"a": [{"time_s": 0, "rate_Mbps": 12.5}]}, "flowsets": [[["s%d"], ["r", 1, 2, 3, 4, 5, 6, "10.0.0.1"], "cubic", 0, 10, [%d, %d], 5201, 0, 0, %d]]}', "e", "lo", "hi", "n")
    per.select(F.col("e").cast("string").alias("name"), text.alias("value")).repartition("name").write.partitionBy("name").text(path)
    _, flows, changes = files.read_params(spark, f"{path}/name=*")
    rate = changes.groupBy().agg(F.max("rate_mbps").alias("rate_mbps"))
    return flows.join(F.broadcast(rate)).select(F.substring("sender", 2, 20).alias("exp_name"), "cca", "sender_port", "n_flows", "rate_mbps")


# Streams ------------------------------------------------------------------------------


@query("SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600000000 AS start_us, count(*) AS packets, CAST(sum(CAST(floor(value * 10) AS BIGINT) + 166) AS BIGINT) AS bytes FROM events GROUP BY 1")
def j16_ingress_rate(spark, sf_dir):
    """Hourly tumbling windows in update mode; the last row of a window is its total."""
    rows = live.run_to_end(live.ingress_rate(live.packet_stream(spark, sf_dir), "1 hour", "400 days"), "ingress", "update")
    return rows.groupBy("start_us").agg(F.max_by("packets", "batch").alias("packets"), F.max_by("bytes", "batch").alias("bytes"))


@query("WITH e AS (SELECT user_id + 10000 AS sender_port, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sender_port ORDER BY t) < 86400000000 THEN 0 ELSE 1 END AS brk FROM e), s AS (SELECT *, sum(brk) OVER (PARTITION BY sender_port ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT sender_port, min(t) AS start_us, max(t) + 86400000000 AS end_us, count(*) AS packets FROM s GROUP BY sender_port, sid")
def j5_active_sessions(spark, sf_dir):
    """Session windows of a day's gap, as the stream's batch twin (the same plan on the same table)."""
    rows = table(spark, sf_dir, "events").select(F.timestamp_micros(wall_micros("ts")).alias("ts"), (F.col("user_id") + 10000).alias("sender_port"))
    return live.active_sessions(rows, "1 day")


TICKS = 400


def _raw_stream(spark: SparkSession, sf_dir: str, ticks: int = 1) -> DataFrame:
    """Raw packets of both directions as a stream of one micro-batch."""
    path = work_path(spark, "raw-packets")
    raw_packets(data_packets(spark, sf_dir), ticks).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _oracle_round_trips(ticks: int) -> str:
    return f"WITH {ORACLE_PACKETS}, sent AS (SELECT sender_port, tsecr // {ticks} AS tsval, arrival_us - gen_rtt_us AS sent_us FROM data WHERE k % 10 <> 0) SELECT sender_port, arrival_us, tsecr // {ticks} AS tsecr, (arrival_us - (SELECT max(sent_us) FROM sent s WHERE s.sender_port = d.sender_port AND s.tsval = d.tsecr // {ticks} AND sent_us < d.arrival_us))::DOUBLE AS rtt_us FROM data d"


@query(_oracle_round_trips(TICKS))
def j1_stream_rtt(spark, sf_dir):
    """Every received packet with the time since the last send of the TSval it echoes, of which a flow sends many twice; null where there was none."""
    rows = online.round_trips(online.watched(_raw_stream(spark, sf_dir, TICKS), "1 hour"), carry=[])
    return live.run_to_end(rows.select("sender_port", "arrival_us", "tsecr", "rtt_us"), "rtt")


@query(_oracle_round_trips(1))
def j1_stream_rtt_all(spark, sf_dir):
    """The same where every TSval is unique: each packet has its own RTT, or none where its TSval was never sent."""
    rows = online.round_trips(online.watched(_raw_stream(spark, sf_dir), "1 hour"), carry=[])
    return live.run_to_end(rows.select("sender_port", "arrival_us", "tsecr", "rtt_us"), "rtt-all")


WATCHED, WATCHED_EWMAS = [8, 32], [("rtt_us", 0.1), ("rtt_us", 0.5), ("interarrival_us", 0.1)]
LIVE_DIGITS = {f"{m}_w{k}": d for k in WATCHED for m, d in (("interarrival_us", 3), ("tput_bps", 9), ("rtt_us", 3), ("loss_rate", 9), ("mathis_tput_bps", 6))} | {"loss_event_rate": 9, "min_rtt_us": 0, "rtt_us_ewma_a0_1": 3, "rtt_us_ewma_a0_5": 3, "interarrival_us_ewma_a0_1": 3, "target_bps": 6}


def _oracle_live() -> str:
    """One evaluation per flow, since the table is one micro-batch: the last ten packets, what their longest window needs, and the first decision."""
    longest, flow = max(WATCHED), "sender_port"
    ewma = lambda x, e, a: f"CASE WHEN {e} IS NULL OR {e} = 0 THEN {x} WHEN {x} IS NULL OR {x} = 0 THEN {e} ELSE {a}::DOUBLE * {x} + {1 - a}::DOUBLE * {e} END"
    inside = lambda k, what: f"(SELECT {what} FROM kept q WHERE q.sender_port = j.sender_port AND q.idx BETWEEN j.s{k}"
    starts = ", ".join(f"least(idx - 1, (SELECT min(q.idx) FROM kept q WHERE q.sender_port = kept.sender_port AND q.arrival_us >= kept.arrival_us - {k} * kept.low)) AS s{k}" for k in WATCHED)
    sums = ", ".join(f"arrival_us - (SELECT arrival_us FROM kept q WHERE q.sender_port = j.sender_port AND q.idx = j.s{k}) AS span{k}, {inside(k, 'sum(wire_b)')} + 1 AND j.idx) AS bytes{k}, {inside(k, 'sum(lost)')} + 1 AND j.idx) AS gone{k}, {inside(k, 'avg(rtt)')} AND j.idx) AS rtts{k}" for k in WATCHED)
    values = ", ".join(f"age >= {k} * low AS ok{k}, CASE WHEN age >= {k} * low THEN span{k} / (idx - s{k})::DOUBLE END AS interarrival_us_w{k}, CASE WHEN age >= {k} * low THEN bytes{k} * 8e6 / nullif(span{k}, 0) END AS tput_bps_w{k}, CASE WHEN age >= {k} * low THEN rtts{k} END AS rtt_us_w{k}, CASE WHEN age >= {k} * low THEN gone{k} / (gone{k} + idx - s{k})::DOUBLE END AS loss_rate_w{k}" for k in WATCHED)
    model = ", ".join(f"8e6 * payload_b * sqrt(1.5::DOUBLE) / nullif(rtt, 0) / sqrt(nullif(loss_rate_w{k}, 0)) AS mathis_tput_bps_w{k}" for k in WATCHED)
    columns = ", ".join(f"round({c}, {d}) AS {c}" for c, d in LIVE_DIGITS.items())
    rtt = "CASE WHEN k % 10 <> 0 THEN gen_rtt_us::DOUBLE END"
    return f"""WITH RECURSIVE {ORACLE_PACKETS}, src AS (SELECT {KEY}, pkt_idx, arrival_us, seq, payload_b, wire_b, {rtt} AS rtt FROM data),
{loss_event_oracle('src', 'rtt', (8,))},
pk AS (SELECT s.*, coalesce(g.lost, 0) AS lost, coalesce(r.rate8, 0) AS loss_event_rate, row_number() OVER (PARTITION BY s.sender_port ORDER BY pkt_idx DESC) AS back, min(rtt) OVER (PARTITION BY s.sender_port) AS low, min(s.arrival_us) OVER (PARTITION BY s.sender_port) AS first_us
  FROM src s LEFT JOIN gaps g USING ({KEY}, pkt_idx) LEFT JOIN rates r USING ({KEY}, pkt_idx)),
ready AS (SELECT p.sender_port, min(q.pkt_idx) AS lead, p.pkt_idx AS tenth FROM pk p JOIN pk q ON q.sender_port = p.sender_port AND q.arrival_us >= p.arrival_us - {longest} * p.low WHERE p.back = 10 AND p.pkt_idx > 0 AND p.arrival_us - p.first_us >= {longest} * p.low GROUP BY p.sender_port, p.pkt_idx),
kept AS (SELECT pk.*, pkt_idx - least(lead, tenth - 1) AS idx, count(*) OVER (PARTITION BY pk.sender_port) AS packets, arrival_us - min(arrival_us) OVER (PARTITION BY pk.sender_port) AS age,
  greatest(arrival_us - lag(arrival_us) OVER (PARTITION BY pk.sender_port ORDER BY pkt_idx), 1)::DOUBLE AS gap FROM pk JOIN ready USING (sender_port) WHERE pkt_idx >= least(lead, tenth - 1)),
ew AS (SELECT sender_port, idx, rtt AS e1, rtt AS e5, NULL::DOUBLE AS g1 FROM kept WHERE idx = 0
  UNION ALL SELECT n.sender_port, n.idx, {ewma('n.rtt', 'e.e1', 0.1)}, {ewma('n.rtt', 'e.e5', 0.5)}, {ewma('n.gap', 'e.g1', 0.1)} FROM kept n JOIN ew e ON n.sender_port = e.sender_port AND n.idx = e.idx + 1),
st AS (SELECT *, {starts} FROM kept WHERE back <= 10),
sm AS (SELECT *, {sums} FROM st j),
va AS (SELECT *, {values} FROM sm),
mo AS (SELECT *, {model} FROM va),
lb AS (SELECT sender_port, avg(tput_bps_w8 / nullif(mathis_tput_bps_w8, 0)) AS r, arg_max(coalesce(tput_bps_w8, -1), arrival_us * 1000 - back) AS measured FROM mo GROUP BY sender_port),
de AS (SELECT *, CASE WHEN r < 0.9 THEN 0 WHEN r <= 1.1 THEN 1 WHEN r > 1.1 THEN 2 END AS label, CASE WHEN r > 1.1 AND measured >= 0 THEN measured / 2 END AS target_bps FROM lb)
SELECT mo.sender_port, mo.arrival_us, mo.packets, {columns.replace('min_rtt_us, 0) AS', 'low, 0) AS').replace('round(rtt_us_ewma_a0_1', 'round(e1').replace('round(rtt_us_ewma_a0_5', 'round(e5').replace('round(interarrival_us_ewma_a0_1', 'round(g1')}, label,
  CASE WHEN target_bps IS NULL THEN 1 ELSE 0 END AS decision, CASE WHEN target_bps IS NOT NULL THEN CAST(greatest(round_even(target_bps / 8 * low / 1e6, 0), 2000) AS BIGINT) END AS rwnd_b
FROM mo JOIN ew ON mo.sender_port = ew.sender_port AND mo.idx = ew.idx JOIN de ON mo.sender_port = de.sender_port"""


def _live_rows(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Raw packets of both directions to round trips to features, labels and decisions: two chained states."""
    trips = online.round_trips(online.watched(_raw_stream(spark, sf_dir), "1 hour"))
    return online.decide_live(trips, WATCHED, WATCHED_EWMAS, late=None, idle_s=3600, **options)


@query(_oracle_live())
def j8_live_decisions(spark, sf_dir):
    """Raw packets to features, labels and decisions: J1, J2, J3, J4, J8, J12, J15 and W13 as one streaming job."""
    rows = live.run_to_end(_live_rows(spark, sf_dir), "online").where("event = 'features'")
    return rows.select("sender_port", "arrival_us", "packets", *[F.round(c, d).alias(c) for c, d in LIVE_DIGITS.items()], "label", "decision", "rwnd_b")


@query(f"""WITH f AS ({_oracle_live()}), {ORACLE_PACKETS}, z AS (SELECT sender_port, max(arrival_us) AS newest, min(CASE WHEN k % 10 <> 0 THEN gen_rtt_us::DOUBLE END) AS low, count(*) AS n FROM data GROUP BY sender_port)
SELECT sender_port, 'features' AS event, arrival_us, packets, min_rtt_us FROM f UNION ALL SELECT sender_port, 'open', newest, n, low FROM z
UNION ALL SELECT sender_port, 'removed', newest, (SELECT count(DISTINCT f.sender_port) FROM f WHERE f.sender_port = z.sender_port), low FROM z WHERE newest // 1000 + 3600000 <= (SELECT max(newest) // 1000 - 3600000 FROM z)""")
def j2_track_flows(spark, sf_dir):
    """What a flow's state tells of it: that it is there, its features, and that it was removed after an idle hour (packets: its evaluations)."""
    return live.run_to_end(_live_rows(spark, sf_dir, announce=True), "flows").select("sender_port", "event", "arrival_us", "packets", "min_rtt_us")


@query("WITH e AS (SELECT user_id + 10000 AS sender_port, epoch_us(ts) AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY sender_port ORDER BY t) < 86400000000 THEN 0 ELSE 1 END AS brk FROM e), s AS (SELECT *, sum(brk) OVER (PARTITION BY sender_port ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g), o AS (SELECT sender_port, min(t) AS start_us, max(t) + 86400000000 AS end_us, count(*) AS packets FROM s GROUP BY sender_port, sid) SELECT * FROM o WHERE end_us <= (SELECT (max(t) // 1000 - 60000) * 1000 FROM e)")
def j5_closed_sessions(spark, sf_dir):
    """The sessions that the stream has closed when its source ends: those whose gap passed a minute before the newest packet."""
    return live.run_to_end(live.active_sessions(live.packet_stream(spark, sf_dir), "1 day", "1 minute"), "sessions")


def _decisions(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    rows = data_packets(spark, sf_dir).select(*FLOW, "pkt_idx", (F.col("k") % 3).alias("label"), (F.col("payload_b") * 8000.0).alias("tput_bps"), F.lit(20000.0).alias("min_rtt_us"))
    return live.decisions(rows, FLOW, "pkt_idx", strategy)


O_DECIDE = f"""WITH RECURSIVE {ORACLE_PACKETS},
x AS (SELECT {KEY}, pkt_idx, k % 3 AS label, payload_b * 8000.0::DOUBLE AS tput FROM data),
d AS (SELECT {KEY}, pkt_idx, CASE WHEN label = 2 THEN tput / 2 END AS paced FROM x WHERE pkt_idx = 0
 UNION ALL SELECT x.exp_id, x.sender_port, x.receiver_port, x.pkt_idx, CASE WHEN x.label = 2 THEN coalesce(d.paced, x.tput) / 2 WHEN d.paced IS NOT NULL AND x.label = 0 THEN d.paced + 1e6 ELSE d.paced END
 FROM x JOIN d ON x.exp_id = d.exp_id AND x.sender_port = d.sender_port AND x.pkt_idx = d.pkt_idx + 1)"""


@query(O_DECIDE + f" SELECT {KEY}, pkt_idx, CASE WHEN paced IS NULL THEN 1 ELSE 0 END AS decision, round(paced, 6) AS target_bps FROM d")
def j12_decisions(spark, sf_dir):
    return _decisions(spark, sf_dir, "aimd").select(*FLOW, "pkt_idx", "decision", F.round("target_bps", 6).alias("target_bps"))


@query(O_DECIDE + f""", w AS (SELECT {KEY}, pkt_idx, CASE WHEN paced IS NULL THEN 1 ELSE 0 END AS decision, CAST(greatest(round_even(paced / 8 * 20000 / 1e6, 0), CASE WHEN paced IS NULL THEN 2000.0 ELSE 2000.0 END) AS BIGINT) AS rwnd_b FROM d),
c AS (SELECT *, lag(decision) OVER o AS pd, lag(rwnd_b) OVER o AS pw FROM w WINDOW o AS (PARTITION BY {KEY} ORDER BY pkt_idx)) SELECT {KEY}, pkt_idx, decision, rwnd_b FROM c WHERE pd IS NULL OR pd <> decision OR pw IS DISTINCT FROM rwnd_b""")
def j15_apply_decisions(spark, sf_dir):
    return live.apply_decisions(_decisions(spark, sf_dir, "aimd"), FLOW, "pkt_idx").select(*FLOW, "pkt_idx", "decision", "rwnd_b")


@query(f"WITH {ORACLE_PACKETS}, s AS (SELECT exp_id, sender_id, avg(CAST(gen_rtt_us AS DOUBLE)) AS rtt, (count(*) FILTER (k % 17 = 0)) / count(*)::DOUBLE AS l, count(DISTINCT sender_port) AS n FROM data GROUP BY ALL) SELECT exp_id, sender_id, round(8e6 * 1448 * sqrt(1.5::DOUBLE) / rtt / sqrt(nullif(l / (4 + 5e4 * l), 0)) / n, 6) AS target_bps FROM s")
def j13_decide_sender(spark, sf_dir):
    rows = data_packets(spark, sf_dir).groupBy("exp_id", "sender_id").agg(F.avg(F.col("gen_rtt_us").cast("double")).alias("rtt_us"), F.avg((F.col("k") % 17 == 0).cast("double")).alias("loss_rate"), F.countDistinct("sender_port").alias("n_flows"), F.min("gen_rtt_us").alias("min_rtt_us"))
    return live.decide_sender(rows).select("exp_id", "sender_id", F.round("target_bps", 6).alias("target_bps"))


@query(f"WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, any_value(sender_id) AS sender_id, count(*) AS n, max(arrival_us) AS z FROM data GROUP BY {KEY}), m AS (SELECT max(z) AS z FROM f) SELECT sender_id, bool_and(n >= 60) AS ready, count(*) AS n_flows FROM f, m WHERE f.z >= m.z - 432000000000 GROUP BY sender_id")
def j11_sender_ready(spark, sf_dir):
    flows = data_packets(spark, sf_dir).groupBy(*FLOW, "sender_id").agg(F.count(F.lit(1)).alias("n"), F.max("arrival_us").alias("z"))
    latest = flows.agg(F.max("z").alias("_z"))
    return live.sender_ready(flows.join(F.broadcast(latest)), F.col("n") >= 60, F.col("z") >= F.col("_z") - 432_000_000_000)


MERGED = ["rtt_us", "loss_event_rate", "loss_rate", "tput_bps", "min_rtt_us"]


def _oracle_sender_merge(more: str = "") -> str:
    """Each flow at the last ten times of its sender, between its packets before and after."""
    at = lambda c: f"CASE WHEN b.{c} IS NULL THEN a.{c} WHEN a.{c} IS NULL OR a.arrival_us = b.arrival_us THEN b.{c} ELSE b.{c} + (t - b.arrival_us) / (a.arrival_us - b.arrival_us)::DOUBLE * (a.{c} - b.{c}) END AS {c}"
    how = {"rtt_us": "avg", "loss_event_rate": "min", "loss_rate": "avg", "tput_bps": "sum", "min_rtt_us": "min"}
    values = ", ".join(f"{f}({c}) AS {c}" for c, f in how.items())
    return f"""WITH {ORACLE_PACKETS}, v AS (SELECT sender_id, sender_port, arrival_us, tsecr, gen_rtt_us::DOUBLE AS rtt_us, 1 / (k + 2)::DOUBLE AS loss_event_rate, 1 / (k + 3)::DOUBLE AS loss_rate, payload_b::DOUBLE AS tput_bps, gen_rtt_us::DOUBLE AS min_rtt_us FROM data),
ti AS (SELECT sender_id, arrival_us AS t, n FROM (SELECT *, row_number() OVER (PARTITION BY sender_id ORDER BY arrival_us DESC, sender_port) AS n FROM v) WHERE n <= 10),
fl AS (SELECT DISTINCT sender_id, sender_port FROM v),
br AS (SELECT fl.sender_id, fl.sender_port, t, n, (SELECT max(arrival_us) FROM v WHERE v.sender_port = fl.sender_port AND v.arrival_us <= t) AS tb, (SELECT min(arrival_us) FROM v WHERE v.sender_port = fl.sender_port AND v.arrival_us >= t) AS ta FROM fl JOIN ti USING (sender_id)),
va AS (SELECT br.sender_id, t, n, {", ".join(map(at, how))} FROM br LEFT JOIN v b ON b.sender_port = br.sender_port AND b.arrival_us = tb LEFT JOIN v a ON a.sender_port = br.sender_port AND a.arrival_us = ta),
ag AS (SELECT sender_id, t, n, {values} FROM va GROUP BY ALL)
SELECT sender_id, 1 AS epoch, t AS arrival_us, {", ".join(f"round({c}, 6) AS {c}" for c in how)}, round(8e6 * 1448 * sqrt(1.5::DOUBLE) / nullif(rtt_us, 0) / sqrt(nullif(loss_event_rate, 0)), 6) AS mathis_bps{more} FROM ag"""


@query(_oracle_sender_merge())
def j10_sender_merge(spark, sf_dir):
    rows = data_packets(spark, sf_dir).select("sender_id", "sender_port", F.lit(1).alias("epoch"), "arrival_us", F.col("gen_rtt_us").cast("double").alias("rtt_us"), (1 / (F.col("k") + 2)).alias("loss_event_rate"), (1 / (F.col("k") + 3)).alias("loss_rate"), F.col("payload_b").cast("double").alias("tput_bps"), F.col("gen_rtt_us").cast("double").alias("min_rtt_us"))
    n = rows.groupBy("sender_id").agg(F.countDistinct("sender_port").alias("n_flows"))
    out = live.sender_merge(join_spread(rows, n, ["sender_id"], ["sender_port"]))
    return out.select("sender_id", "epoch", "arrival_us", *[F.round(c, 6).alias(c) for c in [*MERGED, "mathis_bps"]])


@query(f"""WITH o AS ({_oracle_sender_merge(", n, (SELECT count(DISTINCT sender_port) FROM v WHERE v.sender_id = ag.sender_id) AS n_flows, rtt_us AS r, loss_event_rate AS l, min(min_rtt_us) OVER (PARTITION BY sender_id) AS low")}),
d AS (SELECT sender_id, 8e6 * 1448 * sqrt(1.5::DOUBLE) / r / sqrt(l / (4 + 5e4 * l)) / n_flows AS rate, low FROM o WHERE n = 1)
SELECT sender_id, epoch, arrival_us, {", ".join(MERGED)}, mathis_bps, n_flows, round(rate, 6) AS target_bps, CAST(greatest(round_even(rate / 8 * d.low / 1e6, 0), 2000) AS BIGINT) AS rwnd_b FROM o JOIN d USING (sender_id)""")
def j10_live_senders(spark, sf_dir):
    """J10, J11 and J13 on a stream: a sender's flows wait for each other in keyed state, are merged and decided."""
    events = table(spark, sf_dir, "events")
    n = events.groupBy((F.col("user_id") % 3).alias("sender_id")).agg(F.countDistinct("user_id").alias("n_flows"))
    k = F.col("k")
    rows = live.packet_stream(spark, sf_dir).join(n, "sender_id").select("sender_id", "sender_port", F.lit("features").alias("event"), F.lit(1).cast("long").alias("epoch"), "n_flows", "arrival_us", ((k + 1) * 1e9).alias("rtt_us"), (1 / (k + 2)).alias("loss_event_rate"), (1 / (k + 3)).alias("loss_rate"), F.col("payload_b").cast("double").alias("tput_bps"), ((k + 1) * 1e9).alias("min_rtt_us"))
    out = live.run_to_end(online.decide_senders(rows), "senders")
    return out.select("sender_id", "epoch", "arrival_us", *[F.round(c, 6).alias(c) for c in [*MERGED, "mathis_bps"]], "n_flows", F.round("target_bps", 6).alias("target_bps"), "rwnd_b")
