"""Queries over packets: features, windows, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtally.functions import unknown as u
from flowtally.functions.registry import ALPHAS, EWMA, ewma_name
from flowtally.operators import fairness, features, joins, packets as pk, recurrences, windows as win
from flowtally.plans.registry import query
from flowtally.sources.shared import stored
from flowtally.sources.tables import FLOW, ORACLE_PACKETS, ack_packets, bandwidths, data_packets

KEY = "exp_id, sender_port, receiver_port"
WINDOWS = [1, 8, 32, 1024]


def with_rtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = data_packets(spark, sf_dir)
    return joins.match_rtt_tcp(joins.is_retransmission(data), ack_packets(data))


def with_features(spark: SparkSession, sf_dir: str, columns: list[str] = ["*"]) -> DataFrame:
    rows = joins.attach_exp_meta(joins.active_flows(with_rtt(spark, sf_dir)), bandwidths(spark))
    return stored(features.row_features(rows).select(*columns), "features")


O_RETRANS = ORACLE_PACKETS + f""",
ep AS (SELECT *, sum(w) OVER (PARTITION BY {KEY} ORDER BY pkt_idx) AS seq_epoch FROM (SELECT *, coalesce(lag(CASE WHEN seq + payload_b > 4294967296 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY pkt_idx), 0) AS w FROM data)),
rt AS (SELECT *, lag(seq) OVER e AS prev_seq, lag(payload_b) OVER e AS prev_payload_b,
  max(seq) OVER (PARTITION BY {KEY}, seq_epoch ORDER BY pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_seq,
  row_number() OVER (PARTITION BY {KEY}, seq ORDER BY pkt_idx) AS nth FROM ep WINDOW e AS (PARTITION BY {KEY}, seq_epoch ORDER BY pkt_idx)),
re AS (SELECT *, nth > 1 OR coalesce(prev_seq + prev_payload_b > seq, false) AS is_retrans FROM rt)"""
O_RTT = O_RETRANS + f""",
fa AS (SELECT {KEY}, tsval, arg_min(ack_us, ack_idx) AS ack_us, min(ack_idx) AS ack_idx FROM acks GROUP BY {KEY}, tsval),
jn AS (SELECT re.*, fa.ack_us, fa.ack_idx, re.pkt_idx > 0 AND NOT re.is_retrans AS eligible FROM re LEFT JOIN fa ON re.exp_id = fa.exp_id AND re.sender_port = fa.sender_port AND re.receiver_port = fa.receiver_port AND re.tsecr = fa.tsval),
ah AS (SELECT *, max(CASE WHEN eligible THEN ack_idx END) OVER (PARTITION BY {KEY} ORDER BY pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM jn),
hi AS (SELECT *, eligible AND ack_idx IS NOT NULL AND ack_idx >= coalesce(ahead, -1) AS hit FROM ah),
gr AS (SELECT *, sum(CASE WHEN hit OR NOT eligible THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY pkt_idx) AS grp FROM hi),
rtt AS (SELECT *, first_value(CASE WHEN hit THEN CAST(arrival_us - ack_us AS DOUBLE) END) OVER (PARTITION BY {KEY}, grp ORDER BY pkt_idx) AS rtt_us FROM gr)"""
O_ACTIVE = f""",
bounds AS (SELECT {KEY}, min(arrival_us) AS first_us, max(arrival_us) AS last_us FROM data GROUP BY {KEY}),
act AS (SELECT d.exp_id, d.sender_port, d.receiver_port, d.pkt_idx, count(*) AS active_flows FROM data d JOIN bounds b ON d.exp_id = b.exp_id AND d.arrival_us BETWEEN b.first_us AND b.last_us GROUP BY ALL)"""
O_FEATURES = O_RTT + O_ACTIVE + f""",
f0 AS (SELECT rtt.*, act.active_flows, bw.bw_bps, bw.use_bess,
  sum(rtt.wire_b) OVER u AS total_so_far_b, sum(rtt.payload_b) OVER u AS payload_so_far_b,
  CASE WHEN prev_seq IS NOT NULL AND rtt.payload_b > 0 AND prev_payload_b > 0 AND highest_seq = prev_seq AND NOT is_retrans THEN round_even((seq - prev_payload_b - prev_seq) / rtt.payload_b::DOUBLE, 0) END AS pkts_lost,
  CAST(rtt.arrival_us - lag(rtt.arrival_us) OVER u AS DOUBLE) AS interarrival_us,
  coalesce(min(CASE WHEN rtt_us <> 0 THEN rtt_us END) OVER u, 9223372036854775807.0::DOUBLE) AS min_rtt_us
  FROM rtt JOIN act ON rtt.exp_id = act.exp_id AND rtt.sender_port = act.sender_port AND rtt.receiver_port = act.receiver_port AND rtt.pkt_idx = act.pkt_idx LEFT JOIN bw ON rtt.exp_id = bw.exp_id
  WINDOW u AS (PARTITION BY rtt.exp_id, rtt.sender_port, rtt.receiver_port ORDER BY rtt.pkt_idx ROWS UNBOUNDED PRECEDING)),
feat AS (SELECT *, coalesce(sum(pkts_lost) OVER (PARTITION BY {KEY} ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING), 0) AS pkts_lost_total, pkts_lost / (pkts_lost + 1) AS loss_rate,
  1 / sqrt(nullif(pkts_lost / (pkts_lost + 1), 0)) AS inv_sqrt_loss_rate, 8e6 * wire_b / nullif(interarrival_us, 0) AS inv_interarrival_bps, rtt_us / min_rtt_us AS rtt_ratio,
  1.0 / active_flows AS fair_share_frac, CASE WHEN use_bess THEN bw_bps / active_flows END AS fair_share_bps,
  8e6 * payload_b / nullif(rtt_us, 0) * sqrt(1.5::DOUBLE) / sqrt(nullif(pkts_lost / (pkts_lost + 1), 0)) AS mathis_tput_bps FROM f0)"""


@query(f"WITH {ORACLE_PACKETS} SELECT {KEY}, min(arrival_us) AS first_us, max(arrival_us) AS last_us, count(*) AS n_packets FROM data GROUP BY {KEY}")
def d1_time_bounds(spark, sf_dir):
    return pk.time_bounds(data_packets(spark, sf_dir))


@query(f"WITH {O_RETRANS} SELECT {KEY}, pkt_idx, CAST(seq_epoch AS BIGINT) AS seq_epoch, prev_seq, highest_seq, is_retrans FROM re")
def e2_retransmissions(spark, sf_dir):
    rows = joins.is_retransmission(data_packets(spark, sf_dir))
    return rows.select(*FLOW, "pkt_idx", "seq_epoch", "prev_seq", "highest_seq", "is_retrans")


@query(f"WITH {O_RTT} SELECT {KEY}, pkt_idx, rtt_us FROM rtt")
def c3_match_rtt(spark, sf_dir):
    return with_rtt(spark, sf_dir).select(*FLOW, "pkt_idx", "rtt_us")


@query(f"""WITH {ORACLE_PACKETS},
late AS (SELECT {KEY}, max(ack_us) AS end_us, count(*) AS n FROM acks GROUP BY {KEY}),
seen AS (SELECT d.{KEY.replace(', ', ', d.')}, d.pkt_idx, d.arrival_us, a.tsval FROM data d ASOF LEFT JOIN (SELECT * FROM acks) a ON d.exp_id = a.exp_id AND d.sender_port = a.sender_port AND d.receiver_port = a.receiver_port AND d.arrival_us > a.ack_us)
SELECT s.exp_id, s.sender_port, s.receiver_port, s.pkt_idx, CAST(nullif(CASE WHEN s.arrival_us > l.end_us THEN coalesce(p.tsval, q.tsval) ELSE coalesce(s.tsval, q.tsval) END, 0) AS DOUBLE) AS rtt_us
FROM seen s LEFT JOIN late l ON s.exp_id = l.exp_id AND s.sender_port = l.sender_port
LEFT JOIN acks p ON p.exp_id = s.exp_id AND p.sender_port = s.sender_port AND p.ack_idx = l.n - 2
LEFT JOIN acks q ON q.exp_id = s.exp_id AND q.sender_port = s.sender_port AND q.ack_idx = 0""")
def c4_match_rtt_asof(spark, sf_dir):
    data = data_packets(spark, sf_dir)
    return joins.match_rtt_asof(data, ack_packets(data)).select(*FLOW, "pkt_idx", "rtt_us")


@query(f"WITH {ORACLE_PACKETS}{O_ACTIVE} SELECT {KEY}, pkt_idx, active_flows FROM act")
def c5_active_flows(spark, sf_dir):
    return joins.active_flows(data_packets(spark, sf_dir)).select(*FLOW, "pkt_idx", "active_flows")


ROW_COLUMNS = {"total_so_far_b": None, "payload_so_far_b": None, "pkts_lost": 0, "pkts_lost_total": 0, "loss_rate": 9, "inv_sqrt_loss_rate": 9, "interarrival_us": 0, "inv_interarrival_bps": 6, "min_rtt_us": 0, "rtt_ratio": 9, "fair_share_frac": 9, "fair_share_bps": 12, "mathis_tput_bps": 6}


@query(f"WITH {O_FEATURES} SELECT {KEY}, pkt_idx, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" if d is None else f"round({c}, {d}) AS {c}" for c, d in ROW_COLUMNS.items()) + " FROM feat")
def e_row_features(spark, sf_dir):
    rows = joins.attach_exp_meta(joins.active_flows(with_rtt(spark, sf_dir)), bandwidths(spark))
    return features.row_features(rows).select(*FLOW, "pkt_idx", *[F.col(c) if d is None else F.round(c, d).alias(c) for c, d in ROW_COLUMNS.items()])


def _oracle_windows() -> str:
    parts = ", ".join(f"CASE WHEN pkt_idx > 0 THEN least(pkt_idx - 1, min(pkt_idx) OVER (PARTITION BY {KEY} ORDER BY arrival_us RANGE BETWEEN CAST({k} * least(min_rtt_us, 1e15) AS BIGINT) PRECEDING AND CURRENT ROW)) END AS s_w{k}" for k in WINDOWS)
    return f"WITH {O_FEATURES} SELECT {KEY}, pkt_idx, {parts} FROM feat"


@query(_oracle_windows())
def c6_window_starts(spark, sf_dir):
    return win.window_starts(with_features(spark, sf_dir), WINDOWS).select(*FLOW, "pkt_idx", *[f"s_w{k}" for k in WINDOWS])


@query(_oracle_windows())
def c6_window_starts_builtin(spark, sf_dir):
    return win.window_starts(with_features(spark, sf_dir), WINDOWS, method="builtin").select(*FLOW, "pkt_idx", *[f"s_w{k}" for k in WINDOWS])


def _oracle_flow_window(k: int) -> str:
    return O_FEATURES + f""",
st{k} AS (SELECT *, CASE WHEN pkt_idx > 0 THEN least(pkt_idx - 1, min(pkt_idx) OVER (PARTITION BY {KEY} ORDER BY arrival_us RANGE BETWEEN CAST({k} * least(min_rtt_us, 1e15) AS BIGINT) PRECEDING AND CURRENT ROW)) END AS s FROM feat),
w{k} AS (SELECT j.exp_id, j.sender_port, j.receiver_port, j.pkt_idx, j.wire_b, j.arrival_us - x.first_us AS age, j.min_rtt_us, j.use_bess, j.bw_bps, j.mathis_tput_bps, j.active_flows, j.fair_share_frac,
  j.pkt_idx - j.s AS n, j.arrival_us - i.arrival_us AS span, j.total_so_far_b - i.total_so_far_b AS bytes,
  (SELECT avg(q.rtt_us) FROM feat q WHERE q.exp_id = j.exp_id AND q.sender_port = j.sender_port AND q.receiver_port = j.receiver_port AND q.pkt_idx BETWEEN j.s AND j.pkt_idx) AS rtt_mean,
  j.pkts_lost_total - i.pkts_lost_total AS lost
  FROM st{k} j JOIN bounds x ON x.exp_id = j.exp_id AND x.sender_port = j.sender_port AND x.receiver_port = j.receiver_port
  LEFT JOIN feat i ON i.exp_id = j.exp_id AND i.sender_port = j.sender_port AND i.receiver_port = j.receiver_port AND i.pkt_idx = j.s),
v{k} AS (SELECT *, n IS NOT NULL AND min_rtt_us < 9e18 AND age >= {k} * min_rtt_us AS ok, bytes * 8e6 / nullif(span, 0) AS tput FROM w{k})"""


def _flow_window_values(k: int) -> str:
    return f"""round(CASE WHEN ok THEN span / n::DOUBLE END, 3) AS interarrival_us_w{k}, round(CASE WHEN ok AND (NOT use_bess OR tput <= bw_bps) THEN tput END, 9) AS tput_bps_w{k},
round(CASE WHEN ok THEN rtt_mean END, 3) AS rtt_us_w{k}, round(CASE WHEN ok THEN lost / (lost + n) END, 9) AS loss_rate_w{k}, round(CASE WHEN ok THEN mathis_tput_bps END, 6) AS mathis_tput_bps_w{k}"""


@query(f"WITH {_oracle_flow_window(8)} SELECT {KEY}, pkt_idx, {_flow_window_values(8)} FROM v8")
def w_flow_windows(spark, sf_dir):
    rows = win.flow_windows(with_features(spark, sf_dir), [8])
    digits = {"interarrival_us_w8": 3, "tput_bps_w8": 9, "rtt_us_w8": 3, "loss_rate_w8": 9, "mathis_tput_bps_w8": 6}
    return rows.select(*FLOW, "pkt_idx", *[F.round(c, d).alias(c) for c, d in digits.items()])


def _oracle_merged(k: int) -> str:
    return O_FEATURES + f""",
mg AS (SELECT *, row_number() OVER m - 1 AS m_idx, sum(wire_b) OVER (PARTITION BY exp_id ORDER BY arrival_us, sender_port, receiver_port, pkt_idx ROWS UNBOUNDED PRECEDING) AS m_bytes FROM feat WINDOW m AS (PARTITION BY exp_id ORDER BY arrival_us, sender_port, receiver_port, pkt_idx)),
ms AS (SELECT *, CASE WHEN m_idx > 0 THEN least(m_idx - 1, min(m_idx) OVER (PARTITION BY exp_id ORDER BY arrival_us RANGE BETWEEN CAST({k} * least(min_rtt_us, 1e15) AS BIGINT) PRECEDING AND CURRENT ROW)) END AS s0 FROM mg),
mm AS (SELECT *, max(s0) OVER (PARTITION BY exp_id ORDER BY m_idx ROWS UNBOUNDED PRECEDING) AS ms FROM ms),
mt AS (SELECT j.exp_id, j.sender_port, j.receiver_port, j.pkt_idx, j.active_flows, CASE WHEN NOT j.use_bess OR (j.m_bytes - i.m_bytes) * 8e6 / nullif(j.arrival_us - i.arrival_us, 0) <= j.bw_bps THEN (j.m_bytes - i.m_bytes) * 8e6 / nullif(j.arrival_us - i.arrival_us, 0) END AS total
  FROM mm j LEFT JOIN mg i ON j.exp_id = i.exp_id AND j.ms = i.m_idx)"""


@query(f"WITH {_oracle_merged(8)} SELECT {KEY}, pkt_idx, round(total, 9) AS total_tput_bps_w8, round(total / active_flows, 9) AS tput_fair_share_bps_w8 FROM mt")
def w8_merged_windows(spark, sf_dir):
    rows = win.merged_totals(with_features(spark, sf_dir), [8])
    return rows.select(*FLOW, "pkt_idx", *[F.round(c, 9).alias(c) for c in ("total_tput_bps_w8", "tput_fair_share_bps_w8")])


@query(f"WITH {_oracle_merged(8)} SELECT {KEY}, pkt_idx, round(total, 9) AS total_tput_bps_w8 FROM mt")
def c7_merged_windows_builtin(spark, sf_dir):
    return win.merged_totals(with_features(spark, sf_dir), [8], method="builtin").select(*FLOW, "pkt_idx", F.round("total_tput_bps_w8", 9).alias("total_tput_bps_w8"))


def _oracle_merged_all(windows: list[int]) -> str:
    """The merged totals of every window, one row per packet and window."""
    parts = [
        f"""ms{k} AS (SELECT *, CASE WHEN m_idx > 0 THEN least(m_idx - 1, min(m_idx) OVER (PARTITION BY exp_id ORDER BY arrival_us RANGE BETWEEN CAST({k} * least(min_rtt_us, 1e15) AS BIGINT) PRECEDING AND CURRENT ROW)) END AS s0 FROM mg),
mm{k} AS (SELECT *, max(s0) OVER (PARTITION BY exp_id ORDER BY m_idx ROWS UNBOUNDED PRECEDING) AS ms FROM ms{k}),
mt{k} AS (SELECT j.exp_id, j.sender_port, j.receiver_port, j.pkt_idx, {k} AS k, j.use_bess, j.bw_bps, (j.m_bytes - i.m_bytes) * 8e6 / nullif(j.arrival_us - i.arrival_us, 0) AS tput FROM mm{k} j LEFT JOIN mg i ON j.exp_id = i.exp_id AND j.ms = i.m_idx)"""
        for k in windows
    ]
    every = " UNION ALL ".join(f"SELECT * FROM mt{k}" for k in windows)
    head = _oracle_merged(8).split("ms AS (")[0]
    return f"WITH {head}{', '.join(parts)} SELECT {KEY}, pkt_idx, k, round(CASE WHEN NOT use_bess OR tput <= bw_bps THEN tput END, 9) AS total_tput_bps FROM ({every})"


def _merged_long(spark: SparkSession, sf_dir: str, windows: list[int], method: str) -> DataFrame:
    rows = win.merged_totals(with_features(spark, sf_dir), windows, method=method)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(f"total_tput_bps_w{k}", 9).alias("total_tput_bps")) for k in windows])).alias("p")
    return rows.select(*FLOW, "pkt_idx", pairs).select(*FLOW, "pkt_idx", "p.*")


@query(_oracle_merged_all(WINDOWS))
def w8_merged_windows_all(spark, sf_dir):
    """Throughput of all flows of an experiment over the smallest, the label's, a middle and the largest window."""
    return _merged_long(spark, sf_dir, WINDOWS, "vectorised")


@query(_oracle_merged_all([1, 8, 32, 1024]))
def c7_merged_windows_builtin_all(spark, sf_dir):
    """The same windows in the built-in form."""
    return _merged_long(spark, sf_dir, [1, 8, 32, 1024], "builtin")


# What the windows of training rows and their labels are made of, and their metrics.
TRAINING_ROW = [*FLOW, "pkt_idx", "arrival_us", "wire_b", "rtt_us", "pkts_lost", "min_rtt_us", "active_flows", "bw_bps", "use_bess", "fair_share_frac", "mathis_tput_bps"]
TRAINING_METRICS = ["rtt_us", "loss_rate", "interarrival_us", "tput_bps", "mathis_tput_bps"]


def labelled(spark: SparkSession, sf_dir: str, windows: list[int] = [8], columns: list[str] = ["*"], metrics: list[str] = list(win.AT_START)) -> DataFrame:
    """Feature rows with the flow's windows of 8 (and others in ``windows``), the ground truth ratio and its class.

    Every column passes through the windows' search and the join behind it, so name those wanted where few are.
    """
    packets = with_features(spark, sf_dir, columns)
    # Both kinds of windows start from the stored packets; the flows' own go through their grouped map once.
    rows = win.flow_windows(packets, windows, metrics=metrics).join(win.merged_totals(packets, [8]), [*FLOW, "pkt_idx"])
    rows = win.fairness_ratios(rows, [8])
    return rows.withColumns({"label": u.fairness_class(F.col("tput_to_fair_ratio_w8")), "binary": u.binary_class(F.col("tput_to_fair_ratio_w8")), "mathis_class": u.fairness_class(u.safe_div(F.col("tput_bps_w8"), F.col("mathis_tput_bps_w8")))})


O_LABELLED = _oracle_flow_window(8) + _oracle_merged(8).removeprefix(O_FEATURES) + """,
lab AS (SELECT v8.*, CASE WHEN ok AND (NOT use_bess OR tput <= bw_bps) THEN tput END AS flow_tput, total FROM v8 JOIN mt USING (exp_id, sender_port, receiver_port, pkt_idx)),
labelled AS (SELECT *, flow_tput / nullif(total, 0) / fair_share_frac AS ratio, CASE WHEN ok THEN flow_tput / nullif(mathis_tput_bps, 0) END AS mathis_ratio FROM lab)"""
CLASS = "CASE WHEN {0} < 0.9 THEN 0 WHEN {0} <= 1.1 THEN 1 WHEN {0} > 1.1 THEN 2 END"


@query(f"WITH {O_LABELLED} SELECT {KEY}, pkt_idx, round(ratio, 6) AS tput_to_fair_ratio_w8, {CLASS.format('ratio')} AS label, CAST(ratio > 1 AS INT) AS binary, {CLASS.format('mathis_ratio')} AS mathis_class FROM labelled")
def w9_fairness_labels(spark, sf_dir):
    return labelled(spark, sf_dir).select(*FLOW, "pkt_idx", F.round("tput_to_fair_ratio_w8", 6).alias("tput_to_fair_ratio_w8"), "label", "binary", "mathis_class")


@query(f"""WITH RECURSIVE {O_FEATURES},
ew AS (SELECT {KEY}, pkt_idx, rtt_us AS r1, rtt_us AS r5, interarrival_us AS i1 FROM feat WHERE pkt_idx = 0
 UNION ALL SELECT f.exp_id, f.sender_port, f.receiver_port, f.pkt_idx,
  CASE WHEN e.r1 IS NULL OR e.r1 = 0 THEN f.rtt_us WHEN f.rtt_us IS NULL OR f.rtt_us = 0 THEN e.r1 ELSE 0.1::DOUBLE * f.rtt_us + 0.9::DOUBLE * e.r1 END,
  CASE WHEN e.r5 IS NULL OR e.r5 = 0 THEN f.rtt_us WHEN f.rtt_us IS NULL OR f.rtt_us = 0 THEN e.r5 ELSE 0.5::DOUBLE * f.rtt_us + 0.5::DOUBLE * e.r5 END,
  CASE WHEN e.i1 IS NULL OR e.i1 = 0 THEN f.interarrival_us WHEN f.interarrival_us IS NULL OR f.interarrival_us = 0 THEN e.i1 ELSE 0.1::DOUBLE * f.interarrival_us + 0.9::DOUBLE * e.i1 END
 FROM feat f JOIN ew e ON f.exp_id = e.exp_id AND f.sender_port = e.sender_port AND f.receiver_port = e.receiver_port AND f.pkt_idx = e.pkt_idx + 1)
SELECT {KEY}, pkt_idx, round(r1, 3) AS rtt_us_ewma_a0_1, round(r5, 3) AS rtt_us_ewma_a0_5, round(i1, 3) AS interarrival_us_ewma_a0_1 FROM ew""")
def w10_ewma(spark, sf_dir):
    rows = recurrences.ewma_features(with_features(spark, sf_dir), ["rtt_us", "interarrival_us"], [0.1, 0.5])
    return rows.select(*FLOW, "pkt_idx", *[F.round(c, 3).alias(c) for c in ("rtt_us_ewma_a0_1", "rtt_us_ewma_a0_5", "interarrival_us_ewma_a0_1")])


EWMA_DIGITS = {"interarrival_us": 3, "inv_interarrival_bps": 9, "rtt_us": 3, "rtt_ratio": 9, "loss_rate": 9, "inv_sqrt_loss_rate": 6, "mathis_tput_bps": 6}


def _oracle_ewmas() -> str:
    """All averages in one recursion along the packets."""
    value = lambda m: f"coalesce({m}, 1)" if m == "inv_sqrt_loss_rate" else m
    both = [(m, a, ewma_name(m, a)) for m in EWMA for a in ALPHAS]
    first = ", ".join(f"{value(m)}::DOUBLE AS {n}" for m, _, n in both)
    step = lambda m, a, n: f"CASE WHEN e.{n} IS NULL OR e.{n} = 0 THEN f.{m} WHEN f.{m} IS NULL OR f.{m} = 0 THEN e.{n} ELSE {a!r}::DOUBLE * f.{m} + (1 - {a!r}::DOUBLE) * e.{n} END"
    return f"""WITH RECURSIVE {O_FEATURES}, fx AS (SELECT {KEY}, pkt_idx, {", ".join(f"{value(m)}::DOUBLE AS {m}" for m in EWMA)} FROM feat),
ew AS (SELECT {KEY}, pkt_idx, {first} FROM feat WHERE pkt_idx = 0
 UNION ALL SELECT f.exp_id, f.sender_port, f.receiver_port, f.pkt_idx, {", ".join(step(*x) for x in both)}
 FROM fx f JOIN ew e ON f.exp_id = e.exp_id AND f.sender_port = e.sender_port AND f.receiver_port = e.receiver_port AND f.pkt_idx = e.pkt_idx + 1)
SELECT {KEY}, pkt_idx, {", ".join(f"round({n}, {EWMA_DIGITS[m]}) AS {n}" for m, _, n in both)} FROM ew"""


@query(_oracle_ewmas())
def w10_all_ewmas(spark, sf_dir):
    """All seven metrics and twenty factors."""
    rows = recurrences.ewma_features(with_features(spark, sf_dir), EWMA)
    return rows.select(*FLOW, "pkt_idx", *[F.round(ewma_name(m, a), EWMA_DIGITS[m]).alias(ewma_name(m, a)) for m in EWMA for a in ALPHAS])


def loss_event_oracle(source: str, rtt: str, windows: tuple[int, ...]) -> str:
    """CTEs gaps (losses before each packet) and rates (rate<n> after each) over ``source``, one lost packet after another."""
    most = max(windows) + 1
    weighted = lambda n, first: f"list_sum(list_transform(range(1, least(len(sizes) - {first}, {n}) + 1), lambda i: sizes[i + {first}] * (1 - (i - 1) / {n}::DOUBLE)))"
    rate = lambda n: f"list_sum(list_transform(range(1, least(len(sizes), {n}) + 1), lambda i: 1 - (i - 1) / {n}::DOUBLE)) / greatest({weighted(n, 0)}, coalesce({weighted(n, 1)}, 0)) AS rate{n}"
    return f"""gaps0 AS (SELECT *, lag(seq) OVER o AS ps, lag(payload_b) OVER o AS pb, lag(arrival_us) OVER o AS pt, max(seq) OVER (PARTITION BY {KEY} ORDER BY pkt_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi FROM {source} WINDOW o AS (PARTITION BY {KEY} ORDER BY pkt_idx)),
gaps AS (SELECT {KEY}, pkt_idx, arrival_us, pt, coalesce({rtt}, -1) AS r, CASE WHEN ps = hi AND ps + pb < seq AND pb > 0 AND payload_b > 0 THEN CAST(round_even((seq - ps - pb) / payload_b::DOUBLE, 0) AS BIGINT) ELSE 0 END AS lost FROM gaps0 WHERE pkt_idx > 0),
items AS (SELECT {KEY}, pkt_idx, r, m > lost AS packet, pt + m * ((arrival_us - pt) / nullif(lost, 0)::DOUBLE) AS at, row_number() OVER (PARTITION BY {KEY} ORDER BY pkt_idx, m) AS step FROM (SELECT *, unnest(range(1, lost + 2)) AS m FROM gaps)),
evs AS (SELECT DISTINCT {KEY}, CAST(0 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS pkt_idx, false AS packet, [0.0::DOUBLE] AS starts, [CAST(0 AS BIGINT)] AS sizes FROM gaps
 UNION ALL SELECT i.exp_id, i.sender_port, i.receiver_port, i.step, i.pkt_idx, i.packet,
  CASE WHEN NOT i.packet AND i.at > e.starts[1] + i.r THEN list_slice(list_prepend(i.at, e.starts), 1, {most}) ELSE e.starts END,
  CASE WHEN NOT i.packet AND i.at > e.starts[1] + i.r THEN list_slice(list_prepend(1, e.sizes), 1, {most}) ELSE list_prepend(e.sizes[1] + 1, list_slice(e.sizes, 2, {most})) END
 FROM items i JOIN evs e ON i.exp_id = e.exp_id AND i.sender_port = e.sender_port AND i.receiver_port = e.receiver_port AND i.step = e.step + 1),
rates AS (SELECT {KEY}, pkt_idx, {", ".join(map(rate, windows))} FROM evs WHERE packet)"""


LOSS_WINDOWS = (4, 8, 16)


@query(f"""WITH RECURSIVE {O_RTT}, {loss_event_oracle("rtt", "rtt_us", LOSS_WINDOWS)}, a AS (SELECT rtt.exp_id, rtt.sender_port, rtt.receiver_port, rtt.pkt_idx, payload_b, rtt_us, {", ".join(f"coalesce(rate{n}, 0) AS rate{n}" for n in LOSS_WINDOWS)} FROM rtt LEFT JOIN rates USING ({KEY}, pkt_idx))
SELECT {KEY}, pkt_idx, {", ".join(f"round(rate{n}, 9) AS loss_event_rate_cw{n}, round(1 / sqrt(nullif(rate{n}, 0)), 6) AS inv_sqrt_loss_event_rate_cw{n}, round(8e6 * sqrt(1.5::DOUBLE) * payload_b / CASE WHEN rtt_us > 0 THEN rtt_us END / sqrt(nullif(rate{n}, 0)), 6) AS mathis_ler_bps_cw{n}" for n in LOSS_WINDOWS)} FROM a""")
def w11_loss_events(spark, sf_dir):
    rows = recurrences.loss_event_features(with_rtt(spark, sf_dir), LOSS_WINDOWS)
    return rows.select(*FLOW, "pkt_idx", *[F.round(c, 9 if c.startswith("loss") else 6).alias(c) for c in rows.columns[4:]])


@query(f"WITH {O_FEATURES}, c AS (SELECT *, floor(arrival_us / 3600000000) AS cell FROM feat) SELECT e.exp_id, e.sender_port, e.receiver_port, e.pkt_idx AS end_idx, CAST(least(floor((o.arrival_us - (e.arrival_us - 3600000000)) * 10 / 3600000000.0), 9) AS INT) AS bucket, count(*) AS n FROM feat e JOIN feat o ON e.exp_id = o.exp_id AND e.sender_port = o.sender_port AND e.receiver_port = o.receiver_port AND o.arrival_us BETWEEN e.arrival_us - 3600000000 AND e.arrival_us GROUP BY ALL")
def w14_arrival_histogram(spark, sf_dir):
    return win.arrival_histogram(data_packets(spark, sf_dir), 3_600_000_000, 10)


@query(f"WITH {ORACLE_PACKETS} SELECT {KEY}, pkt_idx, payload_b AS payload_b_0, lag(payload_b, 1) OVER w AS payload_b_1, lag(payload_b, 2) OVER w AS payload_b_2 FROM data WINDOW w AS (PARTITION BY {KEY} ORDER BY pkt_idx)")
def w15_flatten_window(spark, sf_dir):
    return win.flatten_window(data_packets(spark, sf_dir), ["payload_b"], 3).select(*FLOW, "pkt_idx", "payload_b_0", "payload_b_1", "payload_b_2")


@query(f"WITH {ORACLE_PACKETS}, b AS (SELECT {KEY}, max(arrival_us) AS last_us FROM data GROUP BY {KEY}), e AS (SELECT exp_id, min(last_us) AS end_us FROM b GROUP BY exp_id) SELECT exp_id, sender_port, receiver_port, pkt_idx, arrival_us FROM data JOIN e USING (exp_id) WHERE arrival_us < end_us OR pkt_idx = 0")
def b7_trim_to_first_finish(spark, sf_dir):
    return pk.trim_to_first_finish(data_packets(spark, sf_dir)).select(*FLOW, "pkt_idx", "arrival_us")


O_SPAN = f"""b AS (SELECT {KEY}, min(arrival_us) AS first_us, max(arrival_us) AS last_us FROM data GROUP BY {KEY}), e AS (SELECT exp_id, max(first_us) AS start_us, min(last_us) AS end_us FROM b GROUP BY exp_id),
c AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY arrival_us DESC, pkt_idx DESC) AS back FROM data), common_span AS (SELECT c.* FROM c JOIN e USING (exp_id) WHERE (arrival_us >= start_us OR back <= 2) AND arrival_us < end_us)"""


@query(f"WITH {ORACLE_PACKETS}, {O_SPAN} SELECT {KEY}, pkt_idx, arrival_us FROM common_span")
def b8_trim_to_common_span(spark, sf_dir):
    return pk.trim_to_common_span(data_packets(spark, sf_dir)).select(*FLOW, "pkt_idx", "arrival_us")


@query(f"WITH {ORACLE_PACKETS}, t AS (SELECT exp_id, min(arrival_us) AS t0 FROM data GROUP BY exp_id) SELECT exp_id, sender_port, receiver_port, pkt_idx, arrival_us - t0 AS arrival_us FROM data JOIN t USING (exp_id)")
def b9_relative_time(spark, sf_dir):
    return pk.relative_time(data_packets(spark, sf_dir)).select(*FLOW, "pkt_idx", "arrival_us")


@query(f"WITH {ORACLE_PACKETS}, t AS (SELECT exp_id, receiver_port, min(arrival_us) AS lo, max(arrival_us) AS hi FROM data GROUP BY ALL) SELECT exp_id, sender_port, receiver_port, pkt_idx FROM data JOIN t USING (exp_id, receiver_port) WHERE 100 * (arrival_us - hi) > -20 * (hi - lo)")
def b4_tail_percent(spark, sf_dir):
    return pk.select_tail_percent(data_packets(spark, sf_dir), 20, ["exp_id", "receiver_port"]).select(*FLOW, "pkt_idx")


@query(f"WITH {ORACLE_PACKETS}, n AS (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM data) SELECT {KEY}, pkt_idx FROM n WHERE pkt_idx + 1 > floor(n * 0.25)")
def b18_warmup_drop(spark, sf_dir):
    return pk.warmup_drop(data_packets(spark, sf_dir), 0.25).select(*FLOW, "pkt_idx")


@query(f"WITH {ORACLE_PACKETS}, n AS (SELECT {KEY} FROM data GROUP BY {KEY} HAVING count(*) > 1) SELECT exp_id, count(*) AS n_packets FROM data JOIN n USING (exp_id, sender_port, receiver_port) GROUP BY exp_id")
def b6_drop_empty_flows(spark, sf_dir):
    return pk.drop_empty_flows(data_packets(spark, sf_dir)).groupBy("exp_id").agg(F.count(F.lit(1)).alias("n_packets"))


@query(f"WITH {O_FEATURES}, u AS (UNPIVOT (SELECT exp_id, max(CASE WHEN isnan(rtt_us) OR isinf(rtt_us) THEN 1 ELSE 0 END) AS rtt_us, max(CASE WHEN isnan(loss_rate) OR isinf(loss_rate) THEN 1 ELSE 0 END) AS loss_rate FROM feat GROUP BY exp_id) ON rtt_us, loss_rate INTO NAME feature VALUE bad) SELECT exp_id, feature, bad = 1 AS has_non_finite FROM u")
def b15_flag_non_finite(spark, sf_dir):
    return pk.flag_non_finite(with_features(spark, sf_dir), ["rtt_us", "loss_rate"])


@query(f"WITH {O_FEATURES}, m AS (SELECT avg(rtt_us) AS a, avg(loss_rate) AS b FROM feat) SELECT {KEY}, pkt_idx, round(coalesce(rtt_us, a), 0) AS rtt_us, round(coalesce(loss_rate, b), 6) AS loss_rate FROM feat, m")
def b16_replace_unknowns(spark, sf_dir):
    rows = pk.replace_unknowns(with_features(spark, sf_dir), ["rtt_us", "loss_rate"])
    return rows.select(*FLOW, "pkt_idx", F.round("rtt_us", 0).alias("rtt_us"), F.round("loss_rate", 6).alias("loss_rate"))


def _window_errors(spark: SparkSession, sf_dir: str, windows: list[int]) -> DataFrame:
    """Throughputs above the link's per experiment and window, counted once and stored."""
    packets = with_features(spark, sf_dir).select(*FLOW, "pkt_idx", "arrival_us", "wire_b", "min_rtt_us", "bw_bps", F.lit(False).alias("use_bess"), F.col("use_bess").alias("_real"))
    rows = win.flow_windows(packets, windows, metrics=["tput_bps"])
    return stored(win.window_errors(rows.withColumn("use_bess", F.col("_real")), windows, "tput_bps"), "errors")


@query(f"WITH {_oracle_flow_window(8)} SELECT exp_id, 8 AS k, count(*) FILTER (ok AND use_bess AND tput > bw_bps) AS n_errors, CASE WHEN count(*) FILTER (ok AND use_bess AND tput > bw_bps) = 0 THEN 8 ELSE 0 END AS safe_k FROM v8 GROUP BY exp_id")
def d20_window_errors(spark, sf_dir):
    errors = _window_errors(spark, sf_dir, [8])
    return errors.join(win.smallest_safe_window(errors), "exp_id")


def _oracle_window_errors() -> str:
    """Errors of every production window and the smallest without any."""
    views = O_FEATURES + "".join(_oracle_flow_window(k).removeprefix(O_FEATURES) for k in win.WINDOWS)
    counts = " UNION ALL ".join(f"SELECT exp_id, {k} AS k, count(*) FILTER (ok AND use_bess AND tput > bw_bps) AS n_errors FROM v{k} GROUP BY exp_id" for k in win.WINDOWS)
    return f"WITH {views}, er AS ({counts}) SELECT *, coalesce(min(k) FILTER (n_errors = 0) OVER (PARTITION BY exp_id), 0) AS safe_k FROM er"


@query(_oracle_window_errors())
def d20_window_errors_all(spark, sf_dir):
    """The smallest safe one of all production windows."""
    errors = _window_errors(spark, sf_dir, win.WINDOWS)
    return errors.join(win.smallest_safe_window(errors), "exp_id")


@query(f"""WITH {ORACLE_PACKETS},
f AS (SELECT {KEY}, any_value(sender_id) AS sender_id, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(arrival_us) - min(arrival_us), 0) AS tput FROM data GROUP BY {KEY})
SELECT {KEY}, sender_id, round(tput, 9) AS tput_bps FROM f""")
def d2_flow_throughput(spark, sf_dir):
    return fairness.flow_throughput(data_packets(spark, sf_dir), ["sender_id"]).select(*FLOW, "sender_id", F.round("tput_bps", 9).alias("tput_bps"))


@query(f"""WITH {ORACLE_PACKETS}, live AS (SELECT {KEY} FROM data GROUP BY {KEY} HAVING count(*) > 1), alive AS (SELECT data.* FROM data JOIN live USING (exp_id, sender_port, receiver_port)),
b AS (SELECT {KEY}, max(arrival_us) AS last_us FROM alive GROUP BY {KEY}), e AS (SELECT exp_id, min(last_us) AS end_us FROM b GROUP BY exp_id), t AS (SELECT alive.* FROM alive JOIN e USING (exp_id) WHERE arrival_us < end_us OR pkt_idx = 0),
f AS (SELECT {KEY}, sum(wire_b) AS all_b, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(arrival_us) - min(arrival_us), 0) AS tput, min(arrival_us) AS a, max(arrival_us) AS z FROM t GROUP BY {KEY})
SELECT exp_id, round(pow(sum(tput), 2) / nullif(count(tput) * sum(tput * tput), 0), 9) AS jain, count(tput) AS n, round(sum(all_b) * 8e6 / nullif(max(z) - min(a), 0) / max(bw_bps), 9) AS utilisation FROM f JOIN bw USING (exp_id) GROUP BY exp_id""")
def d3_fairness_report(spark, sf_dir):
    """Jain's index and utilisation per experiment: drop single-packet flows, trim, relative time, throughput."""
    rows = pk.relative_time(pk.trim_to_first_finish(pk.drop_empty_flows(data_packets(spark, sf_dir))))
    flows = joins.attach_exp_meta(fairness.flow_throughput(rows), bandwidths(spark))
    both = fairness.jain_index(flows, ["exp_id"]).join(fairness.utilisation(flows, ["exp_id"]), "exp_id")
    return both.select("exp_id", F.round("jain", 9).alias("jain"), "n", F.round("utilisation", 9).alias("utilisation"))


@query(f"""WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, any_value(sender_id) AS sender_id, (sum(wire_b) - arg_min(wire_b, pkt_idx)) * 8e6 / nullif(max(arrival_us) - min(arrival_us), 0) AS tput FROM data GROUP BY {KEY}),
s AS (SELECT exp_id, sender_id, sum(tput) AS tput FROM f GROUP BY ALL) SELECT exp_id, round(pow(sum(tput), 2) / (count(tput) * sum(tput * tput)), 9) AS jain, count(tput) AS n FROM s GROUP BY exp_id""")
def d3_jain_by_sender(spark, sf_dir):
    return fairness.jain_by_sender(fairness.flow_throughput(data_packets(spark, sf_dir), ["sender_id"]), ["exp_id"]).select("exp_id", F.round("jain", 9).alias("jain"), "n")


@query(f"""WITH {ORACLE_PACKETS}, f AS (SELECT {KEY}, any_value(sender_id) AS sender_id, sum(wire_b) AS all_b, min(arrival_us) AS a, max(arrival_us) AS z FROM data GROUP BY {KEY})
SELECT exp_id, sender_id AS flow_class, round(sum(all_b) * 8e6 / nullif(max(z) - min(a), 0) / max(bw_bps), 9) AS utilisation FROM f JOIN bw USING (exp_id) GROUP BY exp_id, sender_id""")
def d5_class_utilisation(spark, sf_dir):
    flows = joins.attach_exp_meta(fairness.flow_throughput(data_packets(spark, sf_dir), ["sender_id"]), bandwidths(spark))
    return fairness.class_utilisation(flows, ["exp_id"], "sender").withColumn("utilisation", F.round("utilisation", 9))


O_SERIES = ORACLE_PACKETS + f""",
cu AS (SELECT *, sum(wire_b) OVER (PARTITION BY {KEY} ORDER BY pkt_idx ROWS UNBOUNDED PRECEDING) AS upto FROM data),
nx AS (SELECT a.exp_id, a.sender_port, a.receiver_port, a.pkt_idx, min(b.pkt_idx) AS nxt FROM data a LEFT JOIN data b ON a.exp_id = b.exp_id AND a.sender_port = b.sender_port AND a.receiver_port = b.receiver_port AND b.arrival_us > a.arrival_us + 86400000000 GROUP BY ALL),
bk AS (SELECT exp_id, sender_port, receiver_port, pkt_idx, nxt FROM nx WHERE pkt_idx = 0 UNION ALL SELECT nx.exp_id, nx.sender_port, nx.receiver_port, nx.pkt_idx, nx.nxt FROM nx JOIN bk ON nx.exp_id = bk.exp_id AND nx.sender_port = bk.sender_port AND nx.receiver_port = bk.receiver_port AND nx.pkt_idx = bk.nxt),
series AS (SELECT s.exp_id, s.sender_port, s.receiver_port, s.sender_id, row_number() OVER (PARTITION BY s.exp_id, s.sender_port, s.receiver_port ORDER BY s.pkt_idx) - 1 AS sample_idx, (s.arrival_us + z.arrival_us) / 2.0::DOUBLE AS x_us, (z.upto - s.upto) * 8e6 / (z.arrival_us - s.arrival_us) AS tput
 FROM bk JOIN cu s USING ({KEY}, pkt_idx) JOIN cu z ON z.exp_id = s.exp_id AND z.sender_port = s.sender_port AND z.receiver_port = s.receiver_port AND z.pkt_idx = bk.nxt - 1 WHERE z.arrival_us > s.arrival_us)"""


@query(f"WITH RECURSIVE {O_SERIES} SELECT {KEY}, sender_id, sample_idx, x_us, round(tput, 9) AS tput_bps FROM series")
def d6_throughput_series(spark, sf_dir):
    return fairness.throughput_series(data_packets(spark, sf_dir), 86_400_000_000).withColumn("tput_bps", F.round("tput_bps", 9))


@query(f"WITH {ORACLE_PACKETS} SELECT {KEY}, CAST(floor(arrival_us / 86400000000) AS BIGINT) AS bucket, round(sum(wire_b) * 8e6 / 86400000000, 9) AS tput_bps FROM data GROUP BY ALL")
def d6_throughput_grid(spark, sf_dir):
    return fairness.throughput_grid(data_packets(spark, sf_dir), 86_400_000_000).withColumn("tput_bps", F.round("tput_bps", 9))


@query(f"""WITH RECURSIVE {O_SERIES}, fi AS (SELECT exp_id, sender_id, min(sender_port) AS sender_port FROM series GROUP BY ALL), le AS (SELECT exp_id, sender_id, max(sample_idx) AS last FROM series JOIN fi USING (exp_id, sender_id, sender_port) GROUP BY ALL)
SELECT exp_id, sender_id, sample_idx, round(sum(tput), 9) AS tput_bps FROM series JOIN le USING (exp_id, sender_id) WHERE sample_idx <= last GROUP BY ALL""")
def d7_sender_series(spark, sf_dir):
    return fairness.sender_series(fairness.throughput_series(data_packets(spark, sf_dir), 86_400_000_000)).withColumn("tput_bps", F.round("tput_bps", 9))


@query(f"WITH {O_LABELLED} SELECT {KEY}, round(avg(flow_tput), 9) AS mean_tput_bps FROM labelled GROUP BY {KEY}")
def d27_avg_flow_throughput(spark, sf_dir):
    return fairness.avg_flow_throughput(win.flow_windows(with_features(spark, sf_dir), [8]), "tput_bps_w8").withColumn("mean_tput_bps", F.round("mean_tput_bps", 9))
