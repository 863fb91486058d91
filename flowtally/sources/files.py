"""Readers of captures, parameters, logs and reports, and the writers of results.

Text formats are split with column functions; nothing is parsed row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from flowtally.functions.unknown import hex_or_int

PACKETS = "exp_id long, sender_port long, receiver_port long, direction int, pkt_idx long, seq long, arrival_us long, tsval long, tsecr long, payload_b long, wire_b long"
# Positions in a flowset.
FLOWSET = {"sender": 0, "receiver": 1, "cca": 2, "start_s": 3, "end_s": 4, "sender_ports": 5, "receiver_port": 6, "n_flows": 9}


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Captured packets, one folder per experiment (exp_id=...)."""
    return spark.read.schema(PACKETS).parquet(path)


def read_params(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parameter files (one JSON document each): experiments, one row per flow, one row per change of a bottleneck."""
    schema = "category string, bess_bw_Mbps double, sender_bottlenecks map<string, array<struct<time_s: double, rate_Mbps: double>>>, flowsets array<array<string>>"
    docs = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "").alias("exp_name"), F.from_json("value", schema).alias("p"))
    experiments = docs.select("exp_name", F.col("p.category").alias("category"), F.col("p.bess_bw_Mbps").alias("bess_bw_mbps"))
    sets = docs.select("exp_name", F.posexplode("p.flowsets").alias("flowset", "f"))
    at = lambda k: F.get("f", F.lit(FLOWSET[k]))
    first = lambda c: F.coalesce(F.get_json_object(c, "$[0]"), c)
    flows = sets.select(
        "exp_name",
        "flowset",
        first(at("sender")).alias("sender"),
        first(at("receiver")).alias("receiver"),
        F.get_json_object(at("receiver"), "$[7]").alias("receiver_ip"),
        at("cca").alias("cca"),
        at("start_s").cast("double").alias("start_s"),
        at("end_s").cast("double").alias("end_s"),
        F.explode(F.from_json(at("sender_ports"), "array<long>")).alias("sender_port"),
        at("receiver_port").cast("long").alias("receiver_port"),
        at("n_flows").cast("int").alias("n_flows"),
    )
    changes = docs.select("exp_name", F.explode("p.sender_bottlenecks").alias("sender", "c")).select("exp_name", "sender", F.explode("c").alias("c")).select("exp_name", "sender", F.col("c.time_s").alias("time_s"), F.col("c.rate_Mbps").alias("rate_mbps"))
    return experiments, flows, changes


def parse_queue_log(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue log lines (column value): packet events (type, time_us, port, seq, ...) and port statistics; numbers in hex or decimal."""
    t = F.split("value", ",")
    at = lambda k: hex_or_int(F.get(t, F.lit(k)))
    events = lines.where(F.col("value").rlike(r"^(0x)?[0-9a-fA-F]+,") & (F.size(t) == 9)).select(
        F.when(at(0) == 0, "enq").otherwise("deq").alias("event"), (at(1) / 1000).alias("time_us"), at(2).alias("port"), at(3).alias("seq"), at(4).alias("payload_b"), at(5).alias("qsize"), (at(6) != 0).alias("dropped"), at(7).alias("queued"), at(8).alias("batch")
    )
    s = F.split(F.substring_index("value", "stats:", -1), ",")
    number = lambda k: hex_or_int(F.get(s, F.lit(k)))
    stats = lines.where(F.startswith(F.col("value"), F.lit("stats:"))).select(number(0).alias("port"), number(1).alias("enq"), number(2).alias("deq"), number(3).alias("dropped"))
    return events, stats


def read_queue_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_queue_log(spark.read.text(path))


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Receive-window schedule: start_s, rwnd_b by start; lines with # are comments."""
    return spark.read.schema("start_s double, rwnd_b long").option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path).orderBy("start_s")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with file and line_no (order within the file)."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "value"))
    return lines.where(F.trim("value") != "")


def read_host_counters(spark: SparkSession, path: str, columns: list[tuple[str, str]]) -> DataFrame:
    """Counter files with two header rows: the columns picked by their (upper, lower) names, as numbers."""
    lines = numbered_lines(spark, path).where(~F.contains(F.col("value"), F.lit("is disabled")))
    w = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumn("_rn", F.row_number().over(w))
    heads = rows.where("_rn <= 2").groupBy("file").agg(F.max(F.when(F.col("_rn") == 1, F.split("value", ","))).alias("_h1"), F.max(F.when(F.col("_rn") == 2, F.split("value", ","))).alias("_h2"))
    body = rows.where("_rn > 2").join(heads, "file").withColumn("_v", F.split("value", ","))
    pairs = F.arrays_zip("_h1", "_h2")

    def pick(a: str, b: str) -> Column:
        at = F.array_position(F.transform(pairs, lambda p: F.concat_ws("/", F.trim(p["_h1"]), F.trim(p["_h2"]))), f"{a}/{b}")
        return F.get("_v", (at - 1).cast("int")).try_cast("double")

    return body.select("file", "line_no", *[pick(a, b).alias(f"{a}_{b}") for a, b in columns])


def parse_skb_lengths(lines: DataFrame) -> DataFrame:
    """Third field of the lines with "len,"."""
    return lines.where(F.contains(F.col("value"), F.lit("len,"))).select(F.get(F.split("value", ","), F.lit(2)).cast("int").alias("len"))


def read_load_reports(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Load-generator reports, one document per file or line: throughput, retransmissions per second and CPU shares; missing fields are 0."""
    cpu = ["host_total", "host_user", "host_system", "remote_total", "remote_user", "remote_system"]
    end = T.StructType.fromDDL("sum_received struct<bits_per_second: double>, sum_sent struct<retransmits: double, start: double, `end`: double>, cpu_utilization_percent struct<" + ", ".join(f"{c}: double" for c in cpu) + ">")
    docs = spark.read.schema(T.StructType([T.StructField("end", end)])).option("multiLine", not one_per_line).json(path)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    seconds = F.nullif(F.col("end.sum_sent.end") - F.col("end.sum_sent.start"), F.lit(0.0))
    return docs.select(F.input_file_name().alias("file"), zero("end.sum_received.bits_per_second").alias("tput_bps"), F.coalesce(F.col("end.sum_sent.retransmits") / seconds, F.lit(0.0)).alias("retrans_per_s"), *[zero(f"end.cpu_utilization_percent.{c}").alias(f"cpu_{c}") for c in cpu])


# The tags of a training log.
TAGS = {"accuracy": "Test accuracy:", "iterations": "Model fit in iterations:", "train_s": "Finished training - time:", "test_s": "Finished testing - time:"}


def parse_training_log(lines: DataFrame) -> DataFrame:
    """Last number after each tag, per file (columns file, line_no, value)."""
    found = {name: F.max_by(F.regexp_extract("value", tag + r"\s*\[?([0-9.]+)", 1).try_cast("double"), F.when(F.contains(F.col("value"), F.lit(tag)), F.col("line_no"))) for name, tag in TAGS.items()}
    return lines.groupBy("file").agg(*[c.alias(n) for n, c in found.items()])


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_training_log(numbered_lines(spark, path))


# Sinks ---------------------------------------------------------------------------------


def write_features(rows: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """One folder per experiment; experiments in ``done`` are left out before anything is computed."""
    todo = rows.join(done.select("exp_id").distinct(), "exp_id", "left_anti") if done is not None else rows
    todo.repartition("exp_id", F.pmod(F.xxhash64("sender_port"), F.lit(16))).write.mode("append").partitionBy("exp_id").parquet(path)


def finished_experiments(spark: SparkSession, path: str) -> DataFrame:
    """exp_ids that have a folder already; read from the folders' names alone."""
    return spark.read.schema("exp_id long").option("basePath", path).parquet(path).select("exp_id").distinct()


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split", "subsplit").parquet(path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All subsplits of a split; other folders are pruned."""
    return spark.read.parquet(path).where(F.col("split") == name)


def split_manifest(rows: DataFrame) -> DataFrame:
    """Which experiments feed which split."""
    return rows.groupBy("split").agg(F.sort_array(F.collect_set("exp_id")).alias("exp_ids"))


def save_scale_params(params: DataFrame, path: str) -> None:
    params.coalesce(1).write.mode("overwrite").json(path)


def load_scale_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("feature string, p1 double, p2 double").json(path)


def write_eval_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
