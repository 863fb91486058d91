"""Scores of predictions and class statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtally.sources.shared import stored

# Upper ends of the condition classes (bandwidth in Mbit/s, RTT in us, queue in BDP).
CONDITIONS = {"bw_mbps": [1.0, 10.0, 30.0, 50.0, 1000.0], "rtt_us": [1e3, 1e4, 1e5, 1e6], "queue_bdp": [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]}


def class_popularity(rows: DataFrame, label: str, classes: list[int]) -> DataFrame:
    """Count and percent of every class, also of classes without rows."""
    counts = rows.groupBy(F.col(label).cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.createDataFrame([(c,) for c in classes], "class int")
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, "class", "left").select("class", n.alias("n"), (n * 100.0 / F.nullif(F.sum(n).over(Window.partitionBy()), F.lit(0))).alias("percent"))


def with_class_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight = 1 - share of the row's class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    weights = counts.select(label, (1 - F.col("_n") / F.sum("_n").over(Window.partitionBy())).alias("weight"))
    return rows.join(weights, label, "left")


def survey(rows: DataFrame, warmup: float, flow: list[str]) -> DataFrame:
    """Rows per experiment after warm-up: ceil(n * (1 - warmup)) of each flow."""
    per_flow = rows.groupBy(*flow).agg(F.ceil(F.count(F.lit(1)) * F.lit(1 - warmup)).cast("long").alias("n"))
    return per_flow.groupBy("exp_id").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_flows"))


def confusion(rows: DataFrame, label: str, predicted: str, by: list[str] = []) -> DataFrame:
    return rows.groupBy(*by, F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def classification_report(rows: DataFrame, label: str, predicted: str, by: list[str] = []) -> DataFrame:
    """Per class: support, precision, recall, f1, false positive and negative rates, and the overall accuracy."""
    cells = confusion(rows, label, predicted, by)
    long = cells.select(*by, F.explode(F.array_distinct(F.array("label", "predicted"))).alias("class"), "label", "predicted", "n")
    hit = lambda a, b: F.sum(F.when(a & b, F.col("n")).otherwise(0))
    is_l, is_p = F.col("label") == F.col("class"), F.col("predicted") == F.col("class")
    per = long.groupBy(*by, "class").agg(hit(is_l, is_p).alias("tp"), hit(~is_l, is_p).alias("fp"), hit(is_l, ~is_p).alias("fn"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"))
    joined = per.join(totals, by) if by else per.join(F.broadcast(totals))
    ratio = lambda n, d: n / F.nullif(d, F.lit(0))
    p, r, fn, fp = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"), F.col("fn"), F.col("fp")
    return joined.select(*by, "class", r.alias("support"), ratio(F.col("tp"), p).alias("precision"), ratio(F.col("tp"), r).alias("recall"), ratio(2 * F.col("tp"), p + r).alias("f1"), ratio(fp, F.col("total") - r).alias("false_positive_rate"), ratio(fn, r).alias("false_negative_rate"), (F.col("right") / F.col("total")).alias("accuracy"))


def accuracy_by(rows: DataFrame, label: str, predicted: str, by: list[str]) -> DataFrame:
    """Accuracy per group, such as the number of flows."""
    return rows.groupBy(*by).agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def global_row_numbers(rows: DataFrame, order: list[str | Column], name: str = "rn") -> DataFrame:
    """Adds row numbers from 0 in a global order without sending all rows to one task.

    Rows are range-partitioned, sorted and stored with their place; partitions are
    counted, and a row's number is the rows before its partition plus its place in it.
    Storing matters: a second run of the range partitioning may cut elsewhere.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ordered = stored(ordered, "ordered")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def accuracy_by_unfairness(rows: DataFrame, x: str, tie: list[str], correct: str, buckets: int = 20) -> DataFrame:
    """Mean x and accuracy of equal-count buckets in order of x; floor(n / buckets) rows each, the remainder follows."""
    n = rows.count()
    size = max(1, n // buckets)
    numbered = global_row_numbers(rows, [x, *tie])
    return numbered.groupBy(F.floor(F.col("rn") / size).alias("bucket")).agg(F.avg(x).alias("mean_x"), F.avg(F.col(correct).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def accuracy_by_condition(rows: DataFrame, column: str, accuracy: str, ends: list[float] | None = None) -> DataFrame:
    """Mean accuracy under the first class end at or above the value."""
    ladder = None
    for end in ends or CONDITIONS[column]:
        test = F.col(column) <= end
        ladder = F.when(test, end) if ladder is None else ladder.when(test, end)
    return rows.groupBy(ladder.alias("upto")).agg(F.avg(accuracy).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def mathis_accuracy(rows: DataFrame, actual: str, model: str, truth: str) -> DataFrame:
    """Accuracy of "faster than the model" against the truth, rows used and left out, and accuracy with those counted as wrong."""
    guess = (F.col(actual) > F.col(model)).cast("int")
    used = guess.isNotNull() & F.col(truth).isNotNull()
    right = F.sum((used & (guess == F.col(truth))).cast("int"))
    n = F.sum(used.cast("int"))
    return rows.agg(n.alias("used"), (F.count(F.lit(1)) - n).alias("left_out"), (right / F.nullif(n, F.lit(0))).alias("accuracy_used"), (right / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("accuracy_all"))


def label_mode(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """The commonest label of each group; ties give the largest."""
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.max(F.struct("_n", label))[label].alias(label))


def classes(spark: SparkSession) -> DataFrame:
    """The label and decision names."""
    return spark.createDataFrame([(0, "below"), (1, "near"), (2, "above"), (3, "none")], "class int, name string")
