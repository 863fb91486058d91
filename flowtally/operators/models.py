"""Feature analysis, classifiers and scores with pyspark.ml."""

from __future__ import annotations

import random
from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from flowtally.operators.packets import replace_unknowns
from flowtally.operators.running import running
from flowtally.operators.scoring import global_row_numbers
from flowtally.sources.shared import stored

MOST_CLUSTERED = 400


def assemble(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """A features vector with missing flags beside imputed means, and the extra columns kept next to it."""
    flags = rows.withColumns({f"{c}_unknown": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in columns})
    clean = flags.withColumns({c: F.when(F.col(f"{c}_unknown") == 0, F.col(c).cast("double")) for c in columns})
    filled = replace_unknowns(clean, columns).fillna(0.0, columns)
    return VectorAssembler(inputCols=[*columns, *[f"{c}_unknown" for c in columns]], outputCol="features").transform(filled).select(*keep, "features")


def train(rows: DataFrame, kind: str = "trees", label: str = "label", weight: str | None = None, seed: int = 1, rounds: int = 10) -> PipelineModel:
    """Three-class boosted trees (one against the rest), forest or logistic regression, or a binary linear SVM."""
    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    models = {
        "trees": lambda: OneVsRest(classifier=GBTClassifier(maxIter=rounds, seed=seed, featuresCol="features"), **common),
        "forest": lambda: RandomForestClassifier(seed=seed, **common),
        "logistic": lambda: LogisticRegression(**common),
        "svm": lambda: LinearSVC(**common),
    }
    return Pipeline(stages=[models[kind]()]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows)


FEW, HOT = 100_000, 1000


def with_rank(rows: DataFrame, ranks: DataFrame, column: str, distinct: int, n: int) -> DataFrame:
    """``rows`` with the rank of their value of ``column`` in its place; ``ranks`` has value, n, rank.

    Few values are broadcast.  Of many, those that over one in ``HOT`` rows has are broadcast, and their rows are dealt out
    evenly instead of meeting in one task.
    """
    kept = [c for c in rows.columns if c != column]
    value = lambda table, name: table.select(F.col("value").alias("_v"), F.col("rank").alias(name))
    if distinct <= FEW:
        return rows.join(F.broadcast(value(ranks, "_rank")), F.col(column) == F.col("_v")).select(*kept, F.col("_rank").alias(column))
    hot = F.col("n") * HOT > n
    met = rows.join(F.broadcast(value(ranks.where(hot), "_hot")), F.col(column) == F.col("_v"), "left").drop("_v")
    cold = F.col("_hot").isNull()
    dealt = met.withColumns({"_v": F.when(cold, F.col(column)), "_deal": F.when(cold, F.lit(-1).cast("long")).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(1024)))})
    joined = dealt.join(value(ranks.where(~hot), "_cold").withColumn("_deal", F.lit(-1).cast("long")), ["_v", "_deal"], "left")
    return joined.select(*kept, F.coalesce("_hot", "_cold").alias(column))


def spearman_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Spearman's correlation of all pairs of columns that vary, unknown values imputed: (a, b, rho).

    Values are counted, so ranks are running sums over distinct values, and rows meet the rank of each of their values.
    """
    filled = stored(replace_unknowns(rows.select(*columns), columns), "filled")
    long = filled.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])).alias("_x")).select("_x.*").where("value is not null")
    counts = running(long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")), ["feature"], ["value"], {"_upto": ("sum", F.col("n"))})
    ranks = stored(counts.select("feature", "value", "n", (F.col("_upto") - (F.col("n") - 1) / 2).alias("rank")), "ranks")
    sizes = {r.feature: (r.distinct, r.n) for r in ranks.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("n")).collect()}
    used = [c for c in columns if sizes.get(c, (0, 0))[0] > 1]
    ranked = filled.select(*used)
    for c in used:
        ranked = with_rank(ranked, ranks.where(F.col("feature") == c), c, *sizes[c])
    vectors = VectorAssembler(inputCols=used, outputCol="features").transform(ranked).select("features")
    matrix = Correlation.corr(vectors, "features", "pearson").first()[0].toArray()
    return rows.sparkSession.createDataFrame([(a, b, float(matrix[i, j])) for i, a in enumerate(used) for j, b in enumerate(used)], "a string, b string, rho double")


def ward_clusters(matrix: np.ndarray, k: int) -> np.ndarray:
    """Ward linkage over the rows of a small matrix, cut at k clusters; labels by first member."""
    n = len(matrix)
    if n > MOST_CLUSTERED:
        raise ValueError(f"at most {MOST_CLUSTERED} features")
    members, centres = {i: [i] for i in range(n)}, {i: matrix[i].astype(float) for i in range(n)}
    while len(members) > k:
        ids = sorted(members)
        best = min(((len(members[a]) * len(members[b]) / (len(members[a]) + len(members[b])) * ((centres[a] - centres[b]) ** 2).sum(), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]))
        _, a, b = best
        na, nb = len(members[a]), len(members[b])
        centres[a] = (na * centres[a] + nb * centres.pop(b)) / (na + nb)
        members[a] += members.pop(b)
    labels = np.zeros(n, int)
    for c, key in enumerate(sorted(members)):
        labels[members[key]] = c
    return labels


def deals(n: int, repeats: int, seed: int = 1) -> list[tuple[int, int]]:
    """Multipliers and offsets (a, b) of maps i -> (a i + b) mod n that deal n rows to each other."""
    draw, out = random.Random(seed), []
    while len(out) < repeats:
        a = draw.randrange(n // 3 + 1, n) if n > 2 else 1
        if gcd(a, n) == 1:
            out.append((a, draw.randrange(1, max(n, 2))))
    return out


class Trees:
    """A fitted model of trees, as arrays: the class of each row of a matrix of features (columns, then their flags)."""

    def __init__(self, model) -> None:
        self.trees = []
        if isinstance(model, OneVsRestModel):
            for k, one in enumerate(model.models):
                for tree, weight in zip(one.trees, one.treeWeights):
                    self.add(tree, len(model.models), lambda leaf, k=k, weight=weight: {k: weight * leaf.prediction()})
        else:
            for tree in model.trees:
                self.add(tree, model.numClasses, lambda leaf: dict(enumerate(self.shares(list(leaf.impurityStats().stats())))))

    @staticmethod
    def shares(stats: list[float]) -> list[float]:
        return [x / sum(stats) for x in stats] if sum(stats) else stats

    def add(self, tree, classes: int, values) -> None:
        """Nodes in the order of their numbers; a leaf is its own child, and has a value per class."""
        nodes, waiting, depth = [], [(tree._call_java("rootNode"), 0)], 0
        at = 0
        while at < len(waiting):
            node, level = waiting[at]
            depth = max(depth, level)
            if node.getClass().getSimpleName() == "LeafNode":
                nodes.append((0, np.inf, at, at, values(node)))
            else:
                nodes.append((node.split().featureIndex(), node.split().threshold(), len(waiting), len(waiting) + 1, {}))
                waiting += [(node.leftChild(), level + 1), (node.rightChild(), level + 1)]
            at += 1
        value = np.zeros((len(nodes), classes))
        for i, n in enumerate(nodes):
            for k, x in n[4].items():
                value[i, k] = x
        feature, threshold, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
        self.trees.append((feature, threshold, left, right, value, depth, {int(n[0]) for n in nodes if np.isfinite(n[1])}))

    def leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        feature, threshold, left, right, _, depth, _ = self.trees[t]
        node, row = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            node = np.where(x[row, feature[node]] <= threshold[node], left[node], right[node])
        return node

    def classes(self, leaves: list[np.ndarray]) -> np.ndarray:
        return np.argmax(sum(tree[4][at] for tree, at in zip(self.trees, leaves)), axis=1)


def permutation_importance(model: PipelineModel, rows: DataFrame, columns: list[str], label: str, order: list[str], repeats: int = 1, seed: int = 1) -> DataFrame:
    """Drop in accuracy of a model of trees when one column's values are dealt to other rows; mean of ``repeats``.

    Rows are numbered and stored once; one join per row and repeat brings the row whose values
    it is dealt.  Each such pair is scored for all columns where it lies: of the trees only those that
    ask for a dealt column are walked again, and what leaves a task are counts.
    """
    numbered = stored(global_row_numbers(rows.select(*columns, label, *order), order).select("rn", label, *columns), "numbered")
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    size = numbered.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(x).alias(c) for c, x in known.items()]).first()
    n = size["_n"]
    if not n:
        return rows.sparkSession.createDataFrame([], "feature string, importance double")
    means, trees, one = np.array([size[c] or 0.0 for c in columns]), Trees(model.stages[-1]), [f"_own_{i}" for i in range(len(columns))]
    other = [f"_other_{i}" for i in range(len(columns))]
    flat = numbered.select("rn", F.col(label).cast("double").alias("_label"), *[known[c].alias(x) for c, x in zip(columns, one)])
    ways = F.array(*[F.struct(F.lit(r).alias("r"), F.pmod(F.col("rn").cast("decimal(38,0)") * a + b, F.lit(n)).cast("long").alias("to")) for r, (a, b) in enumerate(deals(n, repeats, seed))])
    asks = flat.withColumn("_way", F.explode(ways)).select(F.col("_way.to").alias("_from"), F.col("_way.r").alias("_r"), "_label", *one)
    met = asks.join(flat.select(F.col("rn").alias("_from"), *[F.col(x).alias(y) for x, y in zip(one, other)]), "_from").select("_r", "_label", *one, *other)

    def matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names])
        unknown = np.isnan(x)
        return np.hstack([np.where(unknown, means, x), unknown.astype(float)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = np.zeros((len(columns) + 1, repeats), np.int64)
        for batch in batches:
            own, dealt, truth, r = matrix(batch, one), matrix(batch, other), batch.column("_label").to_numpy(), batch.column("_r").to_numpy()
            leaves = [trees.leaves(own, t) for t in range(len(trees.trees))]
            right[-1] += np.bincount(r[trees.classes(leaves) == truth], minlength=repeats)
            for i in range(len(columns)):
                both = [i, i + len(columns)]
                mixed = own.copy()
                mixed[:, both] = dealt[:, both]
                found = trees.classes([trees.leaves(mixed, t) if tree[6] & set(both) else leaves[t] for t, tree in enumerate(trees.trees)])
                right[i] += np.bincount(r[found == truth], minlength=repeats)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(right)), repeats).astype(np.int32)), pa.array(right.ravel())], names=["_i", "_right"])

    counts = met.mapInArrow(score, "_i int, _right long").groupBy("_i").agg((F.sum("_right") / F.lit(float(n * repeats))).alias("_accuracy"))
    found = {r["_i"]: r["_accuracy"] for r in counts.collect()}
    return rows.sparkSession.createDataFrame([(c, float(found[len(columns)] - found[i])) for i, c in enumerate(columns)], "feature string, importance double")


def select_features(importances: DataFrame, clusters: DataFrame) -> DataFrame:
    """The most important feature of each cluster, in descending order of importance."""
    best = importances.join(clusters, "feature").groupBy("cluster").agg(F.max(F.struct("importance", "feature")).alias("_b"))
    return best.select("cluster", F.col("_b.feature").alias("feature"), F.col("_b.importance").alias("importance")).orderBy(F.desc("importance"), "feature")
