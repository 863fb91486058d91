"""Quality rules as an isolation forest over rule statistics.

Every tree isolates ``psi`` labelled rows by random splits: a rule statistic is drawn by
how far it alone separates good from bad rows (the greatest distance of the two
distribution functions; all alike without both classes), the cut evenly over its range
in the node.  Rows that few splits isolate are anomalous: a row's score is
2^(-mean path length / c(psi)).  The trees are grown on a bounded sample of labelled rows
(``max_rows``, half of them at most).  The threshold is calibrated on all the other
labelled rows, counted by score in ``SCORE_BINS`` bins: the lowest score that rejects at
most ``clean_loss`` of the good ones, moved up to halfway to the next bad one, so clean
documents stay.  Two plain rules come first: fewer than 50 words, or over half the words
in repeated three-word windows.

Documents are scored by the broadcast forest (some hundred kB whatever the input) in the
scan; only ids and scores are joined with the labels.

Cases: null and blank texts have no words and fail the base rule; without any usable
label only the base rules decide; without a good label outside the sample the grown-on
rows calibrate; contradictory labels of one doc_id count as bad; repeated rows are judged
alike, and a doc_id that repeats gives the sample one row; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowtally.llm.common import slices, store
from flowtally.llm.textstats import ALL, stat_matrix

RULES = ("symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "top_word_share", "chars_per_word", "distinct_share")
TREES, PSI, MAX_ROWS, CLEAN_LOSS, SCORE_BINS, SEED = 200, 256, 20_000, 0.001, 10_000, 11


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Full binary trees as arrays [tree, node]: feature (-1 at a leaf), cut, path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    psi: int
    threshold: float = np.inf

    def path_lengths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees."""
        depth, trees, rows = np.zeros(len(x)), len(self.feature), np.arange(len(x))
        levels = int(np.log2(self.feature.shape[1] + 1))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(levels - 1):
                f = self.feature[t, node]
                right = x[rows, np.maximum(f, 0)] >= self.cut[t, node]
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            depth += self.path[t, node]
        return depth / trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 2.0 ** (-self.path_lengths(x) / max(float(expected_path(self.psi)), 1e-9))


def separation(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How far each statistic alone separates good from bad rows: the greatest distance of their distribution functions."""
    if good.all() or not good.any():
        return np.ones(x.shape[1])
    share = lambda rows, at: np.searchsorted(np.sort(rows), at, "right") / len(rows)
    return np.array([np.abs(share(c[good], np.unique(c)) - share(c[~good], np.unique(c))).max() for c in x.T])


def grow(x: np.ndarray, good: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED, draw: str = "separation") -> Forest:
    """Isolation trees over the rows of ``x``, each on up to ``psi`` of them; ``good`` marks the rows labelled good.

    The statistic of a split is drawn by ``separation`` of the labels, or evenly (``draw="even"``).
    """
    rng, weight = np.random.default_rng(seed), np.ones(x.shape[1]) if draw == "even" else separation(x, good) + 1e-9
    psi = min(psi, len(x))
    levels = int(np.ceil(np.log2(max(psi, 2)))) + 1
    size = (1 << levels) - 1
    feature, cut, path = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        waiting = [(0, 0, x[rng.choice(len(x), psi, replace=False)])]
        while waiting:
            node, depth, rows = waiting.pop()
            least, most = rows.min(0), rows.max(0)
            open_ = np.flatnonzero(most > least)
            if depth == levels - 1 or len(rows) <= 1 or not len(open_):
                path[t, node] = depth + expected_path(len(rows))
                continue
            f = int(rng.choice(open_, p=weight[open_] / weight[open_].sum()))
            c = rng.uniform(least[f], most[f])
            c = c if c > least[f] else most[f]
            feature[t, node], cut[t, node] = f, c
            right = rows[:, f] >= c
            waiting += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, cut, path, psi)


def threshold_of(bins: np.ndarray, good: np.ndarray, n: np.ndarray, clean_loss: float = CLEAN_LOSS) -> float:
    """The threshold for rows counted (``n``) by score bin and label: at most ``clean_loss`` of the good ones lie above."""
    have, bad = np.bincount(bins[good], n[good], SCORE_BINS), np.bincount(bins[~good], n[~good], SCORE_BINS)
    if not have.sum():
        return np.inf
    above = have.sum() - np.cumsum(have)  # good rows in higher bins
    edge = int(np.flatnonzero(above <= clean_loss * have.sum())[0])
    worse = np.flatnonzero(bad[edge + 1 :])
    return (edge + 1 + (worse[0] / 2 if len(worse) else 0)) / SCORE_BINS


def judge(stats: np.ndarray, forest: Forest | None) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and score for rows of statistics (columns ``ALL``)."""
    words, repeats = stats[:, 0], stats[:, ALL.index("n_repeat_words")]
    failed = (words < 50) | (100 * repeats > 50 * words)
    return failed, forest.scores(stats[:, AT]) if forest is not None and len(stats) else np.zeros(len(stats))


AT = [ALL.index(r) for r in RULES]


def usable(labels: DataFrame, label: str, doc_id: str = "doc_id", only=None) -> DataFrame:
    """(id, label): one row per labelled doc_id, the worst of its labels."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    rows = rows.where(only(F.col(doc_id))) if only else rows
    return rows.groupBy(F.col(doc_id).cast("string").alias("id")).agg(F.min(label).cast("int").alias("label"))


def drawn(share: float):
    """True for the ids of a sample of about ``share`` of all ids, drawn by hash."""
    return F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000)


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id", text: str = "text", only=None, most: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Statistics and labels of a bounded sample of labelled rows, and the share of ids drawn.

    About ``max_rows`` ids at most, and at most the share ``most`` of all, drawn by the hash of
    doc_id; one row for each id.  The sampled ids are bounded by ``max_rows`` and so
    broadcast; the texts stay where they are.
    """
    share = min(most, max_rows / max(1, labels.count()))
    chosen = usable(labels, label, doc_id, only).where(drawn(share))
    found = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(stat_matrix(texts)), pa.list_(pa.float64()))], names=["id", "label", "stats"])

    got = found.mapInArrow(measure, "id string, label int, stats array<double>").groupBy("id", "label").agg(F.min("stats").alias("stats")).toPandas()
    x = np.array(got["stats"].tolist(), np.float64).reshape(len(got), len(ALL))
    order = np.lexsort([*x.T])  # the same model whatever the order in which rows came
    return x[order], got["label"].to_numpy(np.int64)[order], share


def grown(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text", draw: str = "separation") -> tuple[Forest | None, float]:
    """The forest of a sample of labelled rows (None without any), without a threshold, and the share of ids drawn."""
    stats, y, share = labelled_stats(docs, labels, "quality", max_rows, doc_id, text, most=0.5)
    stats, y = stats[~(failed := judge(stats, None)[0])], y[~failed]
    return (grow(stats[:, AT], y == 1, draw=draw) if len(stats) else None), share


def calibrated(scored: DataFrame, labels: DataFrame, share: float, clean_loss: float = CLEAN_LOSS, doc_id: str = "doc_id") -> float:
    """The threshold from all labelled rows of ``scored`` (doc_id, base_failed, score) outside the sample of ``share``.

    Rows are counted by id and score bin before they meet the labels, so an id that repeats in a
    third of all rows is one row; at most 4 * ``SCORE_BINS`` counts reach the driver.
    """
    bin_ = F.least(F.floor(F.col("score") * SCORE_BINS), F.lit(SCORE_BINS - 1)).cast("int").alias("bin")
    counted = scored.where(~F.col("base_failed")).groupBy(F.col(doc_id).cast("string").alias("id"), bin_).agg(F.count(F.lit(1)).alias("n"))
    got = counted.join(usable(labels, "quality", doc_id), "id").groupBy(drawn(share).alias("seen"), "label", "bin").agg(F.sum("n").alias("n")).toPandas()
    rest = got[~got.seen]
    got = rest if (rest.label == 1).any() else got
    return threshold_of(got["bin"].to_numpy(np.int64), got["label"].to_numpy() == 1, got["n"].to_numpy(float), clean_loss)


def measured(docs: DataFrame, forest: Forest | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed and score of every row."""
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                stats = stat_matrix(texts)
                failed, score = judge(stats, forest)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(stats[:, k].astype(np.int64)) for k in range(5)], pa.array(failed), pa.array(score)], names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, clean_loss: float = CLEAN_LOSS, doc_id: str = "doc_id", text: str = "text") -> Forest | None:
    """The calibrated forest; None without any usable label."""
    forest, share = grown(docs, labels, max_rows, doc_id, text)
    if forest is not None:
        forest.threshold = calibrated(measured(docs, forest, doc_id, text), labels.withColumnRenamed(doc_id, "doc_id"), share, clean_loss)
    return forest


def _kept(threshold: float):
    return ~F.col("base_failed") & ~(F.col("score") > F.lit(float(threshold)))


def verdicts(docs: DataFrame, forest: Forest | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept of every row."""
    return measured(docs, forest, doc_id, text).withColumn("kept", _kept(forest.threshold if forest is not None else np.inf))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, clean_loss: float = CLEAN_LOSS, doc_id: str = "doc_id", text: str = "text", draw: str = "separation") -> DataFrame:
    """``verdicts`` under the forest of ``labels``, with one pass over the texts for threshold and verdicts."""
    forest, share = grown(docs, labels, max_rows, doc_id, text, draw)
    if forest is None:
        return verdicts(docs, None, doc_id, text)
    rows = store(measured(docs, forest, doc_id, text), "scored")
    return rows.withColumn("kept", _kept(calibrated(rows, labels.withColumnRenamed(doc_id, "doc_id"), share, clean_loss)))


def kept_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, clean_loss: float = CLEAN_LOSS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns.

    Texts are measured twice, for the threshold and for the verdicts, rather than stored between.
    """
    forest, at = fit(docs, labels, max_rows, clean_loss, doc_id, text), docs.columns.index(text)
    limit = forest.threshold if forest is not None else np.inf

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, at):
                failed, score = judge(stat_matrix(texts), forest)
                yield part.filter(pa.array(~failed & ~(score > limit)))

    return docs.mapInArrow(run, docs.schema)
