"""Quality classifier: a generalised additive model with pairwise interactions.

Statistics are cut into quantile bins.  Boosting goes round the statistics in turn and
fits a tree of at most ``leaves`` leaves over a statistic's bins to the gradient of the
log loss, so the model is one lookup table per statistic.  Then the pairs of statistics
whose 2 x 2 cuts explain most of what is left get tables of their own, boosted the same
way.  A score is the logistic of the intercept plus one table entry per statistic and
pair: bin, look up, add, for whole batches at once.

Training rows are labelled rows that are not held out, at most about ``max_rows``;
labels, language, source and ids are never inputs.  The model is some kB and all
documents are scored in the scan itself.

Cases: null and blank texts are scored as empty ones; with labels of one class or none
the score is that class's smoothed share (0.5 without labels); contradictory labels of
one doc_id count as bad; repeated rows score alike; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowtally.llm.common import slices
from flowtally.llm.quality_forest import labelled_stats
from flowtally.llm.textstats import ALL, RATIOS, stat_matrix

BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES, RATE, MAX_ROWS, THRESHOLD, LEAST = 32, 8, 150, 60, 8, 3, 0.15, 20_000, 0.3, 8.0


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Additive:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges of quantile bins; halfway between neighbouring values."""
    v = np.unique(x)
    if len(v) <= bins:
        return (v[1:] + v[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def bin_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton steps of a small tree over ordered bins, grown at the best gain first."""
    value, parts = np.zeros(len(g)), [(0, len(g))]
    gain = lambda s, e: g[s:e].sum() ** 2 / (h[s:e].sum() + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for s, e in parts:
            if e - s < 2:
                continue
            cg, ch, cn = np.cumsum(g[s:e])[:-1], np.cumsum(h[s:e])[:-1], np.cumsum(n[s:e])[:-1]
            total_g, total_h, total_n = g[s:e].sum(), h[s:e].sum(), n[s:e].sum()
            won = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - gain(s, e)
            won[(cn < least) | (total_n - cn < least)] = 0
            k = int(won.argmax())
            if won[k] > best[0]:
                best = (won[k], (s, e), s + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    for s, e in parts:
        value[s:e] = -g[s:e].sum() / (h[s:e].sum() + 1.0)
    return value


def best_cross(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain and place of the best 2 x 2 cut of a grid of gradients."""
    cg, ch = (np.cumsum(np.cumsum(z, 0), 1) for z in (g, h))
    best = (0.0, 0, 0)
    part = lambda c, i, j: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    for i in range(len(g) - 1):
        for j in range(g.shape[1] - 1):
            won = sum(a * a / (b + 1) for a, b in zip(part(cg, i, j), part(ch, i, j)))
            if won > best[0]:
                best = (won, i, j)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of single statistics, then of the strongest pairs."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    edges, pair_edges = [cuts(c, BINS) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1], [cuts(c, PAIR_BINS) for c in x.T] if len(x) else [np.zeros(0)] * x.shape[1]
    model = Additive(edges, pair_edges, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T)]
    counts = [np.bincount(a, minlength=len(t)).astype(float) for a, t in zip(at, model.tables)]
    logit = np.full(len(y), model.intercept)

    def gradients():
        p = 1 / (1 + np.exp(-logit))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = gradients()
            step = RATE * bin_tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), counts[k], LEAVES, LEAST)
            table += step
            logit += step[at[k]]
    cell = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T)]
    g, h = gradients()
    grid = lambda w, a, b: np.bincount(cell[a] * (len(pair_edges[b]) + 1) + cell[b], w, (len(pair_edges[a]) + 1) * (len(pair_edges[b]) + 1)).reshape(len(pair_edges[a]) + 1, -1)
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda ab: -best_cross(grid(g, *ab), grid(h, *ab))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            g, h = gradients()
            gg, hh = grid(g, a, b), grid(h, a, b)
            won, i, j = best_cross(gg, hh)
            if not won:
                continue
            step = np.zeros_like(table)
            for rows in (slice(0, i + 1), slice(i + 1, None)):
                for cols in (slice(0, j + 1), slice(j + 1, None)):
                    step[rows, cols] = -RATE * gg[rows, cols].sum() / (hh[rows, cols].sum() + 1.0)
            table += step
            logit += step[cell[a], cell[b]]
    return model


INPUTS = [ALL.index(r) for r in RATIOS]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, doc_id: str = "doc_id", text: str = "text") -> Additive:
    """The model of labelled rows that are not held out."""
    stats, y, _ = labelled_stats(docs, labels, "quality", max_rows, doc_id, text, only=lambda c: ~held_out(c))
    return train(stats[:, INPUTS], y)


def scores(docs: DataFrame, model: Additive, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted (score >= 0.3) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(stat_matrix(texts)[:, INPUTS]))], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of at least 0.3, with their columns."""
    model, at = fit(docs, labels, doc_id=doc_id, text=text), docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, at):
                yield part.filter(pa.array(model.score(stat_matrix(texts)[:, INPUTS]) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
