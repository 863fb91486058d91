"""Rules, forest and additive model."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.llm import quality_forest as forest, quality_gam as gam
from flowtally.llm.textstats import ALL, text_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_base(text: str) -> tuple[int, ...]:
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


TEXTS = ["", "\n \n", "a b c a b c a b", "é ü\x85x\xa0y | <b>", "l1\nl1\n\n l1\nl1\r\n", "x " * 5000, "a b c\x0bd e\x0cf a b c"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_counts(text):
    assert text_stats(text)[:5] == naive_base(text)


@pytest.fixture(scope="module")
def tables(spark):
    data = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 3000")
    return docs, spark.read.parquet(f"{data}/labels.parquet").where("doc_id < 3000")


def test_forest_keeps_clean_and_drops_junk(tables):
    docs, labels = tables
    rows = forest.verdicts(docs, forest.fit(docs, labels)).join(labels, "doc_id").toPandas()
    rows["wrong"] = (rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words)
    assert (rows.base_failed == rows.wrong).all() and not (rows.kept & rows.base_failed).any()
    judged = rows[~rows.base_failed]
    assert judged[judged.quality == 1].kept.mean() > 0.99 and judged[judged.quality == 0].kept.mean() < 0.2


def test_additive_model_on_held_out_rows(tables):
    docs, labels = tables
    rows = gam.scores(docs, gam.fit(docs, labels)).join(labels, "doc_id").toPandas()
    held = rows[rows.held_out]
    assert len(rows) and (held.predicted == held.quality).mean() > 0.97
    assert ((rows.score >= 0) & (rows.score <= 1)).all() and (rows.predicted == (rows.score >= 0.3)).all()


def test_held_out_rows_are_not_learnt(tables, spark):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(gam.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (gam.scores(docs, gam.fit(docs, x)).orderBy("doc_id").toPandas().score for x in (labels, flipped))
    assert (a == b).all()


@pytest.mark.parametrize("schema", ["doc_id long, text string, score double, kept int, label string, stats string"])
def test_odd_tables(spark, schema):
    docs = spark.createDataFrame([(1, None, 1.0, 1, "x", "y"), (2, "", None, None, None, None), (2, "", None, None, None, None), (None, "w " * 60_000, 0.0, 0, "", "")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (1, 1), (1, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    for labels in (none, odd):
        assert forest.verdicts(docs, forest.fit(docs, labels)).count() == 4
        got = gam.scores(docs, gam.fit(docs, labels)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
        assert forest.kept_rows(docs, labels).columns == docs.columns
        assert gam.good_rows(docs, labels).columns == docs.columns
    empty = docs.limit(0)
    assert forest.verdicts(empty, forest.fit(empty, none)).count() == 0
    assert gam.scores(empty, gam.fit(empty, none)).count() == 0


def test_isolation_depth():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(forest.RULES)))
    x[-1] = 12
    f = forest.grow(x, np.arange(500) < 499)
    s = f.scores(x)
    assert s.argmax() == 499 and s[499] > 0.6 and len(ALL) == 19


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.train(x, y)
    assert m.pairs[0] == (0, 1) and ((m.score(x) > 0.5) == y).mean() > 0.95


def naive_path(f, t: int, row, node: int = 0, depth: int = 0) -> float:
    """Depth of the leaf that a row reaches, found step by step."""
    if f.feature[t, node] < 0:
        assert f.path[t, node] >= depth
        return f.path[t, node]
    return naive_path(f, t, row, 2 * node + (2 if row[f.feature[t, node]] >= f.cut[t, node] else 1), depth + 1)


def test_path_lengths_against_a_recursive_walk():
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(300, 4)), np.zeros((50, 4)), rng.normal(5, 1, size=(10, 4))])
    f = forest.grow(x, np.arange(360) < 350, trees=20, psi=64)
    want = [np.mean([naive_path(f, t, row) for t in range(20)]) for row in x]
    assert np.allclose(f.path_lengths(x), want, atol=1e-12)
    c = lambda n: 0 if n < 2 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert np.allclose(f.scores(x), 2 ** (-np.array(want) / c(64)), atol=1e-12)
    assert all(np.isclose(forest.expected_path(n), c(n)) for n in (1, 2, 3, 64, 256))


def clusters(rng, n: int, odd: int):
    """Good rows near (0.1, 0.1) and (0.9, 0.9); odd ones near the other two corners, inside every single range."""
    side = rng.random(n) < 0.5
    good = np.where(side, 0.1, 0.9)[:, None] + rng.normal(0, 0.03, (n, 2))
    side = rng.random(odd) < 0.5
    bad = np.stack([np.where(side, 0.1, 0.9), np.where(side, 0.9, 0.1)], 1) + rng.normal(0, 0.03, (odd, 2))
    bad = np.clip(bad, good.min(0), good.max(0))
    return np.vstack([good, bad]), np.arange(n + odd) < n


def test_odd_combinations_are_rejected_inside_every_single_range():
    rng = np.random.default_rng(5)
    x, good = clusters(rng, 4000, 60)
    f = forest.grow(x, good)
    y, fine = clusters(rng, 4000, 60)
    s = f.scores(y)
    f.threshold = forest.threshold_of(np.minimum((s * forest.SCORE_BINS).astype(int), forest.SCORE_BINS - 1), fine, np.ones(len(y)), 0.005)
    z, clean = clusters(rng, 4000, 200)
    rejected = f.scores(z) > f.threshold
    low, high = x[good].min(0), x[good].max(0)
    box = ((z < low) | (z > high)).any(1)
    assert rejected[~clean].mean() > 0.8 and rejected[clean].mean() < 0.02
    assert not box[~clean].any()  # a range rule finds none of them


def test_threshold_against_every_possible_one():
    rng = np.random.default_rng(7)
    for good_n, bad_n in ((1000, 50), (3, 2), (1, 0), (0, 4)):
        bins = np.concatenate([rng.integers(3000, 6000, good_n), rng.integers(4500, 8000, bad_n)])
        good = np.arange(good_n + bad_n) < good_n
        got = forest.threshold_of(bins, good, np.ones(len(bins)), 0.01)
        if not good_n:
            assert got == np.inf
            continue
        lost = lambda edge: (bins[good] > edge).sum()
        edge = min(e for e in range(forest.SCORE_BINS) if lost(e) <= 0.01 * good_n)
        worse = bins[~good][bins[~good] > edge]
        assert np.isclose(got * forest.SCORE_BINS, edge + 1 + ((worse.min() - edge - 1) / 2 if len(worse) else 0))


def test_one_pass_gives_the_verdicts_of_fit_and_kept_rows(tables):
    docs, labels = tables
    a = {r.doc_id: r for r in forest.verdicts(docs, forest.fit(docs, labels)).collect()}
    b = {r.doc_id: r for r in forest.judged(docs, labels).collect()}
    assert a == b
    assert sorted(r.doc_id for r in forest.kept_rows(docs, labels).select("doc_id").collect()) == sorted(k for k, r in b.items() if r.kept)


def test_verdict_against_a_range_rule(tables):
    """How often ranges of single statistics (of good rows, 0.1 % off each end) would say the same; the forest must not be one."""
    docs, labels = tables
    f, share = forest.grown(docs, labels)
    stats, y, _ = forest.labelled_stats(docs, labels, "quality", 10**6)
    failed, score = forest.judge(stats, f)
    f.threshold = forest.fit(docs, labels).threshold
    x, good = stats[~failed][:, forest.AT], y[~failed] == 1
    low, high = np.quantile(x[good], 0.001, axis=0), np.quantile(x[good], 0.999, axis=0)
    outside, rejected = ((x < low) | (x > high)).any(1), score[~failed] > f.threshold
    print(f"range rule and forest agree on {np.mean(outside == rejected):.4f} of {len(x)} rows; outside {outside.sum()}, rejected {rejected.sum()}, both {(outside & rejected).sum()}")
    assert share == 0.5 and len(np.unique(score[~failed].round(6))) > 100
    assert rejected[good].mean() <= 0.005 and rejected[~good].mean() > 0.9


def test_an_even_draw_splits_by_every_statistic():
    """Only the first statistic tells the labels apart; an even draw uses the others as often."""
    rng = np.random.default_rng(1)
    good = rng.random(600) < 0.8
    x = rng.random((600, 4))
    x[:, 0] += ~good
    by_labels, even = (forest.grow(x, good, draw=d).feature for d in ("separation", "even"))
    share = lambda f: (f == 0).sum() / (f >= 0).sum()
    assert share(by_labels) > 0.5 and abs(share(even) - 0.25) < 0.05
