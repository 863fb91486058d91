"""Classifiers and feature selection on a table whose answer is known."""

from __future__ import annotations

import numpy as np
import pytest

from flowtally.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    """Three classes by the value of ``a``; ``b`` follows ``a`` loosely, ``c`` is noise, ``d`` its copy; some values unknown."""
    rng = np.random.default_rng(2)
    a = rng.random(900) * 3
    b, c = a + rng.normal(0, 0.8, 900), rng.random(900)
    return spark.createDataFrame([(k, float(x), None if k % 50 == 0 else float(y), float(z), float(z) * 2, float(int(x))) for k, (x, y, z) in enumerate(zip(a, b, c))], "k long, a double, b double, c double, d double, label double").cache()


COLUMNS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("kind", ["trees", "forest", "logistic"])
def test_three_classes_are_learnt(rows, kind):
    ready = models.assemble(rows, COLUMNS, ["k", "label"])
    model = models.train(ready.where("k % 4 <> 0"), kind, rounds=5)
    scored = models.predict(model, ready.where("k % 4 = 0")).toPandas()
    assert len(scored) == 225 and (scored.prediction == scored.label).mean() > 0.9


def test_the_binary_machine_and_saved_models(rows, tmp_path):
    ready = models.assemble(rows.withColumn("label", (rows.a > 1.5).cast("double")), COLUMNS, ["k", "label"])
    model = models.train(ready, "svm")
    path = str(tmp_path / "m")
    model.write().overwrite().save(path)
    again = models.PipelineModel.load(path)
    a, b = (models.predict(m, ready).orderBy("k").toPandas() for m in (model, again))
    assert (a.prediction == b.prediction).all() and (a.prediction == a.label).mean() > 0.95


def test_the_best_of_each_cluster_is_chosen(spark, rows):
    matrix = models.spearman_matrix(rows, COLUMNS).toPandas().pivot(index="a", columns="b", values="rho")
    assert matrix.loc["c", "d"] == pytest.approx(1) and abs(matrix.loc["a", "c"]) < 0.1 and matrix.loc["a", "b"] > 0.6
    clusters = models.ward_clusters(matrix.to_numpy(), 2)
    assert clusters.tolist() == [0, 0, 1, 1]
    model = models.train(models.assemble(rows, COLUMNS, ["label"]), "forest")
    importances = models.permutation_importance(model, rows, COLUMNS, "label", ["k"], repeats=2)
    found = {r.feature: r.importance for r in importances.collect()}
    assert found["a"] > 0.2 and max(found["c"], found["d"]) < 0.05
    chosen = models.select_features(importances, spark.createDataFrame([(f, int(c)) for f, c in zip(matrix.index, clusters)], "feature string, cluster int")).collect()
    assert chosen[0].feature == "a" and {r.cluster for r in chosen} == {0, 1}


def test_deals_move_every_row():
    for n in (1, 2, 3, 10, 97, 900):
        for a, b in models.deals(n, 3):
            dealt = [(a * i + b) % n for i in range(n)]
            assert sorted(dealt) == list(range(n)) and (n < 3 or sum(x == i for i, x in enumerate(dealt)) <= n // 2)


def test_importance_of_a_known_rule(spark):
    """A model that reads ``a`` alone: a dealt ``a`` is right only where the dealt value has the label, another column changes nothing."""
    rows = spark.createDataFrame([(k, float(k % 4), float(k % 3), float(k % 4)) for k in range(120)], "k long, a double, b double, label double")
    model = models.train(models.assemble(rows, ["a", "b"], ["label"]), "forest", seed=3)
    found = {r.feature: r.importance for r in models.permutation_importance(model, rows, ["a", "b"], "label", ["k"], repeats=4).collect()}
    right = [sum(((a * k + b) % 120) % 4 == k % 4 for k in range(120)) / 120 for a, b in models.deals(120, 4)]
    assert found["a"] == pytest.approx(1 - sum(right) / 4) and found["b"] == pytest.approx(0)
    assert models.permutation_importance(model, rows.limit(0), ["a", "b"], "label", ["k"]).count() == 0


def test_discarded_tables_are_gone(spark):
    from flowtally.sources.shared import discard, stored

    df = stored(spark.range(5), "gone")
    assert df.count() == 5
    discard(df, spark.range(1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.schema("id long").parquet(df._stored_at).count()


def test_ranks_of_many_values_with_a_common_one(spark, monkeypatch):
    """Values too many to broadcast, one of them of most rows and some unknown, have the ranks that pandas gives."""
    import pandas as pd

    monkeypatch.setattr(models, "FEW", 10)
    monkeypatch.setattr(models, "HOT", 5)
    rng = np.random.default_rng(7)
    table = pd.DataFrame({"a": np.where(rng.random(400) < 0.6, 0.25, rng.random(400)), "b": rng.integers(0, 6, 400).astype(float), "c": rng.random(400), "same": 1.0})
    table["c"] = table["c"] + table["a"]
    rows = spark.createDataFrame([(*map(float, x), None if k % 9 == 0 else float(x[2])) for k, x in enumerate(table.to_numpy())], "a double, b double, c double, same double, d double")
    want = table.assign(d=table["c"].where(np.arange(400) % 9 != 0).pipe(lambda x: x.fillna(x.mean()))).drop(columns="same").corr("spearman")
    got = models.spearman_matrix(rows, ["a", "b", "c", "same", "d"]).toPandas().pivot(index="a", columns="b", values="rho")
    assert list(got.index) == ["a", "b", "c", "d"] and np.allclose(got.to_numpy(), want.to_numpy())


@pytest.mark.parametrize("kind", ["trees", "forest"])
def test_trees_as_arrays_score_as_the_model_does(rows, kind):
    model = models.train(models.assemble(rows, COLUMNS, ["k", "label"]), kind, rounds=4)
    scored = models.predict(model, models.assemble(rows, COLUMNS, ["k", "label"])).toPandas()
    trees, x = models.Trees(model.stages[-1]), np.array([v.toArray() for v in scored["features"]])
    assert (trees.classes([trees.leaves(x, t) for t in range(len(trees.trees))]) == scored["prediction"]).all()
