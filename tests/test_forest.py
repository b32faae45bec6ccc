"""Forests without a depth limit, against a plain Python grower and by what full trees must predict."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from arealis.plans import forest, training
from arealis.plans.boosting import binned
from arealis.plans.forest import Settings


def plain(x, y, least=1, depth=None):
    """{path: (feature, rows, mean)} by exhaustive search; feature -1 at leaves."""
    out = {}
    todo = [("", np.arange(len(x)))]
    while todo:
        path, rows = todo.pop()
        best = None
        if y[rows].min() < y[rows].max() and (depth is None or len(path) < depth):
            for f in range(x.shape[1]):
                for v in np.unique(x[rows, f])[:-1]:
                    go = x[rows, f] <= v
                    a, b = rows[go], rows[~go]
                    if min(len(a), len(b)) < least:
                        continue
                    gap = y[rows] - y[rows].mean()
                    gain = gap[go].sum() ** 2 / len(a) + gap[~go].sum() ** 2 / len(b)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, f, a, b)
        out[path] = (best[1] if best else -1, len(rows), round(y[rows].mean(), 6))
        if best:
            todo += [(path + "l", best[2]), (path + "r", best[3])]
    return out


def paths(model):
    """The same of an MLlib tree."""
    out, todo = {}, [("", model._call_java("rootNode"))]
    while todo:
        path, node = todo.pop()
        inner = node.getClass().getSimpleName() == "InternalNode"
        split = node.split().featureIndex() if inner else -1
        out[path] = (split, int(node.impurityStats().count()), round(node.prediction(), 6))
        if inner:
            todo += [(path + "l", node.leftChild()), (path + "r", node.rightChild())]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)
    y = np.round(x[:, 0] * 3 - (x[:, 1] - 5) ** 2 + rng.normal(size=300), 3)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, y double").repartition(5)
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


@pytest.mark.parametrize(("least", "depth", "task_rows"), [(1, None, 1 << 15), (1, None, 20), (4, None, 50), (2, 5, 40)])
def test_a_tree_is_the_plain_one_wherever_its_parts_are_grown(table, least, depth, task_rows):
    x, y, df = table
    s = Settings(trees=1, bootstrap=False, min_leaf=least, depth=depth, task_rows=task_rows)
    model = forest.DeepForest("y", s).fit(df)
    assert paths(model.trees[0]) == plain(x, y, least, depth)


def test_a_chain_is_followed_to_pure_leaves(spark):
    n = 60
    df = spark.range(n * 3).select((F.col("id") % n).cast("double").alias("x"), F.pow(F.lit(2.5), F.col("id") % n).alias("y"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    for task_rows in (1 << 15, 50):
        model = forest.DeepForest("y", Settings(trees=1, bootstrap=False, task_rows=task_rows)).fit(rows)
        assert model.trees[0].depth > 40 and model.trees[0].numNodes == 2 * n - 1
        off = model.transform(rows).agg(F.max(F.abs(F.col("prediction") / F.col("y") - 1))).first()[0]
        assert off < 1e-6


def test_a_forest_is_the_same_however_rows_are_dealt(table):
    x, y, df = table
    kept = df.orderBy("i").coalesce(1)
    s = Settings(trees=6, features="sqrt", task_rows=60, together=4)
    a, b = (forest.DeepForest("y", s).fit(kept) for _ in range(2))
    assert [paths(t) for t in a.trees] == [paths(t) for t in b.trees]
    assert len({str(paths(t)) for t in a.trees}) == 6
    # each tree saw about as many rows as the table has, and no node is lost between the parts
    for t in a.trees:
        found = paths(t)
        assert 200 < found[""][1] < 400
        assert sum(v[1] for v in found.values() if v[0] < 0) == found[""][1]
        assert all(v[1] == found[p + "l"][1] + found[p + "r"][1] for p, v in found.items() if v[0] >= 0)


def test_it_predicts_rows_it_has_not_seen(table):
    x, y, df = table
    model = forest.DeepForest("y", Settings(trees=30, task_rows=100)).fit(df.where("i % 4 > 0"))
    got = dict(model.transform(df.where("i % 4 = 0")).select("i", "prediction").collect())
    off = math.sqrt(np.mean([(p - y[i]) ** 2 for i, p in got.items()]))
    assert off < 0.4 * y.std()
    assert model.featureImportances.toArray().argmin() == 2


def test_a_split_is_found_though_the_features_tried_are_constant(spark):
    rows = [(0.0, 0.0, 0.0, float(i), float(i % 2)) for i in range(16)]
    df = VectorAssembler(inputCols=["a", "b", "c", "x"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, x double, y double"))
    for task_rows in (100, 4):
        model = forest.DeepForest("y", Settings(trees=1, bootstrap=False, features=0.25, task_rows=task_rows)).fit(df)
        assert model.transform(df).where("prediction != y").count() == 0


def test_edges_of_the_input(spark, tmp_path):
    schema = "x double, z double, y double"
    rows = [(1.0, None, 5.0), (None, 2.0, 1.0), (math.nan, 2.0, 1.0), (3.0, None, 5.0), (4.0, 1.0, None)]
    df = spark.createDataFrame(rows, schema)
    model = forest.fit(binned(df, ["x", "z"], "y"), Settings(trees=2, bootstrap=False), spark)
    assert model.predict(Vectors.dense([1.0, 9.0])) == 5.0 and model.predict(Vectors.dense([math.nan, 2.0])) == 1.0
    empty = forest.fit(binned(df.limit(0), ["x"], "y"), Settings(trees=2), spark)
    assert empty.predict(Vectors.dense([1.0])) == 0.0
    same = forest.fit(binned(df.withColumn("y", F.lit(7.0)), ["x"], "y"), Settings(trees=2, task_rows=2), spark)
    assert same.predict(Vectors.dense([1.0])) == 7.0 and all(t.numNodes == 1 for t in same.trees)
    bare = forest.fit(binned(df, [], "y"), Settings(trees=1, bootstrap=False, task_rows=2), spark)
    assert bare.predict(Vectors.dense([])) == 3.0
    model.write().save(f"{tmp_path}/m")
    assert forest.RandomForestRegressionModel.load(f"{tmp_path}/m").predict(Vectors.dense([1.0, 9.0])) == 5.0


def test_no_limit_is_no_limit():
    build = training.build_models(["a"], "y")[training.FOREST]
    stage = build({"max_depth": None, "n_estimators": 7, "min_samples_leaf": 2, "max_features": "sqrt"}).getStages()[-1]
    assert stage.settings == Settings(trees=7, depth=None, min_leaf=2, features="sqrt", seed=42)
    assert build({"max_depth": 10}).getStages()[-1].getMaxDepth() == 10
    deep = build({"max_depth": 40}).getStages()[-1]
    assert deep.settings.depth == 40


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 15, size=(240, 3)).astype(float)
    y = np.round(x[:, 0] - (x[:, 1] - 7) ** 2 / 4 + rng.normal(size=240), 3)
    rows = [(*(None if i % 37 == f else float(v) for f, v in enumerate(r)), float(t), i % 4) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return binned(spark.createDataFrame(rows, "a double, b double, c double, y double, fold int").repartition(3), ["a", "b", "c"], "y", "fold")


@pytest.mark.parametrize(("depth", "task_rows"), [(None, 1 << 15), (None, 30), (9, 60)])
def test_deep_trees_err_alike_wherever_they_are_grown(spark, folded, monkeypatch, depth, task_rows):
    fills, centres = [7.0, 7.0, 7.0], {i: 0.0 for i in range(4)}
    wanted = [(n, Settings(trees=5, depth=depth, min_leaf=m, task_rows=task_rows, together=2), i, fills) for n, m in (("a", 1), ("b", 3)) for i in range(4)]
    here = {(r.model, r.fold): r for r in forest.deep_errors(folded, wanted, centres).collect()}
    assert len(here) == 8 and all(r.n == 60 for r in here.values())
    monkeypatch.setattr(forest.boosting, "SENT", 0)
    monkeypatch.setattr(forest.boosting, "ROWS", 16)  # held-out rows are predicted some at a time
    for r in forest.deep_errors(folded, wanted, centres).collect():
        for c in ("n", "squares", "gaps", "off", "off2"):
            assert r[c] == pytest.approx(here[r.model, r.fold][c], rel=1e-9), c


def test_a_deep_tree_predicts_the_rows_of_its_own_fold_only_by_others(spark, monkeypatch):
    rows = [(float(i % 10), float(i % 10 + 100 * (i // 20)), i // 20) for i in range(60)]
    data = binned(spark.createDataFrame(rows, "a double, y double, fold int"), ["a"], "y", "fold")
    wanted = [("m", Settings(trees=1, bootstrap=False), i, [0.0]) for i in (0, 1, 2, 3)]
    for limit in (1 << 25, 0):
        monkeypatch.setattr(forest.boosting, "SENT", limit)
        found = {r.fold: r.gaps / r.n for r in forest.deep_errors(data, wanted, {}).collect()}
        assert found == pytest.approx({0: 150.0, 1: 0.0, 2: 150.0})


def test_a_comparison_measures_deep_forests_without_a_pipeline_a_fold(spark, monkeypatch):
    rows = [(float(i % 12), float(i % 7), float(i % 12 + (i * 7919 % 11) / 11), i % 8) for i in range(160)]
    df = spark.createDataFrame(rows, "a double, b double, y double, g int")
    models = {n: b for n, b in training.build_models(["a", "b"], "y").items() if n in (training.BASELINE, training.FOREST)}

    def no_fit(self, rows):
        raise AssertionError("a pipeline of its own for a fold")

    with monkeypatch.context() as m:
        m.setattr(training.Pipeline, "fit", no_fit)
        found = {r.model: r.RMSE_mean for r in training.grouped_cv(models, df, "g", "y", 4, {training.FOREST: {"n_estimators": 6}}, ["a", "b"]).collect()}
    assert found[training.FOREST] < 0.4 * found[training.BASELINE]
    grid = {"n_estimators": [3, 6], "max_depth": [1, None]}
    search = training.random_search(models[training.FOREST], grid, df, "g", "y", n=4, k=4, features=["a", "b"])
    errors = {(p["n_estimators"], p["max_depth"]): e for p, e in search.tried}
    assert errors[6, None] == pytest.approx(found[training.FOREST])
    assert errors[6, None] < errors[6, 1] and search.best_params["max_depth"] is None
