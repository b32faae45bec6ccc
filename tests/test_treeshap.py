"""Contributions of trees of any size: against Shapley's formula, in pieces, in blocks, deep and degenerate."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from arealis.plans import attribution, treeshap
from arealis.plans.estimators import FILLED, MedianImputer
from arealis.plans.forest import DeepForest, Settings


def grown(rng, leaves, features, values=8):
    """A random tree of uneven depth as a node table, ids without order or gaps filled."""
    feature, cut, left, right, cover = [-1], [0.0], [-1], [-1], [1000.0]
    while sum(x < 0 for x in left) < leaves:
        ends = [i for i, x in enumerate(left) if x < 0]
        i = ends[int(len(ends) * rng.random() ** 3)] if rng.random() < 0.5 else ends[-1]
        part = rng.uniform(0.1, 0.9)
        feature[i], cut[i] = int(rng.integers(features)), float(rng.integers(values))
        for side, share in ((left, part), (right, 1 - part)):
            side[i] = len(left)
            feature.append(-1)
            cut.append(0.0)
            cover.append(cover[i] * share)
            left.append(-1)
            right.append(-1) if side is left else None
        right.append(-1)
    n = len(left)
    own = np.append(0, rng.permutation(np.arange(1, n)) * 3)
    number = lambda c: [own[j] if j >= 0 else -1 for j in c]
    return pd.DataFrame({"treeID": 0, "id": own, "leftChild": number(left), "rightChild": number(right[:n]), "feature": feature, "threshold": cut, "cover": cover, "prediction": rng.normal(size=n)})


def expected(tree, row, known, i=0):
    n = tree.loc[i]
    if n.leftChild < 0:
        return n.prediction
    a, b = int(n.leftChild), int(n.rightChild)
    if int(n.feature) in known:
        return expected(tree, row, known, a if row[int(n.feature)] <= n.threshold else b)
    p = tree.loc[a].cover / (tree.loc[a].cover + tree.loc[b].cover)
    return p * expected(tree, row, known, a) + (1 - p) * expected(tree, row, known, b)


def shapley(tree, row):
    m, value = len(row), {}
    for k in range(m + 1):
        for s in itertools.combinations(range(m), k):
            value[frozenset(s)] = expected(tree, row, s)
    return [
        sum(
            math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (value[s | {i}] - value[s])
            for s in value
            if i not in s
        )
        for i in range(m)
    ]


def both(nodes, x, leaves):
    out, base = np.zeros_like(x), 0.0
    for part, piece in treeshap.pieces_of(nodes, 1.0, x.shape[1], leaves):
        base += part
        treeshap.shap_of_piece(x, piece, out)
    return base, out


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_formula_whole_and_in_pieces(seed):
    rng = np.random.default_rng(seed)
    nodes = grown(rng, 25, 4)
    x = rng.integers(-1, 9, size=(6, 4)).astype(float)
    x[0, 1] = np.nan
    tree = nodes.set_index("id")
    want = [shapley(tree, row) for row in x]
    base, whole = both(nodes, x, 1000)
    assert base == pytest.approx(expected(tree, x[0], ()))
    np.testing.assert_allclose(whole, want, atol=1e-9)
    for leaves in (1, 3, 10):
        part_base, parts = both(nodes, x, leaves)
        assert part_base == pytest.approx(base)
        np.testing.assert_allclose(parts, want, atol=1e-9)


def test_long_paths_over_many_features_rebuild_the_prediction():
    rng = np.random.default_rng(9)
    nodes = grown(rng, 600, 40, 50)
    x = rng.uniform(-1, 51, size=(50, 40))
    tree = nodes.set_index("id")
    for leaves in (10_000, 64):
        base, found = both(nodes, x, leaves)
        want = [expected(tree, row, range(40)) for row in x]
        np.testing.assert_allclose(base + found.sum(1), want, atol=1e-8)


def test_small_steps_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    nodes, x = grown(rng, 30, 5), rng.uniform(0, 8, size=(40, 5))
    whole = both(nodes, x, 1000)[1]
    monkeypatch.setattr(treeshap, "_CELLS", 1)
    np.testing.assert_allclose(both(nodes, x, 1000)[1], whole, atol=1e-12)


def test_a_single_leaf_and_infinite_cuts():
    leaf = pd.DataFrame({"treeID": [0], "id": [0], "leftChild": [-1], "rightChild": [-1], "feature": [-1], "threshold": [0.0], "cover": [5.0], "prediction": [2.5]})
    base, found = both(leaf, np.ones((2, 3)), 10)
    assert base == 2.5 and not found.any()
    # only a missing value goes right of infinity
    split = pd.DataFrame({"treeID": 0, "id": [0, 1, 2], "leftChild": [1, -1, -1], "rightChild": [2, -1, -1], "feature": [0, -1, -1], "threshold": [np.inf, 0, 0], "cover": [4.0, 3, 1], "prediction": [0.0, 1, 9]})
    base, found = both(split, np.array([[np.inf], [-np.inf], [np.nan]]), 10)
    assert base == 3.0
    np.testing.assert_allclose(found[:, 0], [-2, -2, 6])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, size=(400, 3)).astype(float)
    y = x[:, 0] * 2 - (x[:, 1] - 9) ** 2 + rng.normal(size=400)
    rows = [(f"k{i}", *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    rows[7] = ("k7", None, *rows[7][2:])
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, y double").repartition(3)
    names = ["a", "b", "c"]
    stages = [MedianImputer(names), VectorAssembler(inputCols=[c + FILLED for c in names], outputCol="features"), DeepForest("y", Settings(trees=6))]
    return df, names, Pipeline(stages=stages).fit(df)


def test_an_unlimited_forest_in_blocks(fitted):
    df, names, model = fitted
    assert max(t.depth for t in model.stages[-1].trees) > 10
    whole = attribution.tree_shap(model, df, "k", names)
    check = attribution.shap_check(whole, model.transform(df), "k", "prediction").first()
    assert (check.rows_checked, check.largest_gap < 1e-8) == (400, True)
    # a block a piece, and pieces of 50 leaves
    parts = attribution.tree_shap(model, df, "k", names, block=1, leaves=50)
    gap = whole.alias("w").join(parts.alias("p"), ["k", "feature"]).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("w.shap") - F.col("p.shap"))).alias("gap")).first()
    assert (gap.n, gap.gap < 1e-9) == (1200, True)
    assert attribution.tree_shap(model, df.where("k = 'none'"), "k", names).count() == 0
