"""Boosted trees against a plain Python grower."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from arealis.plans import boosting, training
from arealis.plans.boosting import Settings


def plain_tree(x, r, s, columns):
    """Splits by exhaustive search: a list of (rows, feature, threshold, missing left, gain), and values by row."""

    def value(rows):
        return r[rows].sum() / (len(rows) + s.l2) if len(rows) + s.l2 else 0.0

    def score(rows):
        return r[rows].sum() ** 2 / (len(rows) + s.l2) if len(rows) + s.l2 else 0.0

    def best(rows, depth):
        found = None
        if s.depth is not None and depth >= s.depth:
            return None
        for f in columns:
            v = np.unique(x[:, f][~np.isnan(x[:, f])])
            for way in (False, True) if np.isnan(x[rows, f]).any() else (False,):
                for low, high in zip(v, v[1:], strict=False):
                    t = low / 2 + high / 2
                    go = np.where(np.isnan(x[rows, f]), way, x[rows, f] <= t)
                    a, b = rows[go], rows[~go]
                    if min(len(a), len(b)) < max(s.min_weight, s.min_rows, 1):
                        continue
                    gain = (score(a) + score(b) - score(rows)) / 2
                    if gain > (found[0] + 1e-9 if found else boosting.LEAST_GAIN):
                        found = (gain, f, t, way, a, b)
        return found

    out, splits, heap, count = np.zeros(len(x)), [], [], 0
    rows = s_rows = np.arange(len(x))
    todo = [(best(rows, 0), rows, 0)]
    leaves = []
    if s.leaves is None:
        while todo:
            found, rows, depth = todo.pop(0)
            if found is None:
                leaves.append(rows)
                continue
            splits.append((len(rows), *found[1:4], round(found[0], 6)))
            todo += [(best(c, depth + 1), c, depth + 1) for c in found[4:]]
    else:
        push = lambda f, rows, d: heapq.heappush(heap, (-(f[0] if f else -1), count_up(), f, rows, d))
        counter = iter(range(10**6))
        count_up = lambda: next(counter)
        push(todo[0][0], s_rows, 0)
        while heap:
            _, _, found, rows, depth = heapq.heappop(heap)
            if found is None or count >= s.leaves - 1:
                leaves.append(rows)
                continue
            count += 1
            splits.append((len(rows), *found[1:4], round(found[0], 6)))
            for c in found[4:]:
                push(best(c, depth + 1), c, depth + 1)
    for rows in leaves:
        out[rows] = value(rows)
    return splits, out


def plain_fit(x, y, s):
    at, splits = np.full(len(y), y.mean()), []
    for _ in range(s.rounds):
        own, out = plain_tree(x, y - at, s, range(x.shape[1]))
        splits.append(sorted(own))
        at = at + s.rate * out
    return splits, at


def splits_of(model):
    out = []
    for t in model.trees:
        inner = [k for k, f in enumerate(t.feature) if f >= 0]
        out.append(sorted((t.count[k], t.feature[k], float(model.edges[t.feature[k]][t.bin[k]]), t.missing_left[k], round(t.gain[k], 6)) for k in inner))
    return out


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 40, 400) / 4, rng.integers(0, 6, 400).astype(float), rng.normal(size=400).round(1), np.full(400, 3.0)])
    x[rng.random(400) < 0.15, 0] = np.nan
    y = np.where(np.isnan(x[:, 0]), 4, np.sin(x[:, 0])) * 3 + x[:, 1] ** 2 / 4 + rng.normal(size=400) / 3
    rows = [(i, *(None if np.isnan(v) and i % 2 else float(v) for v in row), float(t), i % 3) for i, (row, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, d double, y double, fold int").repartition(4, "i")
    return x, y, df


NAMES = ["a", "b", "c", "d"]


@pytest.mark.parametrize(
    "s",
    [
        Settings(rounds=3, leaves=8, depth=None, l2=0.0, min_weight=1e-3, min_rows=20, rate=0.3),
        Settings(rounds=2, leaves=31, depth=None, l2=0.0, min_rows=3),
        Settings(rounds=2, leaves=12, depth=3, l2=1.0),
        Settings(rounds=12, depth=3, rate=0.3),
        Settings(rounds=1, depth=6, l2=5.0, min_weight=12.0),
        Settings(rounds=1, depth=0),
    ],
)
def test_trees_equal_an_exhaustive_search(table, s):
    x, y, df = table
    (model,), _ = boosting.fit_many(boosting.binned(df, NAMES, "y"), [s])
    splits, wanted = plain_fit(x, y, s)
    found = splits_of(model)
    assert [[p[:4] for p in own] for own in found] == [[p[:4] for p in own] for own in splits]
    assert [p[4] for own in found for p in own] == pytest.approx([p[4] for own in splits for p in own], rel=1e-6, abs=1e-6)
    assert model.predict(x) == pytest.approx(wanted, abs=1e-6)
    if s.leaves:
        leaves = [sum(f < 0 for f in t.feature) for t in model.trees]
        assert max(leaves) <= s.leaves and (s.leaves != 31 or max(leaves) == 31)


def test_leaf_growth_gives_leaves_of_unequal_depth(table):
    _, _, df = table
    (model,), _ = boosting.fit_many(boosting.binned(df, NAMES, "y"), [Settings(rounds=1, leaves=31, depth=None, l2=0.0)])
    t, depth = model.trees[0], {0: 0}
    for k, f in enumerate(t.feature):
        if f >= 0:
            depth[t.left[k]] = depth[t.right[k]] = depth[k] + 1
    found = {depth[k] for k, f in enumerate(t.feature) if f < 0}
    assert max(found) - min(found) >= 3 and max(found) > 5


def test_folds_fitted_together_equal_folds_fitted_alone(table):
    x, y, df = table
    base = Settings(rounds=4, depth=3, columns=0.5, rows=0.7, seed=9)
    settings = [boosting.replace(base, held=k) for k in (0, 1, 2)] + [boosting.replace(base, rounds=2), boosting.replace(base, leaves=6, depth=None)]
    data = boosting.binned(df, NAMES, "y", "fold")
    together, blocks = boosting.fit_many(data, settings)
    for s, model in zip(settings, together, strict=True):
        (alone,), _ = boosting.fit_many(data, [s])
        assert splits_of(alone) == splits_of(model) and alone.base == model.base
    fold = np.arange(400) % 3
    wanted = [math.sqrt(np.mean((together[k].predict(x[fold == k]) - y[fold == k]) ** 2)) for k in range(3)]
    assert boosting.held_out_rmse(blocks, settings, 4)[:3] == pytest.approx(wanted)
    held = boosting.out_of_fold(blocks, settings[:3], ["m"] * 3, 4).groupBy("fold").agg(F.count("y"), F.sum("yhat")).collect()
    assert {r[0]: r[1] for r in held} == {k: int((fold == k).sum()) for k in range(3)}


def test_columns_and_rows_are_drawn_for_a_tree(table):
    _, _, df = table
    data = boosting.binned(df, NAMES, "y")
    (model,), _ = boosting.fit_many(data, [Settings(rounds=6, depth=2, columns=0.5, rows=0.4)])
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set(map(frozenset, used))) > 1
    roots = [t.count[0] for t in model.trees]
    assert len(set(roots)) > 1 and all(100 < n < 220 for n in roots)


def test_missing_values_go_the_better_way(spark):
    rows = [(float(i % 4) if i % 5 else None, (10.0 if i % 5 == 0 or i % 4 < 2 else 0.0)) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y double")
    (model,), _ = boosting.fit_many(boosting.binned(df, ["x"], "y"), [Settings(rounds=1, rate=1.0, depth=1, l2=0.0)])
    assert model.trees[0].missing_left == [True, False, False]
    found = boosting.scored(df, model, ["x"]).collect()
    assert all(r["prediction"] == pytest.approx(r["y"]) for r in found)
    with pytest.raises(ValueError):
        boosting.BoostedTrees("y", Settings(rounds=1), "v").fit(VectorAssembler(inputCols=["x"], outputCol="v", handleInvalid="keep").transform(df))


def test_an_mllib_model_says_the_same(spark, table, tmp_path):
    x, y, df = table
    vectors = VectorAssembler(inputCols=["b", "c"], outputCol="features").transform(df)
    s = Settings(rounds=5, leaves=9, depth=None, l2=0.0, rate=0.2)
    (model,), _ = boosting.fit_many(boosting.binned(df, ["b", "c"], "y"), [s])
    fitted = boosting.BoostedTrees("y", s).fit(vectors)
    got = dict(fitted.transform(vectors).select("i", "prediction").collect())
    assert [got[i] for i in range(400)] == pytest.approx(model.predict(x[:, 1:3]))
    total = np.zeros(2)
    for t in model.trees:
        for f, g in zip(t.feature, t.gain, strict=True):
            if f >= 0:
                total[f] += g
    assert fitted.featureImportances.toArray() == pytest.approx(total / total.sum())
    fitted.write().save(f"{tmp_path}/m")
    again = boosting.GBTRegressionModel.load(f"{tmp_path}/m")
    assert dict(again.transform(vectors).select("i", "prediction").collect()) == got


def test_many_values_are_binned_by_quantiles(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=5000)
    df = spark.createDataFrame([(float(v), float(v > 1.0), None) for v in x] + [(math.nan, None, 1.0)], "x double, y double, gap double")
    data = boosting.binned(df, ["x", "gap"], "y")
    assert 200 < len(data.edges[0]) <= 254 and len(data.edges[1]) == 0 and data.folds[0][0] == 5000
    (model,), _ = boosting.fit_many(data, [Settings(rounds=1, depth=1, rate=1.0, l2=0.0)])
    assert abs(np.mean(model.predict(np.column_stack([x, x])) - (x > 1.0))) < 0.01


def test_a_rough_count_leaves_no_value_without_a_bin(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 255))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x.T], [f"c{i}" for i in range(12)])
    for own, edges in zip(x, boosting.bin_edges(df, df.columns), strict=True):
        v = np.sort(own)
        assert list(edges) == pytest.approx((v[:-1] + v[1:]) / 2)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "x double, y double")
    (model,), _ = boosting.fit_many(boosting.binned(df, ["x"], "y"), [Settings(rounds=2)])
    assert model.predict([[1.0], [9.0]]).tolist() == [2.0, 2.0]
    empty = boosting.binned(df.limit(0), ["x"], "y")
    (model,), _ = boosting.fit_many(empty, [Settings(rounds=2)])
    assert model.predict([[1.0]]).tolist() == [0.0]


def test_parameters_mean_what_they_say():
    level = training.boosted_settings({"min_child_weight": 5, "colsample_bytree": 0.7, "subsample": 0.8, "max_depth": 3}, 1, "level")
    assert (level.min_weight, level.columns, level.rows, level.depth, level.leaves, level.l2) == (5.0, 0.7, 0.8, 3, None, 1.0)
    leaf = training.boosted_settings({"subsample": 0.8}, 1, "leaf")
    assert (leaf.leaves, leaf.depth, leaf.min_rows, leaf.rows, leaf.l2) == (31, None, 20, 1.0, 0.0)


def test_search_bins_once_and_fits_folds_together(spark, table, monkeypatch):
    x, y, df = table
    bins, fits = [], []
    binned, fit_many = boosting.binned, boosting.fit_many
    monkeypatch.setattr(boosting, "binned", lambda *a: bins.append(1) or binned(*a))
    monkeypatch.setattr(boosting, "fit_many", lambda d, s: fits.append(len(s)) or fit_many(d, s))
    build = training.build_models(["a", "b"], "y")[training.BOOSTED_LEVEL]
    grid = {"n_estimators": [3, 6], "max_depth": [1, 2]}
    found = training.random_search(build, grid, df.drop("fold").withColumn("g", F.col("i") % 20), "g", "y", n=4, k=4, features=["a", "b"])
    assert fits == [16, 1] and len(bins) == 2  # the search, and the model of all rows
    assert found.best_params == {"n_estimators": 6, "max_depth": 2} and len(found.tried) == 4
    best = found.model.transform(df).select("i", "prediction").collect()
    assert math.sqrt(np.mean([(r[1] - y[r[0]]) ** 2 for r in best])) < 1.05 * found.best_rmse < y.std()


def test_a_task_holds_a_few_blocks(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = spark.range(0, 100, 1, 1)

    def sizes(batches):
        for b in batches:
            yield boosting.pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    with boosting.few_blocks(spark):
        assert max(r.n for r in many.mapInArrow(sizes, "n long").collect()) <= boosting.HELD
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_table_of_a_tree_answers_as_its_walk():
    rng = np.random.default_rng(3)
    for features, nodes in ((2, 41), (40, 61), (3, 301)):
        t = boosting.Tree()
        t.add(0.0, 1)
        while len(t.value) < nodes:
            at = int(rng.choice([i for i, f in enumerate(t.feature) if f < 0]))
            t.feature[at], t.bin[at], t.missing_left[at] = int(rng.integers(features)), int(rng.integers(254)), bool(rng.integers(2))
            t.left[at], t.right[at] = t.add(0.0, 1), t.add(0.0, 1)
        bins = rng.integers(0, 256, (features, 5000)).astype(np.uint8)
        wanted = []
        for column in bins.T:
            node = 0
            while t.feature[node] >= 0:
                x = column[t.feature[node]]
                node = t.left[node] if (t.missing_left[node] if x == boosting.MISSING else x <= t.bin[node]) else t.right[node]
            wanted.append(node)
        assert t.walk(bins).tolist() == wanted == t.finder(np.arange(nodes))(bins).tolist()


def test_many_rounds_in_a_task_grow_the_trees_of_the_passes(spark, table, monkeypatch):
    x, y, df = table
    rows = df.withColumn("fold", F.col("i").cast("int") % 3)
    data = boosting.binned(rows.repartition(3), ["a", "b"], "y", "fold")
    kinds = (Settings(rounds=13, depth=3, rows=0.7, columns=0.5), Settings(rounds=12, leaves=6, depth=None, l2=0.0, min_rows=4), Settings(rounds=11, depth=2))
    settings = [boosting.replace(s, held=i, fill=fill) for s in kinds for i, fill in ((0, (0.5, 0.5)), (1, None), (None, None))]
    def state(blocks):
        with boosting.few_blocks(spark):
            return {r["first"]: np.frombuffer(r["state"]).tolist() for r in blocks.collect()}

    passes, blocks = boosting.fit_many(data, settings)
    before = state(blocks)
    monkeypatch.setattr(boosting, "LONG", 13)
    monkeypatch.setattr(boosting, "ROWS", 50)  # sums of some rows at a time
    monkeypatch.setattr(boosting, "_sums", None)  # no pass is made
    alone, blocks = boosting.fit_many(data, settings)
    assert [m.trees for m in alone] == [m.trees for m in passes] and [len(m.trees) for m in alone] == [13] * 3 + [12] * 3 + [11] * 3
    assert state(blocks) == before
