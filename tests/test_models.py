from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from arealis.plans import attribution, estimators, scoring, training
from arealis.plans.features import FEATURE_COLUMNS

X = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(10, 3, (80, 3))
    y = 20 - 0.15 * x[:, 0] + rng.normal(0, 0.1, 80)
    rows = [(f"r{i}", f"g{i // 10}", *(float(v) for v in x[i]), float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, grp string, x0 double, x1 double, x2 double, y double")
    return df.withColumn("x2", F.when(F.col("k") != "r3", F.col("x2"))).persist()


def test_split_keeps_groups_whole(table):
    train, test = training.group_split(table, "grp", 0.25)
    a, b = ({r.grp for r in df.select("grp").distinct().collect()} for df in (train, test))
    assert not a & b
    assert (len(a), len(b)) == (6, 2)
    assert train.count() + test.count() == 80


def test_groups_are_dealt_like_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(300):
        k = int(rng.integers(1, 7))
        groups = sorted((int(x) for x in rng.choice([1, 1, 1, 2, 3, 7, 40, 500], rng.integers(1, 60))), reverse=True)
        loads, want = [0] * k, []
        for n in groups:
            i = loads.index(min(loads))
            loads[i] += n
            want.append(i)
        classes = [(n, len(list(x))) for n, x in itertools.groupby(groups)]
        got = [turn[i % len(turn)] for _, a, b, turn in training.deal(classes, k) for i in range(b - a)]
        assert got == want


def test_rows_without_a_group_stay(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"g{i % 5}") for i in range(100)], "k int, grp string")
    found = training.group_folds(df, "grp", 3)
    assert found.count() == 100 and found.where("grp is null").select("fold").distinct().count() == 1
    train, test = training.group_split(df, "grp", 0.2)
    assert train.count() + test.count() == 100 and test.select("grp").distinct().count() == 1


def test_folds_keep_groups_whole_and_even(table):
    folds = training.group_folds(table, "grp", 4).groupBy("fold").agg(F.count("k").alias("n"), F.collect_set("grp").alias("g")).collect()
    assert sorted(r.n for r in folds) == [20, 20, 20, 20]
    assert len(set(itertools.chain(*(r.g for r in folds)))) == 8


def test_imputer_uses_exact_training_median(table):
    known = [r.x2 for r in table.collect() if r.x2 is not None]
    filled = estimators.MedianImputer(X).fit(table).transform(table).where("k = 'r3'").first()
    assert filled["x2__filled"] == float(np.median(known))


def test_standardiser_uses_population_deviation(table):
    row = training.build_models(X, "y")[training.RIDGE]({}).fit(table).transform(table).agg(F.avg("x0__scaled"), F.stddev_pop("x0__scaled")).first()
    assert row[0] == pytest.approx(0, abs=1e-12)
    assert row[1] == pytest.approx(1)


def test_ridge_equals_closed_form(table):
    model = training.build_models(X, "y")[training.RIDGE]({"alpha": 3.0}).fit(table)
    rows = model.transform(table).collect()
    z = np.array([[r[c + "__scaled"] for c in X] for r in rows])
    y = np.array([r.y for r in rows])
    coef = np.linalg.solve(z.T @ z + 3.0 * np.eye(3), z.T @ (y - y.mean()))
    assert [r.prediction for r in rows] == pytest.approx(list(y.mean() + z @ coef), abs=1e-7)


def test_real_models_beat_the_mean(table):
    quick = {n: b for n, b in training.build_models(X, "y").items() if n in (training.BASELINE, training.RIDGE, training.FOREST)}
    summary = training.grouped_cv(quick, table, "grp", "y", 3, {training.FOREST: {"n_estimators": 10, "max_depth": 4}}, X).collect()
    rmse = {r.model: r.RMSE_mean for r in summary}
    assert min(rmse, key=rmse.get) == summary[0].model != training.BASELINE
    assert rmse[training.RIDGE] < rmse[training.BASELINE]


def test_whole_run_and_artifacts(spark, table, tmp_path):
    quick = {n: b for n, b in training.build_models(X, "y").items() if n in (training.BASELINE, training.RIDGE)}
    result = training.train_level("fine", table, "grp", X, "y", n=3, k=3, models=quick)
    assert (result.n_rows, result.n_groups, result.best_name) == (80, 8, training.RIDGE)
    comparison = training.compare_levels(spark, [result])
    root = training.save_artifacts(spark, result, comparison, str(tmp_path / "models"))
    loaded = PipelineModel.load(f"{root}/best_model")
    again = loaded.transform(table).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(result.final_model.transform(table).agg(F.sum("prediction")).first()[0])
    with pytest.raises(TypeError, match="no importances"):
        training.feature_importance(quick[training.BASELINE]({}).fit(table), X, spark)


@pytest.mark.parametrize("name", [training.FOREST, training.BOOSTED_LEVEL])
def test_importances_sum_to_one_and_follow_the_rule(spark, table, name):
    model = training.build_models(X, "y")[name]({"n_estimators": 5, "max_depth": 4}).fit(table)
    found = {r.feature: r.importance for r in training.feature_importance(model, X, spark).collect()}
    assert sum(found.values()) == pytest.approx(1) and max(found, key=found.get) == "x0"
    if name == training.FOREST:
        own = dict(zip(X, model.stages[-1].featureImportances.toArray(), strict=True))
        assert found == pytest.approx(own)


def brute_shap(nodes, weights, row):
    """Shapley values from every subset of features, walking the trees."""

    def expect(tree, node, known):
        n = tree.loc[node]
        if n.leftChild < 0:
            return n.prediction
        if int(n.feature) in known:
            return expect(tree, n.leftChild if row[int(n.feature)] <= n.threshold else n.rightChild, known)
        a, b = tree.loc[n.leftChild].cover, tree.loc[n.rightChild].cover
        return (a * expect(tree, n.leftChild, known) + b * expect(tree, n.rightChild, known)) / (a + b)

    trees = [(weights[int(t)], rows.set_index("id")) for t, rows in nodes.groupby("treeID")]
    m = len(row)
    value = {
        s: sum(w * expect(t, 0, set(s)) for w, t in trees)
        for k in range(m + 1)
        for s in itertools.combinations(range(m), k)
    }
    out = []
    for i in range(m):
        others = [j for j in range(m) if j != i]
        total = 0.0
        for k in range(m):
            for s in itertools.combinations(others, k):
                weight = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                total += weight * (value[tuple(sorted((*s, i)))] - value[s])
        out.append(total)
    return value[()], out


@pytest.mark.parametrize("name", [training.FOREST, training.BOOSTED_LEVEL])
def test_shap_equals_brute_force_and_rebuilds(spark, table, name):
    model = training.build_models(X, "y")[name]({"n_estimators": 4, "max_depth": 4}).fit(table)
    shap = attribution.tree_shap(model, table, "k", X, tasks=2)
    predicted = model.transform(table).select("k", "prediction")
    check = attribution.shap_check(shap, predicted, "k", "prediction").first()
    assert check.rows_checked == 80
    assert check.largest_gap < 1e-9
    nodes = attribution.tree_table(model, spark).toPandas()
    last = model.stages[-1]
    weights = list(last.treeWeights) if name != training.FOREST else [1 / 4] * 4
    for key in ("r0", "r3", "r41"):
        rows = {r.feature: r for r in shap.where(F.col("k") == key).collect()}
        base, want = brute_shap(nodes, weights, [rows[c].value for c in X])
        assert rows["x0"].base_value == pytest.approx(base)
        assert [rows[c].shap for c in X] == pytest.approx(want, abs=1e-10)


def test_waterfall_ends_at_the_prediction(spark, table):
    model = training.build_models(X, "y")[training.FOREST]({"n_estimators": 3, "max_depth": 3}).fit(table)
    shap = attribution.tree_shap(model, table, "k", X)
    last = attribution.shap_waterfall(shap, "k").where("step = 3")
    both = last.join(model.transform(table).select("k", "prediction"), "k")
    assert both.agg(F.max(F.abs(F.col("running_total") - F.col("prediction")))).first()[0] < 1e-9


@pytest.fixture(scope="module")
def areas(spark):
    rows = [("a", 10.0, 30.0, 0.5, 0.1), ("b", 90.0, 20.0, 0.05, 0.95), ("c", None, 20.0, 0.5, 0.1)]
    df = spark.createDataFrame(
        rows,
        "code string, tree_cover_pct_state double, vegetation_cover_pct_state double,"
        " impervious_ratio double, park_coverage_ratio double",
    )
    return df.withColumns({c: F.lit(1.0) for c in FEATURE_COLUMNS if c not in df.columns})


COOLING = "SELECT *, 20D - coalesce(tree_cover_pct_state, 0D) / 10 AS prediction FROM __THIS__"


def test_scenarios_on_a_cooling_model(areas):
    model = PipelineModel(stages=[SQLTransformer(statement=COOLING)])
    scenarios = [scoring.Scenario("none"), scoring.Scenario("trees", extra_tree=30)]
    rows = {(r.code, r.scenario): r for r in scoring.what_if(model, areas, scenarios, ["code"]).collect()}
    assert set(c for c, _ in rows) == {"a", "b"}
    assert all(rows[c, "none"].delta == 0 for c in "ab")
    assert rows["a", "trees"].delta == -3.0
    assert rows["b", "trees"].delta == -1.0
    assert scoring.snapshot(model, areas, ["code"]).count() == 3
    assert scoring.snapshot(model, areas.where("code = 'nowhere'"), ["code"]).count() == 0


def test_scenario_order_of_changes(areas):
    changed = scoring.adjusted(scoring.with_scenarios(areas, [scoring.Scenario("s", 30, 5, 20)]))
    rows = {r.code: r for r in changed.collect()}
    a, b = rows["a"], rows["b"]
    assert (a.tree_cover_pct_state, a.vegetation_cover_pct_state) == (40.0, 40.0)
    assert (b.tree_cover_pct_state, b.vegetation_cover_pct_state) == (100.0, 100.0)
    assert (round(a.impervious_ratio, 12), round(a.park_coverage_ratio, 12)) == (0.3, 0.3)
    assert (b.impervious_ratio, b.park_coverage_ratio) == (0.0, 1.0)


def test_draws_are_distinct_points_of_the_grid():
    drawn = training.draw_params(training.RIDGE_GRID, 30, 1)
    assert sorted(p["alpha"] for p in drawn) == training.RIDGE_GRID["alpha"]
    many = training.draw_params(training.FOREST_GRID, 30, 1)
    assert len({str(p) for p in many}) == 30


def test_search_of_ridge_fits_all_draws_from_the_same_sums(table, monkeypatch):
    k, points = 3, [0.1, 3.0, 100.0]
    folded = training.group_folds(table, "grp", k).persist()
    build = training.build_models(X, "y")[training.RIDGE]
    imputers = training.fold_imputers(folded, X, k)
    wanted = {}
    for a in points:
        held = training._out_of_fold("m", build, {"alpha": a}, folded, "y", imputers)
        wanted[a] = training.summarise_folds(held[0].unionByName(held[1]).unionByName(held[2])).first()["RMSE_mean"]
    fits, own = [], estimators.Ridge._fit
    monkeypatch.setattr(estimators.Ridge, "_fit", lambda self, df: fits.append(1) or own(self, df))
    found = training.random_search(build, {"alpha": points}, table, "grp", "y", n=9, k=k, features=X)
    assert {p["alpha"]: e for p, e in found.tried} == pytest.approx(wanted, abs=1e-9)
    assert len(fits) == 1  # the best, of all rows


def test_comparison_shares_its_passes(spark, table, monkeypatch):
    models = training.build_models(X, "y")
    own = {training.FOREST: {"n_estimators": 10, "max_depth": 4}, training.BOOSTED_LEVEL: {"n_estimators": 3, "max_depth": 2}, training.BOOSTED_LEAF: {"n_estimators": 3, "min_child_samples": 5}}
    k = 3
    folded = training.group_folds(table, "grp", k).persist()
    imputers = training.fold_imputers(folded, X, k)
    wanted = {}
    for name in (training.BASELINE, training.RIDGE):
        held = training._out_of_fold(name, models[name], {}, folded, "y", imputers)
        wanted[name] = training.summarise_folds(held[0].unionByName(held[1]).unionByName(held[2])).first()
    for name in (training.BOOSTED_LEVEL, training.BOOSTED_LEAF):
        fills = training.fold_fills(imputers, X)
        settings = [training.replace(models[name].settings(own[name]), held=i, fill=fills[i]) for i in range(k)]
        _, blocks = training.boosting.fit_many(training.boosting.binned(folded, X, "y", "fold"), settings)
        with training.boosting.few_blocks(spark):
            wanted[name] = training.summarise_folds(training.boosting.out_of_fold(blocks, settings, [name] * k, len(X))).first()

    def no_fit(self, rows):
        raise AssertionError("a pipeline of its own for a fold")

    monkeypatch.setattr(training.Pipeline, "fit", no_fit)
    found = {r.model: r for r in training.grouped_cv(models, table, "grp", "y", k, own, X).collect()}
    for name, w in wanted.items():
        for c in w.asDict().keys() - {"model"}:
            assert found[name][c] == pytest.approx(w[c], rel=1e-9, abs=1e-12), (name, c)
    assert found[training.FOREST].RMSE_mean < found[training.BASELINE].RMSE_mean


def test_a_level_deals_its_folds_once(table, monkeypatch):
    quick = {n: b for n, b in training.build_models(X, "y").items() if n in (training.BASELINE, training.RIDGE)}
    dealt, deal, medians, narrow = [], training.group_folds, [], training.medians_without
    monkeypatch.setattr(training, "group_folds", lambda *a: dealt.append(1) or deal(*a))
    monkeypatch.setattr(training, "medians_without", lambda *a: medians.append(1) or narrow(*a))
    result = training.train_level("fine", table, "grp", X, "y", n=3, k=3, models=quick)
    assert (len(dealt), len(medians), result.best_name) == (1, 1, training.RIDGE)


def test_a_search_refits_with_medians_it_knows(table, monkeypatch):
    quick = {n: b for n, b in training.build_models(X, "y").items() if n in (training.BASELINE, training.RIDGE)}
    found, own = [], estimators.MedianImputer.medians
    monkeypatch.setattr(estimators.MedianImputer, "medians", lambda self, df: found.append(own(self, df)) or found[-1])
    result = training.train_level("fine", table, "grp", X, "y", n=3, k=3, models=quick)
    assert len(found) == 1  # of all rows, for the final model
    train, _ = training.group_split(table, "grp")
    again = training.build_models(X, "y")[training.RIDGE](result.best_params).fit(train)
    assert result.test_model.stages[0].medians == again.stages[0].medians
    assert list(result.test_model.stages[-1].coefficients) == list(again.stages[-1].coefficients)


def test_passes_read_blocks_from_memory_and_free_them(table, monkeypatch):
    seen, own = [], training.boosting._sums
    monkeypatch.setattr(training.boosting, "_sums", lambda blocks, *a: seen.append((blocks, blocks.storageLevel.useMemory)) or own(blocks, *a))
    models = {n: training.build_models(X, "y")[n] for n in (training.FOREST, training.BOOSTED_LEVEL)}
    # so many rounds that predictions are written down in between
    small = {training.FOREST: {"n_estimators": 2, "max_depth": 2}, training.BOOSTED_LEVEL: {"n_estimators": 12, "max_depth": 1}}
    training.grouped_cv(models, table, "grp", "y", 2, small, X).collect()
    training.random_search(models[training.FOREST], {"n_estimators": [2], "max_depth": [2]}, table, "grp", "y", n=1, k=2, features=X)
    assert len(seen) == 2 + 12 + 2 and all(used for _, used in seen)
    assert not any(blocks.storageLevel.useMemory for blocks, _ in seen)


def test_sums_are_the_same_added_by_tasks_or_by_the_driver(table, monkeypatch):
    data = training.boosting.binned(table.repartition(3).withColumn("fold", F.pmod(F.hash("grp"), F.lit(2))), X, "y", "fold")
    settings = [training.boosting.Settings(rounds=3, depth=3, held=i) for i in range(2)]
    direct = [m.trees for m in training.boosting.fit_many(data, settings)[0]]
    monkeypatch.setattr(training.boosting, "DIRECT", 0)
    assert [m.trees for m in training.boosting.fit_many(data, settings)[0]] == direct


def test_rows_of_few_groups_are_not_shuffled_by_group(spark, table, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (*training.group_split(table, "grp"), training.group_folds(table, "grp", 3)):
            assert df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
        dealt = {r.k: r.fold for r in training.group_folds(table, "grp", 3).collect()}
        monkeypatch.setattr(training, "SENT_GROUPS", 0)
        assert {r.k: r.fold for r in training.group_folds(table, "grp", 3).collect()} == dealt
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_grown_together_or_alone_a_forest_is_the_same(spark, table):
    rows = table.withColumn("fold", F.hash("grp") % 3)
    data = training.boosting.binned(rows.withColumn("fold", F.pmod("fold", F.lit(3))), X, "y", "fold")
    s = training.forest.Settings(trees=4, depth=3, min_leaf=2, features=0.5)
    fills = [0.5, 0.5, 0.5]
    together = training.forest.fit_folds(data, [("m", s, i, fills) for i in range(3)])
    for i in range(3):
        (alone,) = training.forest.fit_folds(data, [("m", s, i, fills)])
        assert alone.trees == together[i].trees and alone.base == together[i].base
    assert all(min(n for n, f in zip(t.count, t.feature, strict=True) if f < 0) >= 2 for f in together for t in f.trees)
    # a tree of all rows and features is the best tree
    (whole,) = training.forest.fit_folds(data, [("m", training.forest.Settings(trees=1, depth=1, bootstrap=False), 5, fills)])
    assert len(whole.trees[0].value) == 3 and whole.trees[0].feature[0] == 0


@pytest.mark.parametrize(("query", "levels"), [("train_level", ["fine"]), ("compare_levels", ["fine", "coarse"])])
def test_whole_runs_are_trained_at_full_settings(spark, monkeypatch, query, levels):
    """Five folds, thirty draws of the full grids, and no smaller model than the product's."""
    import inspect

    import __spark_entry__ as entry

    own, seen = inspect.signature(training.train_level), []

    class Done(Exception):
        pass

    def spy(*args, **kwargs):
        bound = own.bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        if len(seen) == len(levels):
            raise Done

    monkeypatch.setattr(training, "train_level", spy)
    with pytest.raises(Done):
        entry.queries()[query](spark, "/root/testdata/sf0.001")
    assert [a["level"] for a in seen] == levels
    for a in seen:
        assert (a["n"], a["k"], a["test_share"]) == (30, 5, 0.2) and a["grids"] is training.GRIDS
        assert not a["params"] and a["models"] is None
