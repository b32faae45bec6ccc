from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.functions import colour
from arealis.functions import values as v
from arealis.operators import aggregates, quantiles, ranking
from arealis.operators import tables as tb
from workload import layers


def test_shannon(spark):
    rows = [("one", "oak")] * 5 + [("two", s) for s in ("oak", "oak", "elm", "elm")] + [("none", None)]
    df = spark.createDataFrame(rows, "area string, species string")
    found = {r.area: r.diversity for r in aggregates.shannon_diversity(df, "area", "species").collect()}
    assert found["one"] == 0.0
    assert found["two"] == pytest.approx(math.log(2))
    assert found["none"] is None


def test_rollup_weighs_by_area_and_drops_orphans(spark):
    pred = spark.createDataFrame([("a", 30.0), ("b", 10.0), ("x", 99.0)], "fine string, p double")
    weights = spark.createDataFrame([("a", "P", 10.0), ("b", "P", 90.0)], "fine string, parent string, area double")
    rows = aggregates.rollup_weighted(pred, weights, "fine", "parent", "p").collect()
    assert [(r.parent, r.p) for r in rows] == [("P", 12.0)]


def test_normalise_multivalue(spark):
    cases = {
        "['residential' 'service']": "residential;service",
        "[\"it's\", 'b']": "it's;b",
        "[plain]": "[plain]",
        "primary": "primary",
        "[]": "[]",
        None: None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    rows = df.select("t", v.normalise_multivalue(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases


def test_lookup_first_and_midpoint(spark):
    df = spark.createDataFrame([("motorway;service",), ("footpath",), (None,)], "h string")
    width = v.lookup_first(F.col("h"), v.ROAD_WIDTH_M, v.DEFAULT_ROAD_WIDTH_M)
    assert [r[0] for r in df.select(width).collect()] == [14.0, 6.0, 6.0]
    life = spark.createDataFrame([("> 41 years",), ("Not Assessed",), ("soon",), (None,)], "l string")
    assert [r[0] for r in life.select(v.ordinal_midpoint(F.col("l"))).collect()] == [45.0, None, None, None]


def test_to_number_and_clamp(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("n/a",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(v.to_number(F.col("t"))).collect()] == [12.5, None, None, None]
    nums = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in nums.select(v.clamp(F.col("x"), 0, 1)).collect()] == [0.0, 1.0, None]


def test_null_implausible_keeps_rows_and_counts(spark):
    from pyspark.sql import Observation

    seen = Observation("dbh")
    df = spark.createDataFrame([(20.0,), (26027.0,), (300.0,), (None,)], "d double")
    assert [r.d for r in tb.null_implausible(df, "d", 300, seen).collect()] == [20.0, None, 300.0, None]
    assert seen.get["nulled"] == 1


def test_exclude_value_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in tb.exclude_value(df, "x", "a").collect()] == ["b", None]


def test_merge_tiles_first_wins(spark):
    a = spark.createDataFrame([(1, "a"), (2, "a")], "id int, tag string")
    b = spark.createDataFrame([(2, "b", 5), (3, "b", 6)], "id int, tag string, more int")
    rows = {r.id: (r.tag, r.more) for r in tb.merge_tiles([a, b], "id").collect()}
    assert rows == {1: ("a", None), 2: ("a", None), 3: ("b", 6)}


@pytest.fixture
def narrow(monkeypatch):
    """Force the counting path of the quantiles on small data."""
    monkeypatch.setattr(quantiles, "_DIRECT_CELLS", 0)
    monkeypatch.setattr(quantiles, "_DIRECT_ROWS", 40)


def test_quantiles_by_counting_equal_numpy(spark, narrow):
    rng = random.Random(1)
    rows = [
        (rng.gauss(0, 1), 7.0 if rng.random() < 0.6 else float(rng.randint(0, 20)), None if i % 3 else float(i), 1.5)
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, ["a", "b", "c", "d", "e"], shares)
    for i, c in enumerate("abcd"):
        column = [r[i] for r in rows if r[i] is not None]
        assert found[c] == pytest.approx(list(np.quantile(column, shares)), abs=1e-12)
    assert found["e"] == [None] * 5


@pytest.mark.parametrize("accuracy", [20])
def test_quantiles_survive_a_poor_sketch(spark, narrow, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "_DIRECT_ROWS", 20)
    rng = random.Random(2)
    values = [rng.choice([5.0, rng.gauss(0, 100), 1e12 * rng.random(), -3.25]) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    shares = [0.01, 0.49, 0.5, 0.75]
    assert quantiles.exact_quantiles(df, ["x"], shares)["x"] == pytest.approx(list(np.quantile(values, shares)))


def test_quantiles_when_one_value_fills_the_table(spark, narrow):
    df = spark.range(5000).select(F.when(F.col("id") % 500 == 0, F.col("id")).otherwise(42).cast("double").alias("x"))
    want = np.quantile([float(i) if i % 500 == 0 else 42.0 for i in range(5000)], [0.0005, 0.5, 0.9999])
    assert quantiles.exact_quantiles(df, ["x"], [0.0005, 0.5, 0.9999])["x"] == pytest.approx(list(want))


def test_average_rank_equals_pandas(spark):
    import pandas as pd

    # One value holds a third of the rows.
    pdf = pd.DataFrame({"k": range(500), "x": [7.0 if i % 3 == 0 else float((i * 37) % 90) for i in range(500)]})
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([(500, None)], "k long, x double"))
    ranked = quantiles.average_rank(df, "x")
    found = ranked.toPandas().sort_values("k")
    assert list(found["rank"][:500]) == list(pdf["x"].rank(ascending=False).astype(int))
    assert len(found) == 501
    assert pd.isna(found["rank"].iloc[500])


def test_average_rank_scans_its_input_twice(spark, tmp_path, capsys):
    path = str(tmp_path / "in")
    spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x")).write.parquet(path)
    quantiles.average_rank(spark.read.parquet(path), "x").explain()
    # the other scan was that of the counts, which are a table of their own
    assert capsys.readouterr().out.count(str(tmp_path)) <= 1


@pytest.mark.parametrize("limit", [0, 10**9])
def test_quantiles_are_the_same_on_both_paths(spark, monkeypatch, limit):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(0, 1e3),) for _ in range(997)], "x double")
    shares = [i / 61 for i in range(62)]
    want = list(df.agg(F.percentile("x", F.array(*map(F.lit, shares)))).first()[0])
    monkeypatch.setattr(quantiles, "_DIRECT_CELLS", limit)
    assert quantiles.exact_quantiles(df, ["x"], shares)["x"] == want


def test_dissolve_has_one_grain_and_no_inner_edges(spark):
    from tests.shapes import box, layer

    df = layer(spark, [(("big" if i < 50 else "small"), float(i), box(i, 0, i + 1, 1)) for i in range(53)], "k string, x double")
    rows = aggregates.dissolve(df, "k", "x").collect()
    area = lambda k: sum(r.times * (r.x0 * r.y1 - r.x1 * r.y0) for r in rows if r.k == k) / 2
    assert (area("big"), area("small")) == (50.0, 3.0)
    assert {r.x for r in rows if r.k == "big"} == {24.5}
    assert len([r for r in rows if r.k == "big"]) == 102 and all(r.times == 1 for r in rows)


def test_merge_keeps_one_double_of_a_tile_by_content(spark):
    rows = [(1, "b"), (1, "a"), (2, "c")]
    found = {tuple(tb.merge_tiles([spark.createDataFrame(rows[:n] + rows[n:], "k int, v string").repartition(p)], "k").collect()) for n, p in ((0, 1), (1, 3), (2, 2))}
    assert len({frozenset(x) for x in found}) == 1


def test_lines_and_points_are_clipped(spark):
    from arealis.functions import geometry as g
    from tests.shapes import layer

    df = layer(spark, [("a", [[(-5, 5), (15, 5)]]), ("b", [[(2, 2), (2, 20), (30, 20)]]), ("c", [[(-1, -1), (-1, 30)]])], kind="LineString")
    found = {r.id: r.n for r in tb.clip_to_box(df, (0, 0, 10, 10)).select("id", g.length("geom").alias("n")).collect()}
    assert found == {"a": 10.0, "b": 8.0}


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 5.0), (4.0, None, 2.0)], "a double, b double, c double")
    found = {(r.column_a, r.column_b): r.r for r in aggregates.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert found["a", "b"] == pytest.approx(1.0)
    assert found["a", "c"] == pytest.approx(np.corrcoef([2, 3, 4], [1, 5, 2])[0, 1])


def test_correlation_of_constant_and_missing_columns(spark):
    nan = float("nan")
    rows = [(1.0, 7.1, nan, 1.0), (2.0, 7.1, 4.0, nan), (4.0, 7.1, nan, nan), (3.0, 7.1, 6.0, None)]
    df = spark.createDataFrame(rows, "a double, level double, gap double, once double")
    found = {(r.column_a, r.column_b): r.r for r in aggregates.correlation_matrix(df, ["a", "level", "gap", "once"]).collect()}
    assert len(found) == 16
    assert found.pop(("a", "a")) == found.pop(("gap", "gap")) == 1.0
    assert found.pop(("a", "gap")) == found.pop(("gap", "a")) == pytest.approx(1.0)
    assert set(found.values()) == {None}
    assert {r.r for r in aggregates.target_correlations(df, ["level", "once"], "a").collect()} == {None}
    assert {r.r for r in aggregates.correlation_matrix(df.limit(0), ["a", "gap"]).collect()} == {None}


def test_trend_and_histogram(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2 + 1).cast("double").alias("y"))
    line = aggregates.linear_trend(df, "x", "y", 3).collect()
    assert [(r.x, round(r.y, 9)) for r in line] == [(0.0, 1.0), (5.0, 11.0), (10.0, 21.0)]
    bins = {r.bin: (r.n, r.median) for r in aggregates.histogram(df, "x", 5).collect()}
    assert bins == {0: (2, 5.0), 1: (2, 5.0), 2: (2, 5.0), 3: (2, 5.0), 4: (3, 5.0)}


def test_sample_is_repeatable_and_whole(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    first = [r.k for r in ranking.sample_rows(df, 30, 1, "k").collect()]
    again = [r.k for r in ranking.sample_rows(df.repartition(7), 30, 1, "k").collect()]
    assert first == again
    assert len(set(first)) == 30
    assert ranking.sample_rows(df, 5000, 1, "k").count() == 1000


def test_ramp_ends_and_middle(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (7.0,), (None,)], "t double")
    found = [r[0] for r in df.select(colour.ramp_hex(F.col("t"), colour.HEAT_RAMP)).collect()]
    assert found == ["#ffd28a", "#ff8a4c", "#e8483a", "#e8483a", None]


def test_a_long_table_is_dealt_out_over_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(layers, "TASK_ROWS", 500)
    sf = "/root/testdata/sf0.001"
    rows = layers.table(spark, sf, "lineitem", spread=True)
    each = [r[0] for r in rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
    assert sum(each) == layers.table(spark, sf, "lineitem").count() and max(each) <= 510


@pytest.mark.parametrize(("cells", "direct"), [(4_000_000, 200_000), (0, 200_000), (0, 2)])
def test_medians_without_each_part(spark, monkeypatch, cells, direct):
    monkeypatch.setattr(quantiles, "_DIRECT_CELLS", cells)
    monkeypatch.setattr(quantiles, "_DIRECT_ROWS", direct)
    draw = random.Random(3)
    # part 2 lies elsewhere, b takes four values, c has nulls and NaN, d is empty
    rows = [(i % 3, draw.gauss(0, 1) + 5 * (i % 3 == 2), float(draw.randrange(4)), draw.choice([None, float("nan"), draw.random()]), None) for i in range(3001)]
    df = spark.createDataFrame(rows, "part int, a double, b double, c double, d double").persist()
    got = quantiles.medians_without(df, ["a", "b", "c", "d"], "part", 4)
    for i in range(4):
        for j, c in enumerate("abcd", 1):
            known = [r[j] for r in rows if r[0] != i and r[j] is not None and r[j] == r[j]]
            assert got[i][c] == (pytest.approx(float(np.median(known)), abs=1e-15) if known else None)
