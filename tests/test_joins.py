from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.operators import aggregates, gridjoin
from arealis.plans import features
from tests.shapes import HOLED, L_SHAPE, box, layer, points

# The same join through every physical path: none may change a result.
PATHS = {
    "broadcast": gridjoin.JoinSettings(),
    "shuffled": gridjoin.JoinSettings(broadcast_bytes=0),
    "salted": gridjoin.JoinSettings(broadcast_bytes=0, hot_rows=3),
    "strips": gridjoin.JoinSettings(max_edges=3),
    "strips, salted": gridjoin.JoinSettings(max_edges=3, broadcast_bytes=0, hot_rows=3),
    "one level at a time": gridjoin.JoinSettings(level_step=1, refine=1),
}


def star(rng: random.Random, x: float, y: float, size: float, n: int) -> list:
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(x + (r := size * rng.uniform(0.3, 1)) * math.cos(t), y + r * math.sin(t)) for t in turns]
    return [ring + ring[:1]]


def ray_inside(ring: list, x: float, y: float) -> bool:
    """Plain even-odd test, on its own terms."""
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def clip_convex(subject: list, clip: list) -> float:
    """Area of a ring cut by a convex counter-clockwise ring, edge by edge."""
    out = subject[:-1]
    for (ax, ay), (bx, by) in zip(clip, clip[1:], strict=False):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        kept = []
        for i, (p, s) in enumerate(zip(out, side, strict=True)):
            q, t = out[(i + 1) % len(out)], side[(i + 1) % len(out)]
            if s >= 0:
                kept.append(p)
            if (s >= 0) != (t >= 0):
                kept.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        out = kept
        if not out:
            return 0.0
    x, y = np.array(out).T
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


@pytest.fixture(scope="module")
def rng_layers(spark):
    rng = random.Random(7)
    stars = {f"s{i}": star(rng, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([1, 5, 40]), rng.randint(5, 30)) for i in range(25)}
    spots = {f"p{i}": (rng.uniform(-10, 110), rng.uniform(-10, 110)) for i in range(150)}
    return stars, spots


@pytest.mark.parametrize("path", PATHS)
def test_within_equals_brute_force(spark, rng_layers, path):
    stars, spots = rng_layers
    expected = {(p, s) for p, xy in spots.items() for s, rings in stars.items() if ray_inside(rings[0], *xy)}
    found = gridjoin.join_within(
        points(spark, [(p, *xy) for p, xy in spots.items()]),
        layer(spark, list(stars.items()), "area string"),
        "area",
        settings=PATHS[path],
    )
    assert {(r.id, r.area) for r in found.collect()} == expected
    assert found.count() == len(expected)


@pytest.mark.parametrize("path", PATHS)
def test_overlay_equals_clipping(spark, rng_layers, path):
    stars, _ = rng_layers
    tiles = {f"t{i}{j}": box(i * 30 - 10, j * 30 - 10, i * 30 + 20, j * 30 + 20) for i in range(4) for j in range(4)}
    tiles["wide"] = box(-50, 40, 150, 45)
    expected = {}
    for s, rings in stars.items():
        for t, tile in tiles.items():
            shared = clip_convex(rings[0], tile[0])
            if shared > 1e-6:
                expected[s, t] = shared
    found = gridjoin.overlay_area(
        layer(spark, list(stars.items())),
        layer(spark, list(tiles.items()), "area string"),
        "area",
        ["id"],
        settings=PATHS[path],
    ).collect()
    assert len(found) == len(expected)
    for r in found:
        assert r.piece_area == pytest.approx(expected[r.id, r.area], rel=1e-7, abs=1e-6)


def test_pieces_of_a_partition_sum_to_the_shape(spark, rng_layers):
    stars, _ = rng_layers
    tiles = [(f"{i}-{j}", box(i * 20 - 60, j * 20 - 60, i * 20 - 40, j * 20 - 40)) for i in range(12) for j in range(12)]
    source = layer(spark, list(stars.items()))
    summed = (
        gridjoin.overlay_area(source, layer(spark, tiles, "area string"), "area", ["id"])
        .groupBy("id")
        .agg(F.sum("piece_area").alias("s"))
        .join(source.select("id", g.area("geom").alias("a")), "id")
    )
    rows = summed.collect()
    assert len(rows) == len(stars)
    assert all(r.s == pytest.approx(r.a, rel=1e-6) for r in rows)


def test_known_overlaps_at_projected_coordinates(spark):
    shift = lambda parts: [[(x + 320704.25, y + 5812911.5) for x, y in r] for r in parts]
    found = gridjoin.overlay_area(
        layer(spark, [("l", shift(L_SHAPE))]), layer(spark, [("h", shift(HOLED))], "area string"), "area", ["id"]
    )
    assert found.first().piece_area == pytest.approx(19.0, abs=1e-8)


def test_touching_squares_share_nothing(spark):
    found = gridjoin.overlay_area(
        layer(spark, [("a", box(0, 0, 1, 1))]), layer(spark, [("b", box(1, 0, 2, 1))], "area string"), "area", ["id"]
    )
    assert found.count() == 0


def test_point_on_shared_border_joins_nothing(spark):
    areas = layer(spark, [("a", box(0, 0, 1, 1)), ("b", box(1, 0, 2, 1))], "area string")
    spots = points(spark, [("on", 1.0, 0.5), ("corner", 0.0, 0.0), ("in", 1.5, 0.5)])
    assert [(r.id, r.area) for r in gridjoin.join_within(spots, areas, "area").collect()] == [("in", "b")]


@pytest.mark.parametrize("path", ["broadcast", "salted", "strips"])
@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ([(0, 1.5), (10, 1.5)], 7.0),
        ([(0, 4), (10, 4)], 3.0),
        ([(4, 0), (4, 10)], 3.0),
        ([(0, 0), (10, 10)], 3 * math.sqrt(2)),
        ([(1, 0), (1, 10)], 7.0),
        ([(8, 0), (8, 10)], 7.0),
        ([(0, 1), (10, 1)], 7.0),
        ([(0, 8), (10, 8)], 7.0),
        ([(2, 3), (2, 5)], 2.0),
        ([(6, 3), (6, 5)], 2.0),
        ([(3, 2), (5, 2)], 2.0),
        ([(3, 6), (5, 6)], 2.0),
    ],
)
def test_line_inside_closed_polygon(spark, line, expected, path):
    found = gridjoin.overlay_length(
        layer(spark, [("r", [line])], kind="LineString"),
        layer(spark, [("h", HOLED)], "area string"),
        "area",
        ["id"],
        settings=PATHS[path],
    )
    assert found.first().clipped_length == pytest.approx(expected)


def test_line_on_a_shared_border_counts_in_both(spark):
    areas = layer(spark, [("a", box(0, 0, 5, 5)), ("b", box(5, 0, 9, 5)), ("c", box(0, 5, 5, 9))], "area string")
    lines = layer(spark, [("up", [[(5, 1), (5, 4)]]), ("along", [[(1, 5), (4, 5)]])], kind="LineString")
    found = gridjoin.overlay_length(lines, areas, "area", ["id"]).collect()
    assert {(r.id, r.area, r.clipped_length) for r in found} == {
        ("up", "a", 3.0),
        ("up", "b", 3.0),
        ("along", "a", 3.0),
        ("along", "c", 3.0),
    }


@pytest.mark.parametrize("path", ["broadcast", "salted"])
def test_nearest_of_any_kind(spark, rng_layers, path):
    _, spots = rng_layers
    rng = random.Random(3)
    boxes = {f"b{i}": (x := rng.uniform(0, 90), y := rng.uniform(0, 90), x + rng.uniform(1, 9), y + 2) for i in range(12)}
    dots = {f"d{i}": (rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(5)}
    right = layer(spark, [(i, box(*b)) for i, b in boxes.items()]).unionByName(
        points(spark, [(i, *xy) for i, xy in dots.items()])
    ).unionByName(layer(spark, [("line", [[(200, 0), (200, 100)]])], kind="LineString"))

    def away(px, py):
        rects = [*boxes.values(), *((x, y, x, y) for x, y in dots.values()), (200, 0, 200, 100)]
        return min(math.hypot(max(a - px, 0, px - c), max(b - py, 0, py - d)) for a, b, c, d in rects)

    left = {**spots, "far": (5000.0, -900.0), "at line": (200.0, 50.0)}
    found = gridjoin.join_nearest(
        points(spark, [(p, *xy) for p, xy in left.items()]), right, "id", settings=PATHS[path]
    ).collect()
    assert len(found) == len(left)
    for r in found:
        assert r.distance == pytest.approx(away(*left[r.id]), abs=1e-9)


def scattered(kind: str) -> tuple[list, list]:
    rng = random.Random(11)
    left = [(f"p{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(200)]
    if kind == "outlier":
        right = [(f"f{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(20_000)] + [("away", 1e6, -1e6)]
    elif kind == "cluster":
        right = [(f"f{i}", rng.gauss(50, 0.01), rng.gauss(50, 0.01)) for i in range(20_000)]
        right += [(f"g{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(2_000)]
    else:
        right = [(f"f{i}", rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(20_000)]
    return left, right


@pytest.mark.parametrize("kind", ["even", "outlier", "cluster"])
def test_nearest_measures_few_pairs_however_features_lie(spark, kind):
    left, right = scattered(kind)
    near, far = points(spark, left), points(spark, right)
    assert gridjoin.nearest_pairs(near, far, "id").count() < 100 * len(left)
    spots = np.array([r[1:] for r in right])
    found = {r.id: r.distance for r in gridjoin.join_nearest(near, far, "id").collect()}
    want = {i: float(np.hypot(*(spots - (x, y)).T).min()) for i, x, y in left}
    assert found == pytest.approx(want)


CROWDED = [gridjoin.JoinSettings(broadcast_bytes=b, hot_rows=100, max_edges=m) for b, m in ((0, 16), (256 << 20, 16), (0, 2048))]


@pytest.mark.parametrize("settings", CROWDED)
def test_one_source_over_thousands_of_areas(spark, settings):
    areas = layer(spark, [(f"{i}-{j}", box(i, j, i + 1, j + 1)) for i in range(60) for j in range(50)], "area string")
    ring = star(random.Random(5), 30, 25, 24, 400)
    shape = layer(spark, [("s", ring)])
    found = gridjoin.overlay_area(shape, areas, "area", ["id"], settings=settings).collect()
    assert sum(r.piece_area for r in found) == pytest.approx(shape.select(g.area("geom")).first()[0])
    line = layer(spark, [("l", ring)], kind="LineString")
    inside = gridjoin.overlay_length(line, areas, "area", ["id"], settings=settings).collect()
    assert sum(r.clipped_length for r in inside) == pytest.approx(line.select(g.length("geom")).first()[0])


@pytest.mark.parametrize("settings", CROWDED)
def test_clumped_vertices(spark, settings):
    rng = random.Random(6)
    # nearly all vertices lie in a thousandth of the width
    xs = sorted([rng.uniform(50, 50.1) for _ in range(5000)] + [0.0, 100.0])
    ring = [(x, 10 + rng.random()) for x in xs]
    ring = [[(0.0, 0.0), (100.0, 0.0), *ring[::-1], (0.0, 0.0)]]
    ready = gridjoin.prepare(layer(spark, [("a", ring)], "area string"), "area", settings=settings)
    assert ready.stats.max_edges <= settings.max_edges + 8
    square = layer(spark, [("q", box(25, 0, 75, 30)), ("r", box(50.02, 5, 50.03, 30))])
    found = {r.id: r.piece_area for r in gridjoin.overlay_area(square, ready, "area", ["id"]).collect()}
    back = {r.id: r.piece_area for r in gridjoin.overlay_area(
        layer(spark, [("big", ring)]), layer(spark, [("q", box(25, 0, 75, 30)), ("r", box(50.02, 5, 50.03, 30))], "area string"), "area", ["id"], settings=settings
    ).withColumnRenamed("id", "big").withColumnRenamed("area", "id").collect()}
    want = {k: clip_convex(ring[0], box(*b)[0]) for k, b in (("q", (25, 0, 75, 30)), ("r", (50.02, 5, 50.03, 30)))}
    assert found == pytest.approx(want, rel=1e-9) and back == pytest.approx(want, rel=1e-9)
    spots = points(spark, [("in", 50.05, 9.0), ("out", 50.05, 12.0), ("left", 1.0, 5.0)])
    assert {r.id for r in gridjoin.join_within(spots, ready, "area").collect()} == {"in", "left"}


def test_no_pairwise_plan(spark):
    areas = layer(spark, [("a", box(0, 0, 5, 5))], "area string")
    shapes = layer(spark, [("s", box(1, 1, 2, 2))])
    spots = points(spark, [("p", 1.0, 1.0)])
    for settings in (PATHS["broadcast"], PATHS["salted"]):
        for df in (
            gridjoin.join_within(spots, areas, "area", settings=settings),
            gridjoin.overlay_area(shapes, areas, "area", ["id"], settings=settings),
            gridjoin.join_nearest(spots, shapes, "id", settings=settings),
        ):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan
            assert "NestedLoop" not in plan


def test_empty_area_layer(spark):
    none = layer(spark, [("a", box(0, 0, 1, 1))], "area string").limit(0)
    assert gridjoin.join_within(points(spark, [("p", 0.5, 0.5)]), none, "area").count() == 0
    shapes = layer(spark, [("s", box(0, 0, 1, 1))])
    assert gridjoin.overlay_area(shapes, none, "area", ["id"]).count() == 0


# --- area-weighted means -----------------------------------------------------


def mean_of(spark, pieces, **kw):
    areas = layer(spark, [("a", box(0, 0, 10, 10))], "area string")
    source = layer(spark, [(f"m{i}", v, b) for i, (v, b) in enumerate(pieces)], "id string, v double")
    return aggregates.area_weighted_mean(source, areas, ["v"], "area", ["id"], **kw).first()


def test_weighted_mean_of_halves(spark):
    r = mean_of(spark, [(10.0, box(0, 0, 5, 10)), (20.0, box(5, 0, 10, 10))])
    assert (r.v, r.v_max, r.mesh_block_count) == (15.0, 20.0, 2)


def test_weighted_mean_of_sliver(spark):
    assert mean_of(spark, [(100.0, box(0, 0, 1, 10)), (0.0, box(1, 0, 10, 10))]).v == 10.0


def test_null_values_act_as_zero_by_default(spark):
    halves = [(10.0, box(0, 0, 5, 10)), (None, box(5, 0, 10, 10))]
    assert mean_of(spark, halves).v == 5.0
    assert mean_of(spark, halves, null_policy="skip").v == 10.0
    empty = mean_of(spark, [(None, box(0, 0, 5, 10)), (None, box(5, 0, 10, 10))])
    assert (empty.v, empty.v_max) == (0.0, None)


def test_layers_overlaid_together_equal_each_alone(spark):
    areas = layer(spark, [("a", box(0, 0, 10, 10)), ("b", box(10, 0, 20, 10)), ("far", box(90, 0, 99, 9))], "area string")
    mesh = [(f"m{i}", float(i) if i % 3 else None, box(4 * i - 3, -2, 4 * i + 1, 7)) for i in range(6)]
    # the same shape under another id, one id in two parts, a layer of its own, a part that only touches
    other = [("m0", 7.0, mesh[1][2]), ("m9", 8.0, mesh[1][2]), ("m9", 8.0, box(0, 7, 5, 9)), ("t", 5.0, box(-5, 0, 0, 5))]
    one, two = (layer(spark, rows, "id string, v double") for rows in (mesh, other))
    line = layer(spark, [("l", 1.0, [[(0, 0), (1, 1)]])], "id string, v double", kind="LineString")
    layers = {"one": (one, ["v"]), "again": (one, ["v"]), "two": (two, ["v"]), "line": (line, ["v"])}
    for policy in ("zero", "skip"):
        found = {r.area: r for r in aggregates.area_weighted_means(layers, areas, "area", ["id"], policy).collect()}
        assert set(found) == {"a", "b"}
        for name, (source, _) in layers.items():
            alone = {r.area: r for r in aggregates.area_weighted_mean(source, areas, ["v"], "area", ["id"], policy).collect()}
            for area, r in found.items():
                want = (alone[area].v, alone[area].v_max, alone[area].mesh_block_count) if area in alone else (None, None, None)
                got = (r[f"{name}_v"], r[f"{name}_v_max"], r[f"{name}_pieces"])
                assert got[1:] == want[1:] and got[0] == (None if want[0] is None else pytest.approx(want[0]))


def test_a_mesh_of_several_layers_is_overlaid_once(spark, monkeypatch):
    areas = layer(spark, [("a", box(0, 0, 10, 10))], "area string")
    mesh = layer(spark, [(f"m{i}", float(i), box(i, 0, i + 1, 9)) for i in range(8)], "id string, v double")
    met, whole = [], gridjoin.area_terms
    monkeypatch.setattr(gridjoin, "area_terms", lambda source, *a, **k: met.append(source) or whole(source, *a, **k))
    aggregates.area_weighted_means({n: (mesh, ["v"]) for n in ("x", "y", "z")}, areas, "area", ["id"]).collect()
    assert [s.count() for s in met] == [8]


def test_overlapping_parks_count_twice(spark):
    areas = layer(spark, [("a", box(0, 0, 10, 10))], "area string")
    parks = layer(spark, [("p", box(0, 0, 5, 5)), ("q", box(0, 0, 5, 5))])
    water = layer(spark, [("w", [[(0, 0), (1, 1)]])], kind="LineString")
    r = features.park_water_features(parks, water, areas, "area").first()
    assert (r.park_coverage_ratio, r.water_coverage_ratio) == (0.5, 0.0)


def test_tree_outside_the_mask_leaves_its_area_empty(spark):
    areas = layer(spark, [("in", box(0, 0, 10, 10)), ("out", box(100, 0, 110, 10))], "area string")
    canopy = layer(spark, [(f"c{i}", box(x - 1, y - 1, x + 1, y + 1)) for i, (x, y) in enumerate([(1, 1), (9, 1), (9, 9), (1, 9)])])
    trees = points(
        spark,
        [(20.0, "oak", "> 41 years", 105.0, 5.0), (30.0, None, "Not Assessed", 5.0, 5.0)],
        "diameter_breast_height double, scientific_name string, useful_life_expectency string",
    )
    from arealis.operators import shapes as sh

    hull = sh.convex_hull(canopy)
    rows = {r.area: r for r in features.tree_features(trees, hull, areas, "area").collect()}
    assert rows["out"].asDict() == {**dict.fromkeys(rows["out"].asDict()), "area": "out"}
    r = rows["in"]
    assert (r.tree_count, r.mean_diameter_cm, r.species_diversity_shannon) == (1, 30.0, None)
    assert (r.pct_long_life_expectancy, r.mean_useful_life_years) == (None, None)
    assert r.tree_density_per_ha == 100.0
