from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import projection
from arealis.operators import aggregates, shapes, tables
from tests.shapes import HOLED, L_SHAPE, box, layer, points


def one(df, *cols):
    return df.select(*cols).first()


def test_area_counts_holes_and_ignores_ring_start(spark):
    turned = [HOLED[0][2:-1] + HOLED[0][:3], HOLED[1][::-1]]
    df = layer(spark, [("a", HOLED), ("b", turned), ("c", L_SHAPE)])
    assert [r[0] for r in df.orderBy("id").select(g.area("geom")).collect()] == [33.0, 33.0, 54.0]


def test_translation_keeps_area(spark):
    df = layer(spark, [("a", HOLED)])
    moved = df.withColumn("geom", g.translate("geom", 320704.25, 5812911.5))
    assert one(moved, g.area("geom"))[0] == 33.0


def test_centroid_by_kind(spark):
    assert one(layer(spark, [("a", HOLED)]), g.centroid("geom"))[0].x == pytest.approx(156.5 / 33)
    line = layer(spark, [("a", [[(0, 0), (4, 0), (4, 2)]])], kind="LineString")
    c = one(line, g.centroid("geom"))[0]
    assert (c.x, c.y) == (pytest.approx(16 / 6), pytest.approx(2 / 6))
    p = one(points(spark, [("a", 3.0, 4.0)]), g.centroid("geom"))[0]
    assert (p.x, p.y) == (3.0, 4.0)


def test_length(spark):
    line = layer(spark, [("a", [[(0, 0), (3, 4), (3, 10)]])], kind="LineString")
    assert one(line, g.length("geom"))[0] == 11.0
    assert one(layer(spark, [("a", box(0, 0, 2, 3))]), g.length("geom"))[0] == 10.0


@pytest.mark.parametrize(
    ("x", "y", "expected"),
    [(3, 5, True), (4, 5, False), (0, 0, False), (5, 5, False), (9.5, 1, True), (10, 3, False)],
)
def test_strictly_inside(spark, x, y, expected):
    df = layer(spark, [("a", L_SHAPE)]).withColumn("e", g.edges("geom"))
    assert one(df, g.strictly_inside("e", f"{x}D", f"{y}D"))[0] is expected


def test_point_in_hole_is_outside(spark):
    df = layer(spark, [("a", HOLED)]).withColumn("e", g.edges("geom"))
    inside = [one(df, g.strictly_inside("e", f"{x}D", "4D"))[0] for x in (1.5, 4, 7)]
    assert inside == [True, False, True]


def test_projection_matches_known_point_and_returns(spark):
    df = spark.createDataFrame([(144.9631, -37.8136)], "lon double, lat double")
    there = df.withColumn("p", projection.forward("lon", "lat"))
    p = one(there, "p")[0]
    assert (round(p.x, 3), round(p.y, 3)) == (320704.446, 5812911.7)
    back = one(there, projection.inverse("p.x", "p.y"))[0]
    assert back.x == pytest.approx(144.9631, abs=1e-8)
    assert back.y == pytest.approx(-37.8136, abs=1e-8)


def test_projection_on_central_meridian(spark):
    df = spark.createDataFrame([(147.0, 0.0)], "lon double, lat double")
    p = one(df, projection.forward("lon", "lat"))[0]
    assert (p.x, p.y) == (500000.0, 10000000.0)


def test_clip_to_box(spark):
    df = layer(spark, [("in", box(1, 1, 2, 2)), ("cut", HOLED), ("out", box(20, 20, 21, 21))])
    cut = tables.clip_to_box(df, (0, 0, 3, 10))
    found = {r.id: r.a for r in cut.select("id", g.area("geom").alias("a")).collect()}
    assert found == {"in": 1.0, "cut": 14.0 - 4.0}


def test_hull_and_cover(spark):
    spots = [(f"p{i}", *box(x - 1, y - 1, x + 1, y + 1)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (5, 5), (5, 0)])]
    hull = shapes.convex_hull(layer(spark, [(i, [r]) for i, r in spots]))
    assert one(hull, g.area("geom"), F.size(F.col("geom.parts")[0])) == (100.0, 5)
    areas = layer(
        spark,
        [("in", box(2, 2, 3, 3)), ("around", box(-5, -5, 20, 20)), ("edge", box(10, 2, 12, 4)), ("far", box(11, 11, 12, 12))],
    )
    covered = {r.id: r.covered for r in shapes.intersects_hull(areas, hull, "id").collect()}
    assert covered == {"in": True, "around": True, "edge": True, "far": False}


def test_geometry_report_and_repair(spark):
    bow = [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]
    open_ring = [[(0, 0), (2, 0), (2, 2), (0, 2)]]
    df = layer(spark, [("ok", box(0, 0, 1, 1)), ("bow", bow), ("open", open_ring)])
    row = aggregates.geometry_report(df).first()
    assert (row.shapes, row.valid, row.open_rings, row.self_crossing) == (3, 1, 1, 1)
    mended = {r.id: (r.quarantined, r.n) for r in aggregates.repair(df).select("id", "quarantined", F.size(F.col("geom.parts")[0]).alias("n")).collect()}
    assert mended == {"ok": (False, 5), "bow": (True, 5), "open": (False, 5)}


def test_rings_are_held_against_each_other(spark):
    square = box(0, 0, 10, 10)[0]
    cases = {
        "hole inside": [square, box(2, 2, 4, 4)[0]],
        "hole outside": [square, box(20, 20, 22, 22)[0]],
        "hole across": [square, [(8, 8), (12, 8.5), (12, 9), (8, 8)]],
        "hole on the border": [square, [(10, 5), (8, 4), (8, 6), (10, 5)]],
    }
    faults = aggregates.with_faults(layer(spark, list(cases.items()))).collect()
    assert {r.id: (r._crossed, r._outside) for r in faults} == {
        "hole inside": (False, False), "hole outside": (False, True), "hole across": (True, True), "hole on the border": (False, False),
    }
    assert aggregates.geometry_report(layer(spark, list(cases.items()))).first().valid == 2


def test_holes_that_leave_the_shell_without_a_crossing(spark):
    # a shell with a notch from (4, 10) down to (5, 6), and one with a vertex on its side
    notched = [(0, 0), (10, 0), (10, 10), (6, 10), (5, 6), (4, 10), (0, 10), (0, 0)]
    many = [(1 + i / 4, 1 + (i % 2) / 4) for i in range(12)]
    side = [(0, 0), (10, 0), (10, 5), (10, 10), (0, 10), (0, 0)]
    oblique = [(0, 0), (9, 3), (6, 12), (-3, 9), (0, 0)]
    far, square = box(20, 20, 30, 30)[0], box(0, 0, 10, 10)[0]
    cases = {
        "late vertex": [side, [*many, (10, 5), (12, 7), (10, 5), (1, 5), (1, 1)]],
        "over the notch": [notched, [(4, 10), (6, 10), (6, 2), (4, 2), (4, 10)]],
        "over the notch, halfway": [notched, [(3, 6), (5, 6), (7, 6), (7, 2), (3, 2), (3, 6)]],
        "notch's side is the hole's": [notched, [(4, 10), (5, 6), (4, 2), (4, 10)]],
        "along an oblique side": [oblique, [(0, 0), (9, 3), (3, 5), (0, 0)]],
    }
    wanted = {"late vertex": True, "over the notch": True, "over the notch, halfway": False, "notch's side is the hole's": False, "along an oblique side": False}
    faults = aggregates.with_faults(layer(spark, list(cases.items()))).collect()
    assert {r.id: r._outside for r in faults} == wanted
    several = {
        "second member's hole": [square, far, box(22, 22, 24, 24)[0][::-1]],
        "hole of no member": [square, far, box(12, 12, 14, 14)[0][::-1]],
        "no hole": [square, far],
    }
    made = layer(spark, list(several.items()), kind="MultiPolygon")
    assert {r.id: r._outside for r in aggregates.with_faults(made).collect()} == {
        "second member's hole": False, "hole of no member": True, "no hole": False,
    }
    assert aggregates.geometry_report(made).first().valid == 2
    assert aggregates.repair(made).agg(F.count_if("quarantined")).first()[0] == 1


def test_long_holes_are_held_against_long_shells(spark):
    turn = [2 * math.pi * i / 40000 for i in range(40000)]
    shell, hole = ([(r * math.cos(t), r * math.sin(t)) for t in turn] for r in (100, 90))
    out = [*hole[:30000], (0, -110), *hole[30000:]]
    start = time.perf_counter()
    faults = layer(spark, [("in", [shell, hole]), ("out", [shell, out])]).select("id", g.has_hole_outside("geom").alias("o")).collect()
    assert {r.id: r.o for r in faults} == {"in": False, "out": True}
    assert time.perf_counter() - start < 20


@pytest.mark.parametrize("n", [40, 400, 4000])
def test_crossings_of_short_and_long_rings(spark, n):
    ring = [(100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    tangled = list(ring)
    tangled[n // 2], tangled[n // 2 + 1] = tangled[n // 2 + 1], tangled[n // 2]
    start = time.perf_counter()
    found = {r.id: r.c for r in layer(spark, [("plain", [ring + ring[:1]]), ("tangled", [tangled + tangled[:1]])]).select("id", g.crosses_itself("geom").alias("c")).collect()}
    assert found == {"plain": False, "tangled": True}
    assert time.perf_counter() - start < 20


def test_hull_of_many_points(spark):
    from arealis.operators import shapes

    rng = np.random.default_rng(2)
    xy = rng.normal(0, 10, (3000, 2)).round(3)
    want = {tuple(p) for p in shapes.hull_points(xy[:64])}
    assert want == {tuple(p) for p in _hull_of(xy[:64])}
    assert {tuple(p) for p in shapes.hull_points(xy)} == {tuple(p) for p in _hull_of(xy)}


def _hull_of(xy):
    """Points that some line has all others on one side of (gift wrapping)."""
    pts = [tuple(p) for p in xy]
    at, out = min(pts), []
    while at not in out:
        out.append(at)
        rest = np.array([p for p in pts if p != at])
        d = rest - at
        best = 0
        for i in range(1, len(rest)):
            cross = d[best, 0] * d[i, 1] - d[best, 1] * d[i, 0]
            if cross < 0 or (cross == 0 and (d[i] ** 2).sum() > (d[best] ** 2).sum()):
                best = i
        at = tuple(rest[best])
    return out


def test_datum_shift_is_that_of_the_plate(spark):
    from arealis.functions import projection

    # a station's coordinates in both datums, as published with the transformation
    dms = lambda d, m, sec: d + m / 60 + sec / 3600
    old = (dms(133, 53, 7.847844), -dms(23, 40, 12.446019))
    new = (dms(133, 53, 7.87779), -dms(23, 40, 12.3965))
    zone = projection.Grid(central_meridian=135.0)
    df = spark.createDataFrame([(*old, *new)], "a double, b double, c double, d double")
    was, now, plain = df.select(
        projection.forward("a", "b", zone).alias("p"), projection.forward("c", "d", zone, "GDA2020").alias("q"), projection.forward("c", "d", zone).alias("r")
    ).first()
    assert (now.x, now.y) == pytest.approx((was.x, was.y), abs=2e-3)
    assert math.hypot(plain.x - was.x, plain.y - was.y) > 1.5
    with pytest.raises(ValueError, match="datum"):
        projection.forward("lon", "lat", datum="NAD27")


def test_repair_turns_rings_the_right_way(spark):
    clockwise = [box(0, 0, 4, 4)[0][::-1], box(1, 1, 2, 2)[0]]
    made = spark.createDataFrame(
        [([[{"x": float(x), "y": float(y)} for x, y in r] for r in clockwise],)],
        f"parts array<array<{g.POINT_TYPE}>>",
    ).select(g.geometry("'Polygon'", "parts").alias("geom"))
    assert one(aggregates.repair(made), g.area("geom"))[0] == 15.0


def test_simplify_drops_small_bumps_and_keeps_rings_whole(spark):
    n = 720
    ring = [(100 * math.cos(2 * math.pi * i / n), 100 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    df = layer(spark, [("circle", [ring + ring[:1]]), ("box", box(0, 0, 1, 1))])
    thin = {r.id: (r.n, r.a) for r in shapes.simplify(df, 1.0).select("id", F.size(F.col("geom.parts")[0]).alias("n"), g.area("geom").alias("a")).collect()}
    assert 10 < thin["circle"][0] < 100
    assert thin["circle"][1] == pytest.approx(math.pi * 1e4, rel=0.03)
    assert thin["box"] == (5, 1.0)
