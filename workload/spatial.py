"""Geometry scalars, spatial joins and the composite feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import projection
from arealis.functions import values as v
from arealis.operators import aggregates, gridjoin, shapes, tables
from arealis.plans import cleaning, features, quality
from arealis.session import kept
from workload import layers as ly
from workload.registry import query

def geom():
    return F.col("geom")


def r(expr: str, digits: int = 9) -> str:
    return f"round({expr}, {digits})"


# --- geometry scalars --------------------------------------------------------


@query(
    "make_point",
    ly.cte(ly.RAW_TREES)
    + "SELECT tree_id, longitude AS x, latitude AS y FROM raw_trees WHERE latitude IS NOT NULL",
)
def make_point(spark, sf):
    raw = ly.raw_trees(spark, sf)
    made = raw.select("tree_id", g.make_point(F.col("longitude"), F.col("latitude")).alias("geom"))
    return made.where(geom().isNotNull()).select(
        "tree_id", F.col("geom.parts")[0][0]["x"].alias("x"), F.col("geom.parts")[0][0]["y"].alias("y")
    )


def _krueger(lon: str, lat: str) -> tuple[str, str]:
    """Forward projection as SQL over columns of a subquery giving lon and lat."""
    p = projection
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    t = (
        f"sinh(atanh(sin(radians({lat}))) - {d(p._ECC)} * atanh({d(p._ECC)} * sin(radians({lat}))))"
    )
    lam = f"radians({lon} - 147)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    return xi, eta


def _place(xi: str, eta: str) -> tuple[str, str]:
    p = projection
    d = lambda x: f"CAST('{x!r}' AS DOUBLE)"
    east = " + ".join(
        [eta] + [f"{d(a)} * cos({2 * (j + 1)} * {xi}) * sinh({2 * (j + 1)} * {eta})" for j, a in enumerate(p._ALPHA)]
    )
    north = " + ".join(
        [xi] + [f"{d(a)} * sin({2 * (j + 1)} * {xi}) * cosh({2 * (j + 1)} * {eta})" for j, a in enumerate(p._ALPHA)]
    )
    k = d(p.SCALE * p._RADIUS)
    return f"5e5 + {k} * ({east})", f"1e7 + {k} * ({north})"


_XI, _ETA = _krueger("longitude", "latitude")
_EAST, _NORTH = _place("xi", "eta")


@query(
    "project",
    ly.cte(ly.RAW_TREES)
    + f"""SELECT tree_id, round({_EAST}, 3) AS x, round({_NORTH}, 3) AS y,
       round(longitude, 6) AS lon, round(latitude, 6) AS lat
FROM (SELECT tree_id, longitude, latitude, {_XI} AS xi, {_ETA} AS eta
      FROM raw_trees WHERE latitude IS NOT NULL)""",
)
def project(spark, sf):
    raw = tables.drop_missing(ly.raw_trees(spark, sf), ["latitude", "longitude"])
    there = raw.select(
        "tree_id", projection.forward_point("longitude", "latitude").alias("geom")
    )
    back = there.withColumn("b", projection.unproject("geom"))
    return back.select(
        "tree_id",
        F.round("geom.xmin", 3).alias("x"),
        F.round("geom.ymin", 3).alias("y"),
        F.round("b.xmin", 6).alias("lon"),
        F.round("b.ymin", 6).alias("lat"),
    )


@query(
    "area",
    ly.cte(ly.MESH)
    + """SELECT mesh_id, (x1 - x0) * (y1 - y0) AS sqm, (x1 - x0) * (y1 - y0) / 1e4 AS ha,
       (x1 - x0) * (y1 - y0) / 1e6 AS sqkm FROM mesh""",
)
def area(spark, sf):
    return ly.mesh(spark, sf).select("mesh_id", g.area("geom").alias("sqm")).select(
        "mesh_id", "sqm", (F.col("sqm") / 1e4).alias("ha"), (F.col("sqm") / 1e6).alias("sqkm")
    )


@query(
    "length",
    ly.cte(ly.ROADS) + "SELECT road_id, (x1 - x0) + (y1 - y0) AS metres FROM roads",
)
def length(spark, sf):
    return ly.roads(spark, sf).select("road_id", g.length("geom").alias("metres"))


@query(
    "centroid",
    ly.cte(ly.PARKS) + "SELECT park_id, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y FROM parks",
)
def centroid(spark, sf):
    return (
        ly.parks(spark, sf).select("park_id", g.centroid("geom").alias("c")).select("park_id", "c.x", "c.y")
    )


@query(
    "bounds",
    ly.cte(ly.WATER)
    + """SELECT water_id, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM water
UNION ALL SELECT -1, min(x0), min(y0), max(x1), max(y1) FROM water""",
)
def bounds(spark, sf):
    water = ly.water(spark, sf)
    cols = ["xmin", "ymin", "xmax", "ymax"]
    rows = water.select("water_id", *(F.col(f"geom.{c}").alias(c) for c in cols))
    whole = aggregates.total_bounds(water).select(F.lit(-1).cast("long").alias("water_id"), *cols)
    return rows.unionByName(whole)


STUDY = (20.0, 30.0, 420.5, 380.25)
_SX0, _SY0, _SX1, _SY1 = STUDY


@query(
    "bbox_polygon",
    ly.cte(ly.MESH)
    + f"""SELECT mesh_id, x0 <= {_SX1}e0 AND x1 >= {_SX0}e0 AND y0 <= {_SY1}e0 AND y1 >= {_SY0}e0 AS meets
FROM mesh""",
)
def bbox_polygon(spark, sf):
    held = ly.mesh(spark, sf).withColumn("study", g.bbox_polygon(STUDY))
    return held.select("mesh_id", g.intersects("geom", "study").alias("meets"))


@query(
    "clip_to_box",
    ly.cte(ly.MESH)
    + f"""SELECT mesh_id, (least(x1, {_SX1}e0) - greatest(x0, {_SX0}e0)) * (least(y1, {_SY1}e0) - greatest(y0, {_SY0}e0)) AS sqm,
       greatest(x0, {_SX0}e0) AS xmin, least(y1, {_SY1}e0) AS ymax
FROM mesh WHERE least(x1, {_SX1}e0) > greatest(x0, {_SX0}e0) AND least(y1, {_SY1}e0) > greatest(y0, {_SY0}e0)""",
)
def clip_to_box(spark, sf):
    cut = tables.clip_to_box(ly.mesh(spark, sf), STUDY)
    return cut.select("mesh_id", g.area("geom").alias("sqm"), "geom.xmin", "geom.ymax")


@query(
    "convex_hull",
    ly.cte(ly.CANOPY)
    + """SELECT min((x0 + x1) / 2) AS xmin, min((y0 + y1) / 2) AS ymin,
       max((x0 + x1) / 2) AS xmax, max((y0 + y1) / 2) AS ymax,
       (max((x0 + x1) / 2) - min((x0 + x1) / 2)) * (max((y0 + y1) / 2) - min((y0 + y1) / 2)) AS sqm,
       CAST(5 AS BIGINT) AS points
FROM canopy""",
)
def convex_hull(spark, sf):
    hull = shapes.convex_hull(ly.canopy(spark, sf))
    return hull.select(
        "geom.xmin",
        "geom.ymin",
        "geom.xmax",
        "geom.ymax",
        g.area("geom").alias("sqm"),
        F.size(F.col("geom.parts")[0]).cast("long").alias("points"),
    )


@query(
    "intersects_hull",
    ly.cte(ly.SA1, ly.SA2)
    + f"""SELECT sa1 AS code, {ly.SQL_COVERED} AS covered FROM sa1 a
UNION ALL SELECT 'sa2-' || sa2, {ly.SQL_COVERED} FROM sa2 a""",
)
def intersects_hull(spark, sf):
    hull = shapes.convex_hull(ly.canopy(spark, sf))
    fine = ly.sa1(spark, sf).select(F.col("sa1").alias("code"), "geom")
    coarse = ly.sa2(spark, sf).select(F.concat(F.lit("sa2-"), "sa2").alias("code"), "geom")
    return shapes.intersects_hull(fine.unionByName(coarse), hull, "code")


def _faulty(spark, sf):
    """Parts as polygons, some open, some with too few vertices, some crossing themselves."""
    k = F.col("p_partkey")
    x, y, w = F.col("geom.xmin"), F.col("geom.ymin"), F.lit(4.0)
    p = g.point
    box = F.array(p(x, y), p(x + w, y), p(x + w, y + w), p(x, y + w), p(x, y))
    bow = F.array(p(x, y), p(x + w, y + w), p(x + w, y), p(x, y + w), p(x, y))
    short = F.array(p(x, y), p(x + w, y), p(x, y))
    open_ring = F.array(p(x, y), p(x + w, y), p(x + w, y + w), p(x, y + w))
    ring = F.when(k % 7 == 0, bow).when(k % 11 == 0, short).when(k % 5 == 0, open_ring).otherwise(box)
    away = F.array(p(x + 9, y), p(x + 9, y + 1), p(x + 10, y), p(x + 9, y))
    across = F.array(p(x + 3, y + 1), p(x + 3, y + 2), p(x + 7, y + 1.5), p(x + 3, y + 1))
    around = F.array(*(p(x + 2 + dx, y + 2 + dy) for dx, dy in ((0, 0), (0, 1), (1, 1), (1, 0), (0, 0))))
    hole = F.when(k % 13 == 1, away).when(k % 13 == 2, across).when(k % 13 == 3, around)
    base = ly.buildings(spark, sf).select(F.col("building_id").alias("p_partkey"), "geom")
    ringed = base.withColumn("rings", F.filter(F.array(ring, hole), lambda r: r.isNotNull()))
    return ringed.select("p_partkey", g.geometry("'Polygon'", "rings").alias("geom"))


@query(
    "geometry_report",
    """WITH r AS (SELECT p_partkey % 13 AS h, p_partkey % 7 = 0 AS bow, p_partkey % 7 <> 0 AND p_partkey % 11 = 0 AS short,
       p_partkey % 7 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 5 = 0 AS open FROM part),
f AS (SELECT *, bow OR (h = 2 AND NOT short) AS crossed, h IN (1, 2) OR (h = 3 AND (bow OR short)) AS outside FROM r)
SELECT 'Polygon' AS kind, count(*) AS shapes, count(*) FILTER (NOT (crossed OR short OR open OR outside)) AS valid,
       count(*) FILTER (open) AS open_rings, count(*) FILTER (short) AS short_rings,
       count(*) FILTER (crossed) AS self_crossing, count(*) FILTER (outside) AS holes_outside,
       count(*) FILTER (crossed OR short OR outside) AS quarantined
FROM f""",
)
def geometry_report(spark, sf):
    faulty = _faulty(spark, sf)
    held = aggregates.repair(faulty).agg(F.count_if("quarantined").alias("quarantined"))
    return aggregates.geometry_report(faulty).withColumn("quarantined", held.scalar())


@query(
    "simplify",
    ly.cte(ly.MESH)
    + "SELECT mesh_id, (x1 - x0) * (y1 - y0) AS sqm, CAST(5 AS BIGINT) AS points FROM mesh",
)
def simplify(spark, sf):
    """Each box gets a vertex on every side, which a tolerance must take away again."""
    middle = "named_struct('x', (p.x + q.x) / 2, 'y', (p.y + q.y) / 2)"
    pairs = g._steps("r", f"array(p, {middle})")
    dense = ly.mesh(spark, sf).select(
        "mesh_id",
        g.geometry(
            "'Polygon'",
            f"transform(geom.parts, r -> concat(flatten({pairs}), slice(r, 1, 1)))",
        ).alias("geom"),
    )
    thin = shapes.simplify(dense, 0.125)
    return thin.select(
        "mesh_id", g.area("geom").alias("sqm"), F.size(F.col("geom.parts")[0]).cast("long").alias("points")
    )


# --- spatial joins -----------------------------------------------------------


@query(
    "join_within",
    ly.cte(ly.SA1, ly.TREES)
    + """SELECT tree_id, sa1 FROM trees t JOIN sa1 a
ON t.x > a.x0 AND t.x < a.x1 AND t.y > a.y0 AND t.y < a.y1""",
)
def join_within(spark, sf):
    points = ly.trees(spark, sf).select("tree_id", "geom")
    return gridjoin.join_within(points, ly.sa1(spark, sf), "sa1").select("tree_id", "sa1")


@query(
    "overlay_area",
    ly.cte(ly.SA1, ly.MESH)
    + f"""SELECT mesh_id, sa1, {ly.overlap("m", "a")} AS piece_area FROM mesh m JOIN sa1 a
ON {ly.overlap("m", "a")} > 0""",
)
def overlay_area(spark, sf):
    source = ly.mesh(spark, sf).select("mesh_id", "geom")
    return gridjoin.overlay_area(source, ly.sa1(spark, sf), "sa1", ["mesh_id"])


@query(
    "overlay_length",
    ly.cte(ly.SA2, ly.ROADS)
    + f"""SELECT road_id, sa2, round({ly.clipped_road("a")}, 9) AS clipped_length FROM roads r JOIN sa2 a
ON {ly.clipped_road("a")} > 0""",
)
def overlay_length(spark, sf):
    lines = ly.roads(spark, sf).select("road_id", "geom")
    found = gridjoin.overlay_length(lines, ly.sa2(spark, sf), "sa2", ["road_id"])
    return found.withColumn("clipped_length", F.round("clipped_length", 9))


def _away(p: str) -> str:
    """Distance from the centre of area ``a`` to box ``p``, as SQL."""
    cx, cy = "(a.x0 + a.x1) / 2", "(a.y0 + a.y1) / 2"
    dx = f"greatest({p}.x0 - {cx}, 0e0, {cx} - {p}.x1)"
    dy = f"greatest({p}.y0 - {cy}, 0e0, {cy} - {p}.y1)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


@query(
    "join_nearest",
    ly.cte(ly.SA1, ly.PARKS)
    + f"SELECT sa1, round(min({_away('p')}), 9) AS distance FROM sa1 a, parks p GROUP BY sa1",
)
def join_nearest(spark, sf):
    areas = ly.sa1(spark, sf)
    spots = areas.select("sa1", g.centre_point("geom").alias("geom"))
    near = gridjoin.join_nearest(spots, ly.parks(spark, sf), "sa1")
    return near.withColumn("distance", F.round("distance", 9))


# --- aggregation over areas --------------------------------------------------


def _weighted(col: str, area: str) -> str:
    return f"coalesce(sum({col} * {area}), 0e0) / sum({area})"


@query(
    "area_weighted_mean",
    ly.cte(ly.SA2, ly.MESH)
    + f""", pieces AS (SELECT sa2, m.*, {ly.overlap("m", "a")} AS w FROM mesh m JOIN sa2 a ON {ly.overlap("m", "a")} > 0)
SELECT sa2, {_weighted("UHI18_M", "w")} AS UHI18_M, max(UHI18_M) AS UHI18_M_max,
       {_weighted("POPU_DENS", "w")} AS POPU_DENS, max(POPU_DENS) AS POPU_DENS_max,
       count(*) AS mesh_block_count,
       sum(UHI18_M * w) / sum(w) FILTER (UHI18_M IS NOT NULL) AS known_mean
FROM pieces GROUP BY sa2""",
)
def area_weighted_mean(spark, sf):
    mesh, areas = ly.mesh(spark, sf), ly.sa2(spark, sf)
    usual = aggregates.area_weighted_mean(mesh, areas, ["UHI18_M", "POPU_DENS"], "sa2", ["mesh_id"])
    known = aggregates.area_weighted_mean(mesh, areas, ["UHI18_M"], "sa2", ["mesh_id"], "skip")
    return usual.join(known.select("sa2", F.col("UHI18_M").alias("known_mean")), "sa2")


@query(
    "rollup_weighted",
    ly.cte(ly.SA1, ly.TREES)
    + """, pred AS (SELECT sa1, avg(diameter_breast_height) AS value FROM trees t JOIN sa1 a
  ON t.x > a.x0 AND t.x < a.x1 AND t.y > a.y0 AND t.y < a.y1 GROUP BY sa1)
SELECT sa2, round(coalesce(sum(value * (x1 - x0) * (y1 - y0)), 0e0) / sum((x1 - x0) * (y1 - y0)), 9) AS value
FROM pred JOIN sa1 USING (sa1) GROUP BY sa2""",
)
def rollup_weighted(spark, sf):
    areas = ly.sa1(spark, sf)
    held = gridjoin.join_within(ly.trees(spark, sf), areas, "sa1")
    pred = held.groupBy("sa1").agg(F.avg("diameter_breast_height").alias("value"))
    weights = areas.select("sa1", "sa2", g.area("geom").alias("area"))
    rolled = aggregates.rollup_weighted(pred, weights, "sa1", "sa2", "value")
    return rolled.withColumn("value", F.round("value", 9))


@query(
    "dissolve",
    ly.cte(ly.MESH)
    + """, e AS (SELECT SA2_MAIN16, unnest([
    {'ax': x0, 'ay': y0, 'qx': x1, 'qy': y0, 'way': 1}, {'ax': x1, 'ay': y0, 'qx': x1, 'qy': y1, 'way': 1},
    {'ax': x0, 'ay': y1, 'qx': x1, 'qy': y1, 'way': -1}, {'ax': x0, 'ay': y0, 'qx': x0, 'qy': y1, 'way': -1}]) AS u FROM mesh),
net AS (SELECT SA2_MAIN16, u.ax, u.ay, u.qx, u.qy, sum(u.way) AS n FROM e GROUP BY ALL HAVING sum(u.way) <> 0),
outline AS (SELECT SA2_MAIN16, CAST(sum(abs(n)) AS BIGINT) AS edges, sum(n * (ax * qy - qx * ay)) / 2 AS sqm, min(ax) AS xmin, max(qy) AS ymax
  FROM net GROUP BY SA2_MAIN16),
value AS (SELECT SA2_MAIN16, avg(UHI18_M) AS UHI18_M FROM mesh GROUP BY SA2_MAIN16)
SELECT SA2_MAIN16, UHI18_M, edges, sqm, xmin, ymax FROM outline JOIN value USING (SA2_MAIN16)""",
)
def dissolve(spark, sf):
    merged = aggregates.dissolve(ly.mesh(spark, sf), "SA2_MAIN16", "UHI18_M")
    return merged.groupBy("SA2_MAIN16", "UHI18_M").agg(
        F.sum("times").alias("edges"),
        (F.sum(F.expr("times * (x0 * y1 - x1 * y0)")) / 2).alias("sqm"),
        F.min("x0").alias("xmin"),
        F.max("y1").alias("ymax"),
    )


@query(
    "dissolve_tiling",
    ly.cte(ly.SA1)
    + """SELECT sa2, CAST(16 AS BIGINT) AS edges, 1e4 AS sqm, min(x0) AS xmin, max(y1) AS ymax FROM sa1 GROUP BY sa2""",
)
def dissolve_tiling(spark, sf):
    """Sixteen squares an area that share all inner edges: only the sixteen outer ones stay."""
    squares = ly.sa1(spark, sf).withColumn("one", F.lit(1.0))
    return aggregates.dissolve(squares, "sa2", "one").groupBy("sa2").agg(
        F.sum("times").alias("edges"),
        (F.sum(F.expr("times * (x0 * y1 - x1 * y0)")) / 2).alias("sqm"),
        F.min("x0").alias("xmin"),
        F.max("y1").alias("ymax"),
    )


# --- feature tables ----------------------------------------------------------

_IN_AREA = "t.x > a.x0 AND t.x < a.x1 AND t.y > a.y0 AND t.y < a.y1"

_TREE_CTES = f"""inside AS (SELECT sa2, t.* FROM trees t JOIN sa2 a ON {_IN_AREA}),
tree_stats AS (SELECT sa2, count(*) AS n, avg(diameter_breast_height) AS d,
    avg(CASE WHEN useful_life_expectency <> '{v.NOT_ASSESSED}'
        THEN CASE WHEN useful_life_expectency = '{v.LONG_LIFE}' THEN 1e0 ELSE 0e0 END END) AS l,
    avg({ly.SQL_YEARS}) AS yrs FROM inside GROUP BY sa2),
species AS (SELECT sa2, scientific_name, count(*) AS c FROM inside
    WHERE scientific_name IS NOT NULL GROUP BY sa2, scientific_name),
diversity AS (SELECT sa2, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM species GROUP BY sa2)"""

_TREE_SELECT = f"""SELECT a.sa2,
  CASE WHEN {ly.SQL_COVERED} THEN coalesce(n, 0) END AS tree_count,
  CASE WHEN {ly.SQL_COVERED} THEN coalesce(n, 0) / ((x1 - x0) * (y1 - y0) / 1e4) END AS tree_density_per_ha,
  CASE WHEN {ly.SQL_COVERED} THEN round(d, 9) END AS mean_diameter_cm,
  CASE WHEN {ly.SQL_COVERED} THEN round(h, 9) END AS species_diversity_shannon,
  CASE WHEN {ly.SQL_COVERED} THEN round(l, 9) END AS pct_long_life_expectancy,
  CASE WHEN {ly.SQL_COVERED} THEN round(yrs, 9) END AS mean_useful_life_years
FROM sa2 a LEFT JOIN tree_stats USING (sa2) LEFT JOIN diversity USING (sa2)"""

_TREE_ROUNDED = [
    "mean_diameter_cm",
    "species_diversity_shannon",
    "pct_long_life_expectancy",
    "mean_useful_life_years",
]


def rounded(df, cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("tree_features", ly.cte(ly.SA2, ly.TREES, _TREE_CTES) + _TREE_SELECT)
def tree_features(spark, sf):
    hull = shapes.convex_hull(ly.canopy(spark, sf))
    return rounded(
        features.tree_features(ly.trees(spark, sf), hull, ly.sa2(spark, sf), "sa2"), _TREE_ROUNDED
    )


_CANOPY_CTE = f"""canopy_stats AS (SELECT sa2, sum({ly.overlap("c", "a")}) AS s FROM canopy c JOIN sa2 a
  ON {ly.overlap("c", "a")} > 0 GROUP BY sa2)"""


@query(
    "canopy_features",
    ly.cte(ly.SA2, ly.CANOPY, _CANOPY_CTE)
    + f"""SELECT a.sa2, CASE WHEN {ly.SQL_COVERED} THEN coalesce(s, 0e0) / ((x1 - x0) * (y1 - y0)) END
  AS canopy_coverage_ratio_city FROM sa2 a LEFT JOIN canopy_stats USING (sa2)""",
)
def canopy_features(spark, sf):
    canopy = ly.canopy(spark, sf)
    return features.canopy_features(canopy, shapes.convex_hull(canopy), ly.sa2(spark, sf), "sa2")


_PIECES = f"""pieces AS (SELECT sa2, m.*, {ly.overlap("m", "a")} AS w FROM mesh m JOIN sa2 a
  ON {ly.overlap("m", "a")} > 0)"""


@query(
    "state_vegetation_features",
    ly.cte(ly.SA2, ly.MESH, _PIECES)
    + f"""SELECT a.sa2, v AS vegetation_cover_pct_state, t AS tree_cover_pct_state FROM sa2 a LEFT JOIN (
  SELECT sa2, {_weighted("PERANYVEG", "w")} AS v, {_weighted("PERANYTREE", "w")} AS t FROM pieces GROUP BY sa2)
  USING (sa2)""",
)
def state_vegetation_features(spark, sf):
    return features.state_vegetation_features(
        ly.mesh(spark, sf), ly.sa2(spark, sf), "sa2", ["mesh_id"]
    )


_BUILDING_CTE = """building_stats AS (SELECT sa2, count(*) AS n, sum(side * side) AS s, avg(side * side) AS m
  FROM buildings b JOIN sa2 a ON b.x0 + side / 2 > a.x0 AND b.x0 + side / 2 < a.x1
   AND b.y0 + side / 2 > a.y0 AND b.y0 + side / 2 < a.y1 GROUP BY sa2)"""


@query(
    "building_features",
    ly.cte(ly.SA2, ly.BUILDINGS, _BUILDING_CTE)
    + """SELECT a.sa2, coalesce(n, 0) AS building_count,
  coalesce(n, 0) / ((x1 - x0) * (y1 - y0) / 1e4) AS building_density_per_ha,
  coalesce(s, 0e0) / ((x1 - x0) * (y1 - y0)) AS building_coverage_ratio,
  round(m, 9) AS mean_building_area_sqm, coalesce(s, 0e0) AS total_building_area_sqm
FROM sa2 a LEFT JOIN building_stats USING (sa2)""",
)
def building_features(spark, sf):
    return rounded(
        features.building_features(ly.buildings(spark, sf), ly.sa2(spark, sf), "sa2"),
        ["mean_building_area_sqm"],
    )


_ROAD_CTE = f"""road_stats AS (SELECT sa2, sum({ly.clipped_road("a")}) AS metres,
  sum({ly.clipped_road("a")} * {ly.SQL_WIDTH}) AS surface FROM roads r JOIN sa2 a
  ON {ly.clipped_road("a")} > 0 GROUP BY sa2)"""


@query(
    "road_features",
    ly.cte(ly.SA2, ly.ROADS, _ROAD_CTE)
    + """SELECT a.sa2, round(coalesce(metres, 0e0) / 1e3, 6) AS road_length_km,
  round(coalesce(metres, 0e0) / 1e3 / ((x1 - x0) * (y1 - y0) / 1e6), 3) AS road_density_km_per_sqkm,
  round(coalesce(surface, 0e0), 6) AS estimated_road_area_sqm
FROM sa2 a LEFT JOIN road_stats USING (sa2)""",
)
def road_features(spark, sf):
    found = features.road_features(ly.roads(spark, sf), ly.sa2(spark, sf), "sa2")
    return rounded(rounded(found, ["road_length_km", "estimated_road_area_sqm"], 6), ["road_density_km_per_sqkm"], 3)


_PARK_CTE = f"""park_stats AS (SELECT sa2, sum({ly.overlap("p", "a")}) AS park FROM parks p JOIN sa2 a
  ON {ly.overlap("p", "a")} > 0 WHERE polygon GROUP BY sa2),
water_stats AS (SELECT sa2, sum({ly.overlap("w", "a")}) AS wet FROM water w JOIN sa2 a
  ON {ly.overlap("w", "a")} > 0 WHERE polygon GROUP BY sa2)"""


@query(
    "park_water_features",
    ly.cte(ly.SA2, ly.PARKS, ly.WATER, _PARK_CTE)
    + """SELECT a.sa2, coalesce(park, 0e0) / ((x1 - x0) * (y1 - y0)) AS park_coverage_ratio,
  coalesce(wet, 0e0) / ((x1 - x0) * (y1 - y0)) AS water_coverage_ratio
FROM sa2 a LEFT JOIN park_stats USING (sa2) LEFT JOIN water_stats USING (sa2)""",
)
def park_water_features(spark, sf):
    return features.park_water_features(
        ly.parks(spark, sf), ly.water(spark, sf), ly.sa2(spark, sf), "sa2"
    )


_NEAR_CTE = f"""near_park AS (SELECT sa2, min({_away('p')}) AS dp FROM sa2 a, parks p GROUP BY sa2),
near_water AS (SELECT sa2, min({_away('w')}) AS dw FROM sa2 a, water w GROUP BY sa2)"""


@query(
    "distance_features",
    ly.cte(ly.SA2, ly.PARKS, ly.WATER, _NEAR_CTE)
    + """SELECT sa2, round(dp, 9) AS dist_to_nearest_park_m, round(dw, 9) AS dist_to_nearest_water_m
FROM near_park JOIN near_water USING (sa2)""",
)
def distance_features(spark, sf):
    found = features.distance_features(
        ly.sa2(spark, sf), ly.parks(spark, sf), ly.water(spark, sf), "sa2"
    )
    return rounded(found, ["dist_to_nearest_park_m", "dist_to_nearest_water_m"])


_URBAN_COLUMNS = """coalesce(b.n, 0) AS building_count,
  coalesce(b.n, 0) / ((x1 - x0) * (y1 - y0) / 1e4) AS building_density_per_ha,
  coalesce(b.s, 0e0) / ((x1 - x0) * (y1 - y0)) AS building_coverage_ratio,
  round(b.m, 9) AS mean_building_area_sqm,
  round(coalesce(metres, 0e0) / 1e3, 6) AS road_length_km,
  round(coalesce(metres, 0e0) / 1e3 / ((x1 - x0) * (y1 - y0) / 1e6), 3) AS road_density_km_per_sqkm,
  coalesce(park, 0e0) / ((x1 - x0) * (y1 - y0)) AS park_coverage_ratio,
  coalesce(wet, 0e0) / ((x1 - x0) * (y1 - y0)) AS water_coverage_ratio,
  round(dp, 9) AS dist_to_nearest_park_m, round(dw, 9) AS dist_to_nearest_water_m,
  round(least(1e0, (coalesce(b.s, 0e0) + coalesce(surface, 0e0)) / ((x1 - x0) * (y1 - y0))), 9) AS impervious_ratio"""

_URBAN_JOINS = """LEFT JOIN building_stats b USING (sa2) LEFT JOIN road_stats USING (sa2)
  LEFT JOIN park_stats USING (sa2) LEFT JOIN water_stats USING (sa2)
  JOIN near_park USING (sa2) JOIN near_water USING (sa2)"""

_URBAN_CTES = (
    ly.SA2,
    ly.BUILDINGS,
    ly.ROADS,
    ly.PARKS,
    ly.WATER,
    _BUILDING_CTE,
    _ROAD_CTE,
    _PARK_CTE,
    _NEAR_CTE,
)


def _urban_rounded(df):
    df = rounded(
        df,
        ["mean_building_area_sqm", "dist_to_nearest_park_m", "dist_to_nearest_water_m", "impervious_ratio"],
    )
    return rounded(rounded(df, ["road_length_km"], 6), ["road_density_km_per_sqkm"], 3)


@query(
    "urban_features",
    ly.cte(*_URBAN_CTES) + f"SELECT a.sa2, {_URBAN_COLUMNS} FROM sa2 a {_URBAN_JOINS}",
)
def urban_features(spark, sf):
    return _urban_rounded(
        features.urban_features(
            ly.buildings(spark, sf),
            ly.roads(spark, sf),
            ly.parks(spark, sf),
            ly.water(spark, sf),
            ly.sa2(spark, sf),
            "sa2",
        )
    )


@query(
    "heat_target",
    ly.cte(ly.SA2, ly.MESH, _PIECES)
    + f"""SELECT a.sa2, u AS mean_uhi_2018, mx AS max_uhi_2018, n AS heat_mesh_block_count
FROM sa2 a LEFT JOIN (SELECT sa2, {_weighted("UHI18_M", "w")} AS u, max(UHI18_M) AS mx, count(*) AS n
  FROM pieces GROUP BY sa2) USING (sa2)""",
)
def heat_target(spark, sf):
    return features.heat_target(ly.mesh(spark, sf), ly.sa2(spark, sf), "sa2", ["mesh_id"])


@query(
    "demographic_features",
    ly.cte(ly.SA2, ly.MESH, _PIECES)
    + f"""SELECT a.sa2, d AS population_density, c AS pct_population_needing_care
FROM sa2 a LEFT JOIN (SELECT sa2, {_weighted("POPU_DENS", "w")} AS d, {_weighted("PER_CARE", "w")} AS c
  FROM pieces GROUP BY sa2) USING (sa2)""",
)
def demographic_features(spark, sf):
    return features.demographic_features(ly.mesh(spark, sf), ly.sa2(spark, sf), "sa2", ["mesh_id"])


def matrix_layers(spark, sf) -> features.Layers:
    """The cleaned layers. Shapes of large layers are made again by each reader, as they take many times the room
    of the rows they are made from; parks and water, which the search for the nearest reads again and again, are written."""
    mesh = ly.mesh(spark, sf)
    return features.Layers(
        trees=ly.trees(spark, sf),
        canopy=ly.canopy(spark, sf),
        vegetation=mesh,
        buildings=ly.buildings(spark, sf),
        roads=ly.roads(spark, sf),
        parks=kept(ly.parks(spark, sf), "parks"),
        water=kept(ly.water(spark, sf), "water"),
        heat=mesh,
        people=mesh,
        polygon_ids=("mesh_id",),
    )


_MESH_STATS = f"""mesh_stats AS (SELECT sa2, {_weighted("PERANYVEG", "w")} AS veg, {_weighted("PERANYTREE", "w")} AS tre,
  {_weighted("UHI18_M", "w")} AS uhi, max(UHI18_M) AS uhi_max, count(*) AS blocks,
  {_weighted("POPU_DENS", "w")} AS dens, {_weighted("PER_CARE", "w")} AS care FROM pieces GROUP BY sa2)"""


def _matrix_sql(level: str) -> str:
    """The matrix at either level: the same statement over another area table."""
    ctes = [
        ly.SA1 if level == "sa1" else ly.SA2,
        ly.TREES,
        ly.CANOPY,
        ly.MESH,
        *_URBAN_CTES[1:5],
        _TREE_CTES,
        _CANOPY_CTE,
        _PIECES,
        _MESH_STATS,
        *_URBAN_CTES[5:],
    ]
    select = f"""SELECT a.sa2, a.name, (x1 - x0) * (y1 - y0) / 1e6 AS area_sqkm,
  {_TREE_SELECT[len("SELECT a.sa2,"):_TREE_SELECT.index("FROM sa2")].rstrip()},
  CASE WHEN {ly.SQL_COVERED} THEN coalesce(canopy_stats.s, 0e0) / ((x1 - x0) * (y1 - y0)) END AS canopy_coverage_ratio_city,
  veg AS vegetation_cover_pct_state, tre AS tree_cover_pct_state, {_URBAN_COLUMNS},
  uhi AS mean_uhi_2018, uhi_max AS max_uhi_2018, blocks AS heat_mesh_block_count,
  dens AS population_density, care AS pct_population_needing_care
FROM sa2 a LEFT JOIN tree_stats USING (sa2) LEFT JOIN diversity USING (sa2)
  LEFT JOIN canopy_stats USING (sa2) LEFT JOIN mesh_stats USING (sa2) {_URBAN_JOINS}"""
    if level == "sa2":
        return ly.cte(*ctes) + select.replace("coalesce(n, 0)", "coalesce(tree_stats.n, 0)")
    fine = ctes[0].replace("CAST(n_nationkey AS VARCHAR) AS sa2,", "")
    fine = fine.replace("AS sa1,", "AS sa2,").replace("sa1 AS (", "sa2 AS (")
    body = ly.cte(fine, *ctes[1:]) + select.replace("coalesce(n, 0)", "coalesce(tree_stats.n, 0)")
    return body.replace("SELECT a.sa2, a.name,", "SELECT a.sa2 AS sa1, a.name,")


def _matrix(spark, sf, level):
    areas = ly.sa1(spark, sf) if level == "sa1" else ly.sa2(spark, sf)
    matrix = features.feature_matrix(matrix_layers(spark, sf), areas, level, "name")
    return _urban_rounded(rounded(matrix, _TREE_ROUNDED))


@query("feature_matrix", _matrix_sql("sa2"))
def feature_matrix(spark, sf):
    return _matrix(spark, sf, "sa2")


@query("feature_matrix_fine", _matrix_sql("sa1"))
def feature_matrix_fine(spark, sf):
    return _matrix(spark, sf, "sa1")


# --- cleaning and quality ----------------------------------------------------


@query(
    "clean_trees",
    ly.cte(ly.RAW_TREES)
    + f"""SELECT tree_id, CASE WHEN d <= 300 THEN d END AS diameter_breast_height,
  o_orderpriority AS scientific_name,
  coalesce(useful_life_expectency, '{v.NOT_ASSESSED}') AS useful_life_expectency,
  round({_EAST}, 3) AS x, round({_NORTH}, 3) AS y
FROM (SELECT *, TRY_CAST(diameter_breast_height AS DOUBLE) AS d, {_XI} AS xi, {_ETA} AS eta
      FROM raw_trees JOIN orders ON tree_id = o_orderkey WHERE latitude IS NOT NULL)""",
)
def clean_trees(spark, sf):
    clean = cleaning.clean_trees(ly.raw_trees(spark, sf))
    return clean.select(
        "tree_id",
        "diameter_breast_height",
        "scientific_name",
        "useful_life_expectency",
        F.round("geom.xmin", 3).alias("x"),
        F.round("geom.ymin", 3).alias("y"),
    )


_CLIPPED_CANOPY = f"""SELECT count(*) AS shapes, sum(w * h) AS sqm, min(xa) AS xmin, max(yb) AS ymax
FROM (SELECT greatest(x0, {_SX0}e0) AS xa, least(y1, {_SY1}e0) AS yb,
             least(x1, {_SX1}e0) - greatest(x0, {_SX0}e0) AS w, least(y1, {_SY1}e0) - greatest(y0, {_SY0}e0) AS h
      FROM canopy) WHERE w > 0 AND h > 0"""


@query("clean_canopy", ly.cte(ly.CANOPY) + _CLIPPED_CANOPY)
def clean_canopy(spark, sf):
    clean = cleaning.clean_canopy(ly.canopy(spark, sf), STUDY, grid=None)
    return clean.agg(
        F.count(F.lit(1)).alias("shapes"),
        F.sum(g.area("geom")).alias("sqm"),
        F.min("geom.xmin").alias("xmin"),
        F.max("geom.ymax").alias("ymax"),
    )


@query(
    "clean_osm",
    f"""SELECT 'buildings' AS layer, CAST(p_partkey AS VARCHAR) AS id, p_type AS tag,
  (1e0 + p_partkey % 8) * (1 + p_partkey % 8) AS measure FROM part
UNION ALL SELECT 'roads', CAST(o_orderkey AS VARCHAR),
  CASE WHEN o_orderkey % 6 = 0 THEN 'residential;service' ELSE {ly.sql_pick("(o_custkey % 5)", ly.HIGHWAYS)} END,
  10e0 + o_orderkey % 30 + o_orderkey % 12 FROM orders
UNION ALL SELECT 'parks', CAST(c_custkey AS VARCHAR), c_mktsegment, CAST(NULL AS DOUBLE) FROM customer
UNION ALL SELECT 'water', CAST(s_suppkey AS VARCHAR), s_name, CAST(NULL AS DOUBLE) FROM supplier""",
)
def clean_osm(spark, sf):
    key = {"buildings": "building_id", "roads": "road_id", "parks": "park_id", "water": "water_id"}
    roads = ly.roads(spark, sf).withColumn(
        "highway",
        F.when(F.col("road_id") % 6 == 0, F.lit("['residential' 'service']")).otherwise(F.col("highway")),
    )
    # The columns a layer keeps are fixed, so the row's key travels as its name.
    raw = {
        "buildings": ly.buildings(spark, sf),
        "roads": roads,
        "parks": ly.parks(spark, sf),
        "water": ly.water(spark, sf).withColumn("natural", F.col("name")),
    }
    named = {
        n: df.withColumn("name", F.col(key[n]).cast("string")) for n, df in raw.items()
    }
    clean = cleaning.clean_osm(named, grid=None)
    none = F.lit(None).cast("double")
    picked = [
        ("buildings", "building", F.col("building_area_sqm")),
        ("roads", "highway", g.length("geom")),
        ("parks", "leisure", none),
        ("water", "natural", none),
    ]
    rows = [
        clean[n].select(
            F.lit(n).alias("layer"),
            F.col("name").alias("id"),
            F.col(tag).alias("tag"),
            measure.alias("measure"),
        )
        for n, tag, measure in picked
    ]
    return tables.union_tiles(rows)


@query(
    "clean_polygons",
    ly.cte(ly.MESH)
    + f"""SELECT mesh_id, UHI18_M, (least(x1, {_SX1}e0) - greatest(x0, {_SX0}e0)) * (least(y1, {_SY1}e0) - greatest(y0, {_SY0}e0)) AS sqm,
  false AS quarantined
FROM mesh WHERE least(x1, {_SX1}e0) > greatest(x0, {_SX0}e0) AND least(y1, {_SY1}e0) > greatest(y0, {_SY0}e0)""",
)
def clean_polygons(spark, sf):
    clean = cleaning.clean_polygons(ly.mesh(spark, sf), STUDY, grid=None)
    return clean.select("mesh_id", "UHI18_M", g.area("geom").alias("sqm"), "quarantined")


@query(
    "layer_quality_report",
    ly.cte(ly.RAW_TREES, ly.MESH)
    + """SELECT 'trees' AS layer, true AS present, count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
  CAST(count(*) FILTER (latitude IS NULL) + count(*) FILTER (useful_life_expectency IS NULL) AS BIGINT) AS missing_values,
  CAST(NULL AS VARCHAR) AS geometry_types, CAST(NULL AS BIGINT) AS valid_geometries FROM raw_trees
UNION ALL SELECT 'mesh', true, count(*), 8, CAST(4 * count(*) FILTER (UHI18_M IS NULL) AS BIGINT), 'Polygon', count(*) FROM mesh
UNION ALL SELECT 'water', true, count(*), 3, 0,
  CASE WHEN count(*) FILTER (s_suppkey % 4 = 0) > 0 THEN 'LineString,Polygon' ELSE 'Polygon' END, count(*) FROM supplier
UNION ALL SELECT 'parks', true, count(*), 3, 0, 'Point,Polygon', count(*) FROM customer
UNION ALL SELECT 'weather', false, NULL, NULL, NULL, NULL, NULL""",
)
def layer_quality_report(spark, sf):
    return quality.layer_quality_report(
        spark,
        {
            "trees": ly.raw_trees(spark, sf),
            "mesh": ly.mesh(spark, sf),
            "water": ly.water(spark, sf),
            "parks": ly.parks(spark, sf),
            "weather": None,
        },
    )
