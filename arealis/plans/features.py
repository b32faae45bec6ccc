"""Feature tables per area and the matrix they make up."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import values as v
from arealis.operators import aggregates, gridjoin, shapes, tables
from arealis.session import kept

# An area layer already measured for joins, where the caller has one.
Ready = gridjoin.PreparedAreas | None

HECTARE = 10_000.0
SQ_KM = 1_000_000.0

# The model's feature columns, in order.
FEATURE_COLUMNS = [
    "area_sqkm",
    "vegetation_cover_pct_state",
    "tree_cover_pct_state",
    "building_density_per_ha",
    "building_coverage_ratio",
    "mean_building_area_sqm",
    "road_density_km_per_sqkm",
    "park_coverage_ratio",
    "water_coverage_ratio",
    "dist_to_nearest_park_m",
    "dist_to_nearest_water_m",
    "impervious_ratio",
    "population_density",
    "pct_population_needing_care",
]
TARGET = "mean_uhi_2018"


def area_sizes(areas: DataFrame, key: str) -> DataFrame:
    """Key and area in square metres."""
    return areas.select(key, g.area("geom").alias("_area"))


def on_every_area(areas: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """All areas with ``_area``, facts attached where there are any."""
    return tables.attach(area_sizes(areas, key), facts, key)


def tree_features(
    trees: DataFrame, hull: DataFrame, areas: DataFrame, key: str, ready: Ready = None
) -> DataFrame:
    """Trees per area: count, density, mean diameter, diversity and useful life.

    One pass groups by area and species; the second level turns that into every
    column at once, diversity included, so the trees are shuffled once.
    """
    slim = trees.select("diameter_breast_height", "scientific_name", "useful_life_expectency", "geom")
    inside = gridjoin.join_within(slim, ready or areas, key)
    diameter = v.null_nan(F.col("diameter_breast_height"))
    life = F.col("useful_life_expectency")
    assessed = ~life.eqNullSafe(F.lit(v.NOT_ASSESSED))
    long_lived = F.when(assessed, F.when(life == v.LONG_LIFE, 1).otherwise(0))
    years = v.ordinal_midpoint(life)
    by_species = inside.groupBy(key, "scientific_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("scientific_name").alias("named"),
        F.sum(diameter).alias("d"),
        F.count(diameter).alias("dn"),
        F.sum(long_lived).alias("l"),
        F.count(long_lived).alias("ln"),
        F.sum(years).alias("y"),
        F.count(years).alias("yn"),
    )
    named = F.sum("named")
    spread = F.sum(F.when(F.col("named") > 0, F.col("named") * F.log("named")).otherwise(0.0))
    entropy = F.greatest(F.log(named) - spread / named, F.lit(0.0))
    stats = by_species.groupBy(key).agg(
        F.sum("n").alias("tree_count"),
        F.try_divide(F.sum("d"), F.sum("dn")).alias("mean_diameter_cm"),
        F.when(named > 0, entropy).alias("species_diversity_shannon"),
        F.try_divide(F.sum("l").cast("double"), F.sum("ln")).alias("pct_long_life_expectancy"),
        F.try_divide(F.sum("y"), F.sum("yn")).alias("mean_useful_life_years"),
    )
    covered = shapes.intersects_hull(areas, hull, key)
    full = tables.attach(on_every_area(areas, stats, key), covered, key)
    masked = tables.mask_by_coverage(
        full,
        F.col("covered"),
        ["tree_count"],
        [
            "mean_diameter_cm",
            "species_diversity_shannon",
            "pct_long_life_expectancy",
            "mean_useful_life_years",
        ],
    )
    return masked.select(
        key,
        "tree_count",
        (F.col("tree_count") / (F.col("_area") / HECTARE)).alias("tree_density_per_ha"),
        "mean_diameter_cm",
        "species_diversity_shannon",
        "pct_long_life_expectancy",
        "mean_useful_life_years",
    )


def _covered_area(layer: DataFrame, areas: gridjoin.Areas, key: str, out: str) -> DataFrame:
    """Summed overlap per area; overlapping source shapes count twice."""
    terms = gridjoin.area_terms(layer.select("geom"), areas, key)
    summed = terms.groupBy(key).agg(F.sum("term").alias(out))
    return summed.where(F.col(out) > g.MIN_PIECE_AREA)


def canopy_features(
    canopy: DataFrame, hull: DataFrame, areas: DataFrame, key: str, ready: Ready = None
) -> DataFrame:
    """Share of each area under canopy; null outside the surveyed mask."""
    summed = _covered_area(canopy, ready or areas, key, "canopy")
    full = tables.attach(
        on_every_area(areas, summed, key), shapes.intersects_hull(areas, hull, key), key
    )
    masked = tables.mask_by_coverage(full, F.col("covered"), ["canopy"], [])
    return masked.select(
        key, (F.col("canopy") / F.col("_area")).alias("canopy_coverage_ratio_city")
    )


def state_vegetation_features(
    vegetation: DataFrame,
    areas: DataFrame,
    key: str,
    id_cols: Sequence[str],
    ready: Ready = None,
) -> DataFrame:
    """Area-weighted vegetation and tree cover percentages."""
    means = aggregates.area_weighted_mean(
        vegetation, ready or areas, ["PERANYVEG", "PERANYTREE"], key, id_cols
    )
    full = tables.complete_on(areas, means, key)
    return full.select(
        key,
        F.col("PERANYVEG").alias("vegetation_cover_pct_state"),
        F.col("PERANYTREE").alias("tree_cover_pct_state"),
    )


def building_features(
    buildings: DataFrame, areas: DataFrame, key: str, ready: Ready = None
) -> DataFrame:
    """Buildings go whole to the area that holds their centroid."""
    spots = buildings.select(
        g.area("geom").alias("size_sqm"),
        g.centre_point("geom").alias("geom"),
    )
    stats = aggregates.area_stats(
        gridjoin.join_within(spots, ready or areas, key),
        key,
        {
            "building_count": F.count(F.lit(1)),
            "total_building_area_sqm": F.sum("size_sqm"),
            "mean_building_area_sqm": F.avg("size_sqm"),
        },
    )
    full = on_every_area(areas, stats, key).fillna(
        {"building_count": 0, "total_building_area_sqm": 0.0}
    )
    return full.select(
        key,
        F.col("building_count").cast("long").alias("building_count"),
        (F.col("building_count") / (F.col("_area") / HECTARE)).alias("building_density_per_ha"),
        (F.col("total_building_area_sqm") / F.col("_area")).alias("building_coverage_ratio"),
        "mean_building_area_sqm",
        "total_building_area_sqm",
    )


def road_features(
    roads: DataFrame, areas: DataFrame, key: str, ready: Ready = None
) -> DataFrame:
    """Clipped road length and density, and road surface from a width per class."""
    width = v.lookup_first(F.col("highway"), v.ROAD_WIDTH_M, v.DEFAULT_ROAD_WIDTH_M)
    slim = roads.select(width.alias("width"), "geom")
    terms = gridjoin.length_terms(slim, ready or areas, key)
    stats = terms.groupBy(key).agg(
        F.sum("term").alias("metres"), F.sum(F.col("term") * F.col("width")).alias("surface")
    )
    full = on_every_area(areas, stats, key).fillna({"metres": 0.0, "surface": 0.0})
    km = F.col("metres") / 1000.0
    return full.select(
        key,
        km.alias("road_length_km"),
        (km / (F.col("_area") / SQ_KM)).alias("road_density_km_per_sqkm"),
        F.col("surface").alias("estimated_road_area_sqm"),
    )


def park_water_features(
    parks: DataFrame, water: DataFrame, areas: DataFrame, key: str, ready: Ready = None
) -> DataFrame:
    """Park and water shares; only polygons have an area."""
    ready = ready or gridjoin.prepare(areas, key)
    park = _covered_area(tables.of_kind(parks, g.POLYGON_KINDS), ready, key, "park")
    wet = _covered_area(tables.of_kind(water, g.POLYGON_KINDS), ready, key, "wet")
    full = tables.attach(on_every_area(areas, park, key), wet, key).fillna({"park": 0.0, "wet": 0.0})
    return full.select(
        key,
        (F.col("park") / F.col("_area")).alias("park_coverage_ratio"),
        (F.col("wet") / F.col("_area")).alias("water_coverage_ratio"),
    )


def distance_features(
    areas: DataFrame, parks: DataFrame, water: DataFrame, key: str
) -> DataFrame:
    """Distance from each area's centroid to the nearest park and water feature of any kind."""
    spots = areas.select(key, g.centre_point("geom").alias("geom"))
    to_park = gridjoin.join_nearest(spots, parks, key, out="dist_to_nearest_park_m")
    to_water = gridjoin.join_nearest(spots, water, key, out="dist_to_nearest_water_m")
    return tables.join_all(to_park, to_water, key)


def urban_features(
    buildings: DataFrame,
    roads: DataFrame,
    parks: DataFrame,
    water: DataFrame,
    areas: DataFrame,
    key: str,
    ready: Ready = None,
) -> DataFrame:
    """All built-form features with the share of sealed surface, capped at 1."""
    ready = ready or gridjoin.prepare(areas, key)
    parts = [
        building_features(buildings, areas, key, ready),
        road_features(roads, areas, key, ready),
        park_water_features(parks, water, areas, key, ready),
        distance_features(areas, parks, water, key),
    ]
    joined = tables.join_common([*parts, area_sizes(areas, key)], key)
    sealed = (F.col("total_building_area_sqm") + F.col("estimated_road_area_sqm")) / F.col("_area")
    return joined.withColumn("impervious_ratio", v.clamp(sealed, high=1.0)).drop(
        "total_building_area_sqm", "estimated_road_area_sqm", "_area"
    )


def heat_target(
    heat: DataFrame, areas: DataFrame, key: str, id_cols: Sequence[str], ready: Ready = None
) -> DataFrame:
    """Area-weighted mean, maximum and piece count of the heat value."""
    means = aggregates.area_weighted_mean(heat, ready or areas, ["UHI18_M"], key, id_cols)
    full = tables.complete_on(areas, means, key)
    return full.select(
        key,
        F.col("UHI18_M").alias("mean_uhi_2018"),
        F.col("UHI18_M_max").alias("max_uhi_2018"),
        F.col("mesh_block_count").alias("heat_mesh_block_count"),
    )


def demographic_features(
    people: DataFrame, areas: DataFrame, key: str, id_cols: Sequence[str], ready: Ready = None
) -> DataFrame:
    """Area-weighted population density and care-need share.

    The heat-derived index of the same layer is never read: it leaks the target.
    """
    means = aggregates.area_weighted_mean(
        people, ready or areas, ["POPU_DENS", "PER_CARE"], key, id_cols
    )
    full = tables.complete_on(areas, means, key)
    return full.select(
        key,
        F.col("POPU_DENS").alias("population_density"),
        F.col("PER_CARE").alias("pct_population_needing_care"),
    )


def polygon_features(
    vegetation: DataFrame,
    heat: DataFrame,
    people: DataFrame,
    areas: DataFrame,
    key: str,
    id_cols: Sequence[str],
    ready: Ready = None,
) -> DataFrame:
    """What the vegetation, heat and people features say, from one overlay of all three layers."""
    wanted = {
        "vegetation": (vegetation, ["PERANYVEG", "PERANYTREE"]),
        "heat": (heat, ["UHI18_M"]),
        "people": (people, ["POPU_DENS", "PER_CARE"]),
    }
    means = aggregates.area_weighted_means(wanted, ready or areas, key, id_cols)
    full = tables.complete_on(areas, means, key)
    return full.select(
        key,
        F.col("vegetation_PERANYVEG").alias("vegetation_cover_pct_state"),
        F.col("vegetation_PERANYTREE").alias("tree_cover_pct_state"),
        F.col("heat_UHI18_M").alias("mean_uhi_2018"),
        F.col("heat_UHI18_M_max").alias("max_uhi_2018"),
        F.col("heat_pieces").alias("heat_mesh_block_count"),
        F.col("people_POPU_DENS").alias("population_density"),
        F.col("people_PER_CARE").alias("pct_population_needing_care"),
    )


@dataclass(frozen=True)
class Layers:
    """The cleaned layers a matrix is built from, all in metres.

    ``polygon_ids`` identify a row of the vegetation, heat and people layers.
    """

    trees: DataFrame
    canopy: DataFrame
    vegetation: DataFrame
    buildings: DataFrame
    roads: DataFrame
    parks: DataFrame
    water: DataFrame
    heat: DataFrame
    people: DataFrame
    polygon_ids: tuple[str, ...]


def feature_matrix(layers: Layers, areas: DataFrame, key: str, name: str) -> DataFrame:
    """Every feature and the target, one row per area of the given level.

    Other columns of ``areas`` named in it, such as the parent code, are left to the
    caller to attach; the matrix carries the key and the display name only.
    """
    # The area side and the mask serve several joins: measured and worked out once.
    ready = gridjoin.prepare(areas, key)
    hull = kept(shapes.convex_hull(layers.canopy), "hull")
    ids = layers.polygon_ids
    parts = [
        tree_features(layers.trees, hull, areas, key, ready),
        canopy_features(layers.canopy, hull, areas, key, ready),
        urban_features(
            layers.buildings,
            layers.roads,
            layers.parks,
            layers.water,
            areas,
            key,
            ready,
        ),
        polygon_features(layers.vegetation, layers.heat, layers.people, areas, key, ids, ready),
    ]
    base = areas.select(key, name, (g.area("geom") / SQ_KM).alias("area_sqkm"))
    return reduce(lambda a, b: tables.attach(a, b, key), parts, base)

