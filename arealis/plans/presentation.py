"""Tables behind the maps and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import colour, projection
from arealis.functions import values as v
from arealis.operators import ranking, shapes, tables
from arealis.plans.scoring import PREDICTED

# Readable labels of the feature columns.
FEATURE_LABELS = {
    "tree_cover_pct_state": "Tree cover",
    "vegetation_cover_pct_state": "Vegetation cover",
    "population_density": "Population density",
    "area_sqkm": "Suburb area",
    "pct_population_needing_care": "Care-need share",
    "dist_to_nearest_water_m": "Dist. to water",
    "impervious_ratio": "Impervious ratio",
    "building_density_per_ha": "Building density",
    "road_density_km_per_sqkm": "Road density",
    "park_coverage_ratio": "Park coverage",
    "water_coverage_ratio": "Water coverage",
    "mean_building_area_sqm": "Mean building area",
    "building_coverage_ratio": "Building coverage",
    "dist_to_nearest_park_m": "Dist. to park",
}


def choropleth_layer(df: DataFrame, key: str, col: str, ramp: colour.Ramp) -> DataFrame:
    """Position between the layer's extremes and its colour; missing values have neither."""
    span = df.agg(F.struct(F.min(col).alias("low"), F.max(col).alias("high")).alias("s")).scalar()
    placed = df.select(key, col).withColumn("_s", span)
    share = F.try_divide(F.col(col) - F.col("_s.low"), F.col("_s.high") - F.col("_s.low"))
    return placed.select(
        key, col, share.alias("position"), colour.ramp_hex(share, ramp).alias("fill")
    )


def suburb_lookup(df: DataFrame, name: str) -> DataFrame:
    """Rounded cover values per name, null kept."""
    return df.select(
        name,
        v.round_half_even(F.col("tree_cover_pct_state"), 1).alias("tree"),
        v.round_half_even(F.col("vegetation_cover_pct_state"), 1).alias("veg"),
        v.round_half_even(F.col("impervious_ratio"), 3).alias("impervious"),
    )


def importance_bars(importance: DataFrame, k: int = 6) -> DataFrame:
    """The k largest importances: percent, share of the largest, readable label."""
    top = ranking.top_k(importance, "importance", k, tie="feature")
    largest = importance.agg(F.max("importance").alias("m")).scalar()
    names = F.create_map(*(F.lit(x) for pair in FEATURE_LABELS.items() for x in pair))
    return top.withColumn("_max", largest).select(
        "feature",
        F.coalesce(F.try_element_at(names, F.col("feature")), F.col("feature")).alias("label"),
        (F.try_divide(F.col("importance"), F.col("_max")) * 100).alias("pct_of_max"),
        (F.col("importance") * 100).alias("pct"),
    )


def cover_proportions(df: DataFrame, key: str) -> DataFrame:
    """Trees, other vegetation, sealed ground and the rest, none below 0."""
    tree, green = F.col("tree_cover_pct_state"), F.col("vegetation_cover_pct_state")
    shares = df.select(
        key,
        v.clamp(tree, 0).alias("tree_pct"),
        v.clamp(green - tree, 0).alias("other_vegetation_pct"),
        v.clamp(F.col("impervious_ratio") * 100, 0).alias("impervious_pct"),
    )
    used = F.col("tree_pct") + F.col("other_vegetation_pct") + F.col("impervious_pct")
    return shares.withColumn("other_pct", v.clamp(F.lit(100.0) - used, 0))


def map_layer(
    areas: DataFrame,
    predictions: DataFrame,
    key: str,
    tolerance: float = 30.0,
    grid: projection.Grid | None = projection.ZONE_55,
) -> DataFrame:
    """Areas with predictions, simplified in metres, then in degrees, rounded for reading."""
    joined = tables.attach(areas.select(key, "geom"), predictions, key)
    thin = shapes.simplify(joined, tolerance)
    if grid is not None:
        thin = thin.withColumn("geom", projection.unproject("geom", grid))
    shown = [
        "tree_cover_pct_state",
        "vegetation_cover_pct_state",
        "impervious_ratio",
        "population_density",
    ]
    return tables.round_for_display(thin, [PREDICTED, *shown], 2, text=shown)
