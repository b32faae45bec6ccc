"""Raw layers to clean layers in metres."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.functions import geometry as g
from arealis.functions import projection
from arealis.functions import values as v
from arealis.operators import aggregates, tables

# The columns worth keeping of each street-map layer.
MAP_COLUMNS = {
    "buildings": ["building", "name"],
    "roads": ["osmid", "highway", "name", "oneway", "length"],
    "parks": ["leisure", "landuse", "name"],
    "water": ["natural", "waterway", "name"],
}
MULTI_VALUED = ("osmid", "highway", "name", "oneway")
TREE_NAMES = ("common_name", "scientific_name", "genus", "family")

BBox = tuple[float, float, float, float]


def clean_trees(
    raw: DataFrame, grid: projection.Grid = projection.ZONE_55, seen: Observation | None = None
) -> DataFrame:
    """Trees with coordinates; bad diameters nulled, names stripped, life class labelled."""
    located = tables.drop_missing(raw, ["latitude", "longitude"])
    sized = located.withColumn(
        "diameter_breast_height", v.to_number(F.col("diameter_breast_height"))
    )
    plausible = tables.null_implausible(sized, "diameter_breast_height", v.MAX_DIAMETER_CM, seen)
    names = {c: v.standardise_text(F.col(c)) for c in TREE_NAMES if c in raw.columns}
    return plausible.withColumns(
        {
            **names,
            "useful_life_expectency": v.label_missing(
                F.col("useful_life_expectency"), v.NOT_ASSESSED
            ),
            "geom": projection.forward_point("longitude", "latitude", grid),
        }
    )


def clean_polygons(
    raw: DataFrame, bbox: BBox, grid: projection.Grid | None = projection.ZONE_55
) -> DataFrame:
    """Repair what is safe, clip to the study rectangle, project.

    Shapes that cannot be mended keep their row and carry ``quarantined``.
    """
    clipped = tables.clip_to_box(aggregates.repair(raw), bbox)
    if grid is None:
        return clipped
    return clipped.withColumn("geom", projection.project("geom", grid))


def clean_canopy(
    raw: DataFrame, bbox: BBox, grid: projection.Grid | None = projection.ZONE_55
) -> DataFrame:
    """Canopy polygons, shapes only."""
    return clean_polygons(raw.select("geom"), bbox, grid)


def clean_osm(
    layers: Mapping[str, DataFrame], grid: projection.Grid | None = projection.ZONE_55
) -> dict[str, DataFrame]:
    """Street-map layers: few columns, plain text for merged tags, building areas."""
    out = {}
    for name, raw in layers.items():
        df = aggregates.repair(tables.keep_columns(raw, [*MAP_COLUMNS[name], "geom"]))
        if grid is not None:
            df = df.withColumn("geom", projection.project("geom", grid))
        if name == "roads":
            for c in (c for c in MULTI_VALUED if c in df.columns):
                is_array = isinstance(df.schema[c].dataType, T.ArrayType)
                text = F.col(c) if is_array else F.col(c).cast("string")
                df = df.withColumn(c, v.normalise_multivalue(text, is_array))
        if name == "buildings":
            df = df.withColumn("building_area_sqm", g.area("geom"))
        out[name] = df
    return out
