"""What each raw layer looks like."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.operators.aggregates import is_missing, with_faults

_SCHEMA = (
    "layer string, present boolean, total_rows bigint, total_columns bigint,"
    " missing_values bigint, geometry_types string, valid_geometries bigint"
)


def _one(name: str, df: DataFrame) -> DataFrame:
    plain = [c for c in df.columns if c != "geom"]
    empty = reduce(lambda a, b: a + b, (is_missing(df, c).cast("long") for c in plain), F.lit(0).cast("long"))
    if "geom" in df.columns:
        df = with_faults(df)
        broken = F.col("_open") | F.col("_short") | F.col("_crossed") | F.col("_outside")
        kinds = F.array_join(F.array_sort(F.collect_set("geom.kind")), ",")
        valid = F.count_if(F.col("geom").isNotNull() & ~broken)
    else:
        kinds, valid = F.lit(None).cast("string"), F.lit(None).cast("long")
    return df.agg(
        F.lit(name).alias("layer"),
        F.lit(True).alias("present"),
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(plain) + ("geom" in df.columns)).cast("long").alias("total_columns"),
        F.coalesce(F.sum(empty), F.lit(0)).alias("missing_values"),
        kinds.alias("geometry_types"),
        valid.alias("valid_geometries"),
    )


def layer_quality_report(spark: SparkSession, layers: Mapping[str, DataFrame | None]) -> DataFrame:
    """One row per layer: presence, size, missing cells, geometry kinds, valid shapes.

    Each layer is read once, whatever the number of its columns.
    """
    absent = [(n, False, None, None, None, None, None) for n, df in layers.items() if df is None]
    rows = [_one(n, df) for n, df in layers.items() if df is not None]
    if absent:
        rows.append(spark.createDataFrame(absent, _SCHEMA))
    return reduce(lambda a, b: a.unionByName(b), rows)
