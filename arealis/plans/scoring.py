"""Predictions, roll-up, residuals, scenarios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import values as v
from arealis.operators import aggregates, tables
from arealis.plans.features import FEATURE_COLUMNS, TARGET

PREDICTED = "predicted_mean_uhi_2018"

# The columns a scenario changes.
SLIDER_COLUMNS = [
    "tree_cover_pct_state",
    "vegetation_cover_pct_state",
    "impervious_ratio",
    "park_coverage_ratio",
]


def predict_areas(
    model: Model,
    matrix: DataFrame,
    carry: Sequence[str],
    features: Sequence[str] = FEATURE_COLUMNS,
    target: str = TARGET,
    out: str = PREDICTED,
) -> DataFrame:
    """A prediction for every area, its target known or not."""
    scored = model.transform(matrix)
    return scored.select(*carry, F.col("prediction").alias(out), target, *features)


def map_predictions(
    fine: DataFrame, bounds: DataFrame, coarse: DataFrame, key: str, parent: str, value: str = PREDICTED
) -> DataFrame:
    """The coarse matrix with the area-weighted mean of its children's predictions."""
    weights = bounds.select(key, parent, g.area("geom").alias("area"))
    return tables.attach(
        coarse, aggregates.rollup_weighted(fine, weights, key, parent, value), parent
    )


def residuals(
    pred: DataFrame, areas: DataFrame, key: str, actual: str, predicted: str
) -> DataFrame:
    """Predicted minus actual on the predicted areas, with their shape where known."""
    gap = pred.select(key, (F.col(predicted) - F.col(actual)).alias("residual"))
    return tables.join_keep_right(areas, gap, key)


def largest_residual(gaps: DataFrame) -> DataFrame:
    return gaps.agg(F.max(F.abs("residual")).alias("largest_residual"))


@dataclass(frozen=True)
class Scenario:
    """Percentage points of trees and other vegetation, and of sealed ground turned to park."""

    name: str
    extra_tree: float = 0.0
    extra_vegetation: float = 0.0
    green_conversion: float = 0.0


def with_scenarios(df: DataFrame, scenarios: Sequence[Scenario]) -> DataFrame:
    """Each row once per scenario, by exploding a short fixed list."""
    listed = F.array(
        *(
            F.struct(
                F.lit(s.name).alias("scenario"),
                F.lit(float(s.extra_tree)).alias("extra_tree"),
                F.lit(float(s.extra_vegetation)).alias("extra_vegetation"),
                F.lit(float(s.green_conversion)).alias("green_conversion"),
            )
            for s in scenarios
        )
    )
    return df.withColumn("_s", F.explode(listed)).select("*", "_s.*").drop("_s")


def adjusted(df: DataFrame) -> DataFrame:
    """The scenario's changes: clip trees, clip vegetation, raise it to trees, then seal less."""
    tree = v.clamp(F.col("tree_cover_pct_state") + F.col("extra_tree"), 0, 100)
    green = v.clamp(F.col("vegetation_cover_pct_state") + F.col("extra_vegetation"), 0, 100)
    turned = F.col("green_conversion") / 100.0

    def raised(tree_cover: Column, vegetation: Column) -> Column:
        return F.when(vegetation.isNotNull(), F.greatest(vegetation, tree_cover))

    return df.withColumns(
        {
            "tree_cover_pct_state": tree,
            "vegetation_cover_pct_state": raised(tree, green),
            "impervious_ratio": v.clamp(F.col("impervious_ratio") - turned, 0, 1),
            "park_coverage_ratio": v.clamp(F.col("park_coverage_ratio") + turned, 0, 1),
        }
    )


def what_if(
    model: Model,
    areas: DataFrame,
    scenarios: Sequence[Scenario],
    carry: Sequence[str],
    features: Sequence[str] = FEATURE_COLUMNS,
) -> DataFrame:
    """Current, modified and difference for every complete area and scenario."""
    complete = tables.drop_missing(areas, SLIDER_COLUMNS).select(*carry, *features)
    now = model.transform(complete).select(*carry, *features, F.col("prediction").alias("current"))
    changed = adjusted(with_scenarios(now, scenarios))
    then = model.transform(changed)
    return then.select(
        *carry,
        "scenario",
        "current",
        F.col("prediction").alias("modified"),
        (F.col("prediction") - F.col("current")).alias("delta"),
    )


def snapshot(
    model: Model, areas: DataFrame, carry: Sequence[str], out: str = PREDICTED
) -> DataFrame:
    """Headline features of every area, with a prediction on its own aggregated row.

    This differs by design from the mean of its children's predictions.
    """
    scored = model.transform(areas.drop(out))
    return scored.select(
        *carry,
        "tree_cover_pct_state",
        "vegetation_cover_pct_state",
        "impervious_ratio",
        "population_density",
        F.col("prediction").alias(out),
    )
