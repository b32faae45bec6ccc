"""Exact SHAP values of tree models, and the tables drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from arealis.operators.quantiles import average_rank
from arealis.plans import treeshap
from arealis.plans.estimators import FILLED
from arealis.session import kept, scratch_path


def tree_table(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Node table of the fitted trees, read back from the saved model: a row a node, gains by row."""
    path = scratch_path(spark, "trees")
    model.stages[-1].write().save(path)
    data = spark.read.parquet(f"{path}/data")
    nodes = data.select("treeID", "nodeData.*") if "nodeData" in data.columns else data
    return nodes.select(
        "treeID",
        "id",
        "prediction",
        "gain",
        F.col("rawCount").cast("double").alias("cover"),
        "leftChild",
        "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


def tree_shap(
    model: PipelineModel,
    df: DataFrame,
    key: str,
    features: Sequence[str],
    tasks: int | None = None,
    block: int = treeshap.BLOCK,
    leaves: int = treeshap.LEAVES,
) -> DataFrame:
    """``key, feature, value, shap, base_value``, one row per row and feature.

    Rows are imputed by the model's own first stage. The trees are sent in blocks of about ``block``
    bytes, each a single pass over the rows without a shuffle. ``tasks`` spreads rows that come
    from fewer files than there are cores. Of a tree more than ``leaves`` are worked on in
    pieces; a tree itself is packed by one task, at some 50 bytes a node.
    """
    last = model.stages[-1]
    trees = last.getNumTrees
    weights = list(last.treeWeights) if type(last).__name__.startswith("GBT") else [1.0 / trees] * trees
    names = list(features)
    packed = kept(treeshap.pieces(tree_table(model, df.sparkSession), weights, len(names), leaves), "pieces")
    base = packed.agg(F.sum("base")).first()[0]
    filled = model.stages[0].transform(df).select(
        F.col(key).alias("key"), F.array(*(F.col(c + FILLED).cast("double") for c in names)).alias("x")
    )
    if tasks:
        filled = filled.repartition(tasks, "key")
    found = treeshap.explained(filled, packed, block)
    each = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), F.col("x").alias("value"), "shap")
    return found.select(F.col("key").alias(key), F.inline(each), F.lit(base).alias("base_value"))


def shap_check(shap: DataFrame, predicted: DataFrame, key: str, prediction: str) -> DataFrame:
    """Largest gap between base plus contributions and the prediction."""
    summed = shap.groupBy(key).agg(
        (F.first("base_value") + F.sum("shap")).alias("rebuilt")
    )
    both = summed.join(predicted.select(key, prediction), key)
    return both.agg(
        F.count(F.lit(1)).alias("rows_checked"),
        F.max(F.abs(F.col("rebuilt") - F.col(prediction))).alias("largest_gap"),
    )


def mean_abs_shap(shap: DataFrame) -> DataFrame:
    return shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def shap_importance(shap: DataFrame, impurity: DataFrame) -> DataFrame:
    """Mean absolute SHAP beside impurity importance, each with its rank."""
    joined = mean_abs_shap(shap).join(
        impurity.select("feature", F.col("importance").alias("impurity_importance")), "feature"
    )
    ranked = average_rank(joined, "mean_abs_shap", "shap_rank")
    return average_rank(ranked, "impurity_importance", "impurity_rank")


def shap_dependence(shap: DataFrame, k: int = 3) -> DataFrame:
    """(value, shap) points of the k features with the largest mean absolute SHAP."""
    top = mean_abs_shap(shap).orderBy(F.desc("mean_abs_shap"), "feature").limit(k)
    return shap.join(F.broadcast(top.select("feature")), "feature", "left_semi")


def shap_waterfall(shap: DataFrame, key: str, base: str = "base_value") -> DataFrame:
    """Contributions of each row by size, with the running total from the base value.

    A window per key: it holds one row per feature.
    """
    by_size = Window.partitionBy(key).orderBy(F.desc(F.abs("shap")), "feature")
    running = F.sum("shap").over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    return shap.select(
        key,
        F.row_number().over(by_size).cast("long").alias("step"),
        "feature",
        "value",
        "shap",
        (F.col(base) + running).alias("running_total"),
    )
