"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from arealis.session import shared_dir


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts the lineage.

    The table survives the loss of executors, and what reads it twice computes it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts, at most.
BATCH = 1000


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold few rows, as texts are long: sets the session's limit unless it is lower."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now > BATCH or now <= 0:
        spark.conf.set(name, str(BATCH))
