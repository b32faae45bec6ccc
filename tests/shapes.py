"""Small layers for tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arealis.functions import geometry as g

Ring = list[tuple[float, float]]


def box(x0: float, y0: float, x1: float, y1: float) -> list[Ring]:
    return [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]


def layer(
    spark: SparkSession, rows: list[tuple], columns: str = "id string", kind: str = "Polygon"
) -> DataFrame:
    """Rows end with their parts; columns describe what comes before."""
    data = [
        (*r[:-1], [[{"x": float(x), "y": float(y)} for x, y in part] for part in r[-1]]) for r in rows
    ]
    schema = f"{columns}, parts array<array<struct<x:double,y:double>>>"
    made = g._orient("parts") if kind == "Polygon" else "parts"
    df = spark.createDataFrame(data, schema)
    return df.withColumn("geom", g.geometry(f"'{kind}'", made)).drop("parts")


def points(spark: SparkSession, rows: list[tuple], columns: str = "id string") -> DataFrame:
    return layer(spark, [(*r[:-2], [[(r[-2], r[-1])]]) for r in rows], columns, "Point")


L_SHAPE = [[(0, 0), (10, 0), (10, 3), (4, 3), (4, 9), (0, 9), (0, 0)]]
HOLED = [
    [(1, 1), (8, 1), (8, 8), (1, 8), (1, 1)],
    [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)],
]
