"""The provided tables seen as layers on a 500 x 500 plane.

Coordinates are multiples of 1/4, so areas and their sums are exact doubles in any
order. Each layer comes as a DataFrame and as a DuckDB common table expression; the
SQL knows the shapes are boxes, the DataFrames use the general geometry path.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.functions import values as v

LIFE_CLASSES = [*v.USEFUL_LIFE_YEARS, v.NOT_ASSESSED]
HIGHWAYS = ["residential", "motorway", "primary;service", "cycleway"]


# Schemas of the provided tables, so that no file is opened to infer them.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


#: Rows of a task of a table that is dealt out.
TASK_ROWS = 1 << 20


def table(spark: SparkSession, sf: str, name: str, spread: bool = False) -> DataFrame:
    """A provided table. ``spread`` deals one that comes in fewer files than there are
    cores out over all of them, for queries that compute much per row; a longer table over
    more tasks, so that none grows with it."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if not spread or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(max(cores, math.ceil(df.count() / TASK_ROWS)))


def _spot(key: str, factor: int, span: int = 1960) -> Column:
    return ((F.col(key).cast("long") * factor) % span) / 4


def pick(index: Column, names: list[str]) -> Column:
    """The name at an index, null beyond the list."""
    return F.get(F.array(*(F.lit(n) for n in names)), index.cast("int"))


def sql_pick(index: str, names: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {index} {cases} END"


def sa2(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    x0, y0 = (k % 5) * 100, F.floor(k / 5) * 100
    return table(spark, sf, "nation").select(
        k.cast("string").alias("sa2"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("string").alias("sa3"),
        g.make_box(x0, y0, x0 + 100, y0 + 100).alias("geom"),
    )


SA2 = """sa2 AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS sa2, n_name AS name, CAST(n_regionkey AS VARCHAR) AS sa3,
         1e2 * (n_nationkey % 5) AS x0, 1e2 * floor(n_nationkey / 5) AS y0,
         1e2 * (n_nationkey % 5) + 1e2 AS x1, 1e2 * floor(n_nationkey / 5) + 1e2 AS y1
  FROM nation)"""


def sa1(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    cells = (
        table(spark, sf, "nation")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    )
    x0 = (k % 5) * 100 + F.col("i") * 25
    y0 = F.floor(k / 5) * 100 + F.col("j") * 25
    return cells.select(
        (k * 16 + F.col("i") * 4 + F.col("j")).cast("string").alias("sa1"),
        k.cast("string").alias("sa2"),
        F.col("n_name").alias("name"),
        g.make_box(x0, y0, x0 + 25, y0 + 25).alias("geom"),
    )


SA1 = """sa1 AS (
  SELECT CAST(n_nationkey * 16 + i * 4 + j AS VARCHAR) AS sa1, CAST(n_nationkey AS VARCHAR) AS sa2,
         n_name AS name,
         1e2 * (n_nationkey % 5) + 25e0 * i AS x0, 1e2 * floor(n_nationkey / 5) + 25e0 * j AS y0,
         1e2 * (n_nationkey % 5) + 25e0 * i + 25e0 AS x1,
         1e2 * floor(n_nationkey / 5) + 25e0 * j + 25e0 AS y1
  FROM nation, (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j))"""


def mesh(spark: SparkSession, sf: str) -> DataFrame:
    """Land-cover, heat and census polygons, all on one set of boxes."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    known = k % 10 != 0
    x0, y0 = _spot("p_partkey", 37) - 5, _spot("p_partkey", 53) - 5
    return table(spark, sf, "part", spread=True).select(
        F.col("p_partkey").alias("mesh_id"),
        F.when(known, size * 2).alias("PERANYVEG"),
        F.when(known, size).alias("PERANYTREE"),
        F.when(known, size / 4).alias("UHI18_M"),
        (size * 16 + k % 8).alias("POPU_DENS"),
        F.when(known, (k % 7).cast("double")).alias("PER_CARE"),
        (k % 30).cast("string").alias("SA2_MAIN16"),
        g.make_box(x0, y0, x0 + size / 2, y0 + 1 + k % 20).alias("geom"),
    )


MESH = """mesh AS (
  SELECT p_partkey AS mesh_id,
         CASE WHEN p_partkey % 10 <> 0 THEN p_size * 2e0 END AS PERANYVEG,
         CASE WHEN p_partkey % 10 <> 0 THEN p_size * 1e0 END AS PERANYTREE,
         CASE WHEN p_partkey % 10 <> 0 THEN p_size / 4e0 END AS UHI18_M,
         p_size * 16e0 + p_partkey % 8 AS POPU_DENS,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey % 7 AS DOUBLE) END AS PER_CARE,
         CAST(p_partkey % 30 AS VARCHAR) AS SA2_MAIN16,
         ((p_partkey * 37) % 1960) / 4e0 - 5 AS x0, ((p_partkey * 53) % 1960) / 4e0 - 5 AS y0,
         ((p_partkey * 37) % 1960) / 4e0 - 5 + p_size / 2e0 AS x1,
         ((p_partkey * 53) % 1960) / 4e0 - 5 + 1 + p_partkey % 20 AS y1
  FROM part)"""


def raw_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Trees before cleaning, in degrees near the grid's central meridian."""
    k = F.col("o_orderkey")
    lon = F.lit(144.5) + _spot("o_orderkey", 7919, 2000) / 500
    lat = F.lit(-38.5) + _spot("o_orderkey", 104729, 2000) / 500
    return table(spark, sf, "orders", spread=True).select(
        k.alias("tree_id"),
        F.when(k % 50 != 0, lat).alias("latitude"),
        lon.alias("longitude"),
        F.when(k % 11 == 0, F.lit("n/a"))
        .otherwise(F.floor(F.col("o_totalprice") / 1000).cast("string"))
        .alias("diameter_breast_height"),
        F.concat(F.lit(" \t"), "o_orderpriority", F.lit("\n ")).alias("scientific_name"),
        pick(F.col("o_custkey") % 7, LIFE_CLASSES).alias("useful_life_expectency"),
    )


RAW_TREES = f"""raw_trees AS (
  SELECT o_orderkey AS tree_id,
         CASE WHEN o_orderkey % 50 <> 0
              THEN CAST('-38.5' AS DOUBLE) + ((o_orderkey * 104729) % 2000) / 4e0 / 5e2 END AS latitude,
         CAST('144.5' AS DOUBLE) + ((o_orderkey * 7919) % 2000) / 4e0 / 5e2 AS longitude,
         CASE WHEN o_orderkey % 11 = 0 THEN 'n/a'
              ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) END AS diameter_breast_height,
         ' ' || chr(9) || o_orderpriority || chr(10) || ' ' AS scientific_name,
         {sql_pick("(o_custkey % 7)", LIFE_CLASSES)} AS useful_life_expectency
  FROM orders)"""


def trees(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned trees on the plane."""
    life = pick(F.col("o_custkey") % 7, LIFE_CLASSES)
    size = F.floor(F.col("o_totalprice") / 1000).cast("double")
    return table(spark, sf, "orders", spread=True).select(
        F.col("o_orderkey").alias("tree_id"),
        v.null_implausible(size, v.MAX_DIAMETER_CM).alias("diameter_breast_height"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("scientific_name"),
        v.label_missing(life, v.NOT_ASSESSED).alias("useful_life_expectency"),
        g.make_point(_spot("o_orderkey", 7919, 2000), _spot("o_orderkey", 104729, 2000)).alias("geom"),
    )


TREES = f"""trees AS (
  SELECT o_orderkey AS tree_id,
         CASE WHEN floor(o_totalprice / 1000) <= 300 THEN floor(o_totalprice / 1000) END AS diameter_breast_height,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS scientific_name,
         coalesce({sql_pick("(o_custkey % 7)", LIFE_CLASSES)}, '{v.NOT_ASSESSED}') AS useful_life_expectency,
         ((o_orderkey * 7919) % 2000) / 4e0 AS x, ((o_orderkey * 104729) % 2000) / 4e0 AS y
  FROM orders)"""

SQL_YEARS = (
    "CASE useful_life_expectency "
    + " ".join(f"WHEN '{k}' THEN CAST('{y}' AS DOUBLE)" for k, y in v.USEFUL_LIFE_YEARS.items())
    + " END"
)


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """Two-segment lines: east, then north."""
    k = F.col("o_orderkey")
    x0, y0 = _spot("o_orderkey", 613, 2000), _spot("o_orderkey", 389, 2000)
    x1, y1 = x0 + 10 + k % 30, y0 + k % 12
    return table(spark, sf, "orders", spread=True).select(
        k.alias("road_id"),
        pick(F.col("o_custkey") % 5, HIGHWAYS).alias("highway"),
        g.make_line((x0, y0), (x1, y0), (x1, y1)).alias("geom"),
    )


ROADS = f"""roads AS (
  SELECT o_orderkey AS road_id, {sql_pick("(o_custkey % 5)", HIGHWAYS)} AS highway,
         ((o_orderkey * 613) % 2000) / 4e0 AS x0, ((o_orderkey * 389) % 2000) / 4e0 AS y0,
         ((o_orderkey * 613) % 2000) / 4e0 + 10 + o_orderkey % 30 AS x1,
         ((o_orderkey * 389) % 2000) / 4e0 + o_orderkey % 12 AS y1
  FROM orders)"""


def clipped_road(area: str) -> str:
    """Length of a road inside a closed box, as SQL."""
    east = (
        f"CASE WHEN r.y0 BETWEEN {area}.y0 AND {area}.y1 "
        f"THEN greatest(0e0, least(r.x1, {area}.x1) - greatest(r.x0, {area}.x0)) ELSE 0e0 END"
    )
    north = (
        f"CASE WHEN r.x1 BETWEEN {area}.x0 AND {area}.x1 "
        f"THEN greatest(0e0, least(r.y1, {area}.y1) - greatest(r.y0, {area}.y0)) ELSE 0e0 END"
    )
    return f"({east} + {north})"


SQL_WIDTH = """CASE split_part(highway, ';', 1)
  WHEN 'residential' THEN 6e0 WHEN 'motorway' THEN 14e0 WHEN 'primary' THEN 10e0 ELSE 6e0 END"""


def buildings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = _spot("p_partkey", 37) - 5, _spot("p_partkey", 53) - 5
    side = 1 + k % 8
    return table(spark, sf, "part", spread=True).select(
        k.alias("building_id"),
        F.col("p_type").alias("building"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        g.make_box(x0, y0, x0 + side, y0 + side).alias("geom"),
    )


BUILDINGS = """buildings AS (
  SELECT p_partkey AS building_id, p_type AS building, p_name AS name,
         ((p_partkey * 37) % 1960) / 4e0 - 5 AS x0, ((p_partkey * 53) % 1960) / 4e0 - 5 AS y0,
         1e0 + p_partkey % 8 AS side
  FROM part)"""


def parks(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes, with every ninth one known only as a point."""
    k = F.col("c_custkey")
    x0, y0 = _spot("c_custkey", 41), _spot("c_custkey", 67)
    side = 1 + k % 12
    shape = F.when(k % 9 == 0, g.make_point(x0, y0)).otherwise(
        g.make_box(x0, y0, x0 + side, y0 + side)
    )
    return table(spark, sf, "customer", spread=True).select(
        k.alias("park_id"), F.col("c_mktsegment").alias("leisure"), shape.alias("geom")
    )


PARKS = """parks AS (
  SELECT c_custkey AS park_id, c_custkey % 9 <> 0 AS polygon,
         ((c_custkey * 41) % 1960) / 4e0 AS x0, ((c_custkey * 67) % 1960) / 4e0 AS y0,
         ((c_custkey * 41) % 1960) / 4e0 + CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 + c_custkey % 12 END AS x1,
         ((c_custkey * 67) % 1960) / 4e0 + CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE 1 + c_custkey % 12 END AS y1
  FROM customer)"""


def water(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes, with every fourth one a horizontal line."""
    k = F.col("s_suppkey")
    x0, y0 = _spot("s_suppkey", 331), _spot("s_suppkey", 457)
    side = 4 + k % 25
    line = g.make_line((x0, y0), (x0 + side, y0))
    shape = F.when(k % 4 == 0, line).otherwise(g.make_box(x0, y0, x0 + side, y0 + side))
    return table(spark, sf, "supplier").select(
        k.alias("water_id"), F.col("s_name").alias("name"), shape.alias("geom")
    )


WATER = """water AS (
  SELECT s_suppkey AS water_id, s_suppkey % 4 <> 0 AS polygon,
         ((s_suppkey * 331) % 1960) / 4e0 AS x0, ((s_suppkey * 457) % 1960) / 4e0 AS y0,
         ((s_suppkey * 331) % 1960) / 4e0 + 4 + s_suppkey % 25 AS x1,
         ((s_suppkey * 457) % 1960) / 4e0 + CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 4 + s_suppkey % 25 END AS y1
  FROM supplier)"""

# The canopy's centroids fill a square whose corners are four fixed boxes, so its
# hull is known exactly.
MASK = (0.0, 0.0, 260.0, 260.0)


def canopy(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = _spot("p_partkey", 37, 980), _spot("p_partkey", 53, 980)
    found = table(spark, sf, "part", spread=True).select(
        k.alias("canopy_id"),
        g.make_box(x0, y0, x0 + F.col("p_size") / 2, y0 + 1 + k % 20).alias("geom"),
    )
    corners = spark.createDataFrame(
        [(-1 - i, x, y) for i, (x, y) in enumerate(mask_corners())], "canopy_id bigint, x double, y double"
    ).select(
        "canopy_id",
        g.make_box(F.col("x") - 1, F.col("y") - 1, F.col("x") + 1, F.col("y") + 1).alias("geom"),
    )
    return found.unionByName(corners)


def mask_corners() -> list[tuple[float, float]]:
    x0, y0, x1, y1 = MASK
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


CANOPY = """canopy AS (
  SELECT p_partkey AS canopy_id, ((p_partkey * 37) % 980) / 4e0 AS x0, ((p_partkey * 53) % 980) / 4e0 AS y0,
         ((p_partkey * 37) % 980) / 4e0 + p_size / 2e0 AS x1,
         ((p_partkey * 53) % 980) / 4e0 + 1 + p_partkey % 20 AS y1
  FROM part
  UNION ALL
  SELECT id, x - 1, y - 1, x + 1, y + 1
  FROM (VALUES (-1, 0e0, 0e0), (-2, 260e0, 0e0), (-3, 260e0, 260e0), (-4, 0e0, 260e0)) AS c(id, x, y))"""

SQL_COVERED = "(a.x0 <= 260 AND a.x1 >= 0 AND a.y0 <= 260 AND a.y1 >= 0)"


def overlap(a: str, b: str) -> str:
    """Overlap area of two boxes, as SQL."""
    return (
        f"(greatest(0e0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
        f" * greatest(0e0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)))"
    )


def cte(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# --- model table -------------------------------------------------------------

MODEL_FEATURES = ["x_quantity", "x_discount", "x_tax", "x_price"]


def row_id() -> Column:
    """A line's key: order and line number alone repeat."""
    return F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long")
    )


def model_table(spark: SparkSession, sf: str) -> DataFrame:
    """A target that follows a linear rule plus repeatable noise; tax is missing on line 7."""
    line = F.col("l_linenumber").cast("long")
    noise = ((F.col("l_orderkey") * 7919 + line * 31 + F.col("l_partkey")) % 1024) / 1024 - 0.5
    y = F.lit(20.0) - F.col("l_quantity") * 0.15 + F.col("l_discount") * 20 + noise
    return table(spark, sf, "lineitem", spread=True).select(
        row_id().alias("row_id"),
        (F.col("l_suppkey") % 25).alias("grp"),
        F.col("l_quantity").alias("x_quantity"),
        F.col("l_discount").alias("x_discount"),
        F.when(line != 7, F.col("l_tax")).alias("x_tax"),
        F.col("l_extendedprice").alias("x_price"),
        y.alias("y"),
    )


MODEL = """model AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS row_id, l_suppkey % 25 AS grp,
         l_quantity AS x_quantity, l_discount AS x_discount,
         CASE WHEN l_linenumber <> 7 THEN l_tax END AS x_tax, l_extendedprice AS x_price,
         2e1 - l_quantity * CAST('0.15' AS DOUBLE) + l_discount * 20
           + (((l_orderkey * 7919 + l_linenumber * 31 + l_partkey) % 1024) / 1024e0 - CAST('0.5' AS DOUBLE)) AS y
  FROM lineitem)"""


def shap_table(spark: SparkSession, sf: str) -> DataFrame:
    """A given attribution table: three features per line, in sixteenths."""
    line = F.col("l_linenumber").cast("long")
    base = table(spark, sf, "lineitem").select(
        row_id().alias("row_id"),
        F.array(
            F.struct(F.lit("quantity").alias("feature"), F.col("l_quantity").alias("value"), ((F.col("l_orderkey") % 64 - 32) / 16).alias("shap")),
            F.struct(F.lit("line").alias("feature"), line.cast("double").alias("value"), ((F.col("l_partkey") % 32 - 16) / 16).alias("shap")),
            F.struct(F.lit("supplier").alias("feature"), (F.col("l_suppkey") % 10).cast("double").alias("value"), ((F.col("l_suppkey") % 16 - 8) / 16).alias("shap")),
        ).alias("f"),
    )
    return base.select("row_id", F.inline("f")).withColumn("base_value", F.lit(20.0))


SHAP = """shap AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS row_id, 'quantity' AS feature,
         l_quantity AS value, (l_orderkey % 64 - 32) / 16e0 AS shap FROM lineitem
  UNION ALL
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)), 'line',
         CAST(l_linenumber AS DOUBLE), (l_partkey % 32 - 16) / 16e0 FROM lineitem
  UNION ALL
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)), 'supplier',
         CAST(l_suppkey % 10 AS DOUBLE), (l_suppkey % 16 - 8) / 16e0 FROM lineitem)"""


def scored_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as scored areas: cover values, a prediction, some values missing."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.cast("string").alias("code"),
        F.concat(F.lit("Area "), (k % 97).cast("string")).alias("name"),
        F.when(k % 31 != 0, ((k * 7) % 400) / 4).alias("tree_cover_pct_state"),
        F.when(k % 37 != 0, ((k * 11) % 400) / 4).alias("vegetation_cover_pct_state"),
        (((k * 13) % 128) / 128).alias("impervious_ratio"),
        (((k * 17) % 64) / 128).alias("park_coverage_ratio"),
        F.when(k % 29 != 0, ((k * 19) % 8000) / 4).alias("population_density"),
        F.when(k % 41 != 0, ((k * 23) % 160) / 16).alias("predicted_mean_uhi_2018"),
    )


SCORED = """scored AS (
  SELECT CAST(c_custkey AS VARCHAR) AS code, 'Area ' || CAST(c_custkey % 97 AS VARCHAR) AS name,
         CASE WHEN c_custkey % 31 <> 0 THEN ((c_custkey * 7) % 400) / 4e0 END AS tree_cover_pct_state,
         CASE WHEN c_custkey % 37 <> 0 THEN ((c_custkey * 11) % 400) / 4e0 END AS vegetation_cover_pct_state,
         ((c_custkey * 13) % 128) / 128e0 AS impervious_ratio,
         ((c_custkey * 17) % 64) / 128e0 AS park_coverage_ratio,
         CASE WHEN c_custkey % 29 <> 0 THEN ((c_custkey * 19) % 8000) / 4e0 END AS population_density,
         CASE WHEN c_custkey % 41 <> 0 THEN ((c_custkey * 23) % 160) / 16e0 END AS predicted_mean_uhi_2018
  FROM customer)"""
