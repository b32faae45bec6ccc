"""Sources, cleaning, key joins, aggregates, ranking and sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.functions import geometry as g
from arealis.functions import values as v
from arealis.operators import aggregates, gridjoin, quantiles, ranking
from arealis.operators import tables as tb
from arealis.session import scratch_path
from arealis.sources import readers, writers
from workload import layers as ly
from workload.registry import query


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


# --- sources and sinks -------------------------------------------------------


@query("densest_areas", ly.cte(ly.SA1, ly.TREES) + """SELECT sa1, count(*) AS trees, count(*) / 625e0 * 1e4 AS per_ha
FROM trees t JOIN sa1 a ON t.x > a.x0 AND t.x < a.x1 AND t.y > a.y0 AND t.y < a.y1
GROUP BY sa1 ORDER BY trees DESC, sa1 LIMIT 10""")
def densest_areas(spark, sf):
    areas = ly.sa1(spark, sf)
    held = gridjoin.join_within(ly.trees(spark, sf).select("geom"), areas, "sa1")
    counts = aggregates.area_stats(held, "sa1", {"trees": F.count(F.lit(1))})
    dense = tb.attach(counts, areas.select("sa1", g.area("geom").alias("sqm")), "sa1")
    per_ha = (F.col("trees") / F.col("sqm") * 1e4).alias("per_ha")
    return ranking.top_k(dense.select("sa1", "trees", per_ha), "trees", 10, tie="sa1")


@query(
    "read_delimited",
    """SELECT c_custkey AS code, CASE c_custkey % 4 WHEN 0 THEN c_name || chr(10) || 'second line' WHEN 1 THEN 'a "quoted"; ' || c_name ELSE c_name END AS name,
  c_acctbal AS balance, c_mktsegment AS segment FROM customer""",
)
def read_delimited(spark, sf):
    """The customers as semicolon-separated text with a byte-order mark, read back.

    Some names hold a line break, a quote or a separator.
    """
    path = scratch_path(spark, "delimited")
    out = ly.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("﻿code"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit("\nsecond line")))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('a "quoted"; '), "c_name"))
        .otherwise(F.col("c_name"))
        .alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    out.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return readers.read_delimited(
        spark, path, schema("code bigint, name string, balance double, segment string")
    )


_PARK_SQL = ly.cte(ly.PARKS) + """SELECT park_id, leisure, CASE WHEN polygon THEN 'Polygon' ELSE 'Point' END AS kind,
  (x1 - x0) * (y1 - y0) AS sqm, x0 AS xmin, y1 AS ymax
FROM (SELECT p.*, c_mktsegment AS leisure FROM parks p JOIN customer ON park_id = c_custkey)"""


def _park_columns(df):
    return df.select(
        "park_id", "leisure", "geom.kind", g.area("geom").alias("sqm"), "geom.xmin", "geom.ymax"
    )


@query("read_geojson", _PARK_SQL)
def read_geojson(spark, sf):
    path = writers.write_geojson(ly.parks(spark, sf), scratch_path(spark, "geojson"))
    back = readers.read_geojson(spark, path, schema("park_id bigint, leisure string"), lines=True)
    return _park_columns(back)


@query(
    "read_geojson_collection",
    ly.cte(ly.WATER)
    + """SELECT water_id, water_id % 3 = 0 AS flag, CASE WHEN water_id % 5 <> 0 THEN CASE WHEN polygon THEN 'Polygon' ELSE 'LineString' END END AS kind,
  CASE WHEN water_id % 5 <> 0 THEN x0 END AS xmin, CASE WHEN water_id % 5 <> 0 AND polygon THEN y1 WHEN water_id % 5 <> 0 THEN y0 END AS ymax FROM water""",
)
def read_geojson_collection(spark, sf):
    """Each layer part as one FeatureCollection over many lines, some features without a shape."""
    layer = ly.water(spark, sf).select(
        "water_id", (F.col("water_id") % 3 == 0).alias("flag"), F.when(F.col("water_id") % 5 != 0, F.col("geom")).alias("geom")
    )
    path = writers.write_geojson_collections(layer, scratch_path(spark, "collections"))
    back = readers.read_geojson(spark, path, schema("water_id bigint, flag boolean"))
    return back.select("water_id", "flag", "geom.kind", "geom.xmin", "geom.ymax")


@query(
    "write_geojson",
    ly.cte(ly.WATER)
    + """SELECT '{"type":"Feature","properties":{"water_id":' || water_id || '},"geometry":{"type":"' ||
  CASE WHEN polygon THEN 'Polygon","coordinates":[[[' ELSE 'LineString","coordinates":[[' END ||
  CAST(x0 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || '],[' || CAST(x1 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) ||
  CASE WHEN polygon THEN '],[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || '],[' ||
    CAST(x0 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || '],[' || CAST(x0 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || ']]]'
  ELSE ']]' END || '}}' AS value FROM water""",
)
def write_geojson(spark, sf):
    layer = ly.water(spark, sf).select("water_id", "geom")
    return spark.read.text(writers.write_geojson(layer, scratch_path(spark, "features")))


@query("read_layer_parquet", _PARK_SQL)
def read_layer_parquet(spark, sf):
    """A layer written as well-known binary and decoded again."""
    path = writers.write_layer(ly.parks(spark, sf), scratch_path(spark, "wkb"), wkb=True)
    return _park_columns(readers.read_layer_parquet(spark, path, ["park_id", "leisure"]))


@query("write_layer", _PARK_SQL)
def write_layer(spark, sf):
    path = writers.write_layer(ly.parks(spark, sf), scratch_path(spark, "layer"))
    return _park_columns(readers.read_layer_parquet(spark, path))


@query(
    "read_layer_dir",
    """SELECT 'parks' AS layer, c_custkey AS id FROM customer
UNION ALL SELECT 'water', s_suppkey FROM supplier""",
)
def read_layer_dir(spark, sf):
    """Two layers of five parts each; a later dataset beside one of them is not read."""
    root = scratch_path(spark, "layers")
    parks = ly.parks(spark, sf).select(F.col("park_id").alias("id"))
    water = ly.water(spark, sf).select(F.col("water_id").alias("id"))
    parks.repartition(5).write.parquet(f"{root}/parks")
    water.repartition(5).write.parquet(f"{root}/water/a.parquet")
    parks.write.parquet(f"{root}/water/b.parquet")
    return readers.read_layer_dir(spark, root)


@query(
    "read_boundaries",
    "SELECT s_suppkey AS code, s_name AS name FROM supplier WHERE s_nationkey % 5 = 2",
)
def read_boundaries(spark, sf):
    layer = ly.water(spark, sf).join(
        ly.table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("water_id"),
            (F.col("s_nationkey") % 5).cast("string").alias("region"),
        ),
        "water_id",
    )
    path = writers.write_layer(layer, scratch_path(spark, "boundaries"))
    found = readers.read_boundaries(spark, path, "2", "region")
    return found.select(F.col("water_id").alias("code"), "name")


@query(
    "read_observations_json",
    """SELECT event_type AS name, user_id AS wmo, date_trunc('second', ts) AS local_time,
  value AS air_temp, CAST(event_id % 101 AS DOUBLE) AS rel_hum,
  CAST(json_extract(props, '$.k') AS DOUBLE) AS wind_spd_kmh FROM events""",
)
def read_observations_json(spark, sf):
    """Events as weather feeds, one feed per user and type, taken apart again."""
    events = ly.table(spark, sf, "events")
    reading = F.struct(
        F.col("event_type").alias("name"),
        F.col("user_id").alias("wmo"),
        F.date_format("ts", "yyyyMMddHHmmss").alias("local_date_time_full"),
        F.col("value").alias("air_temp"),
        (F.col("event_id") % 101).cast("double").alias("rel_hum"),
        F.get_json_object("props", "$.k").cast("double").alias("wind_spd_kmh"),
    )
    feed = events.select(
        F.to_json(F.struct(F.struct(F.array(reading).alias("data")).alias("observations"))).alias("value")
    )
    path = scratch_path(spark, "feeds")
    feed.write.text(path)
    return readers.read_observations_json(spark, path, lines=True)


@query(
    "tile_bbox",
    ly.cte(ly.TREES)
    + """SELECT i * 5 + j AS tile, i * 125e0 AS xmin, j * 1e2 AS ymin, (i + 1) * 125e0 AS xmax, (j + 1) * 1e2 AS ymax,
  count(tree_id) AS trees
FROM (SELECT unnest(range(4)) AS i) CROSS JOIN (SELECT unnest(range(5)) AS j)
LEFT JOIN trees ON x >= i * 125 AND x < (i + 1) * 125 AND y >= j * 100 AND y < (j + 1) * 100
GROUP BY i, j""",
)
def tile_bbox(spark, sf):
    tiles = tb.tile_bbox(spark, (0.0, 0.0, 500.0, 500.0), 4, 5)
    at = F.floor(F.col("geom.xmin") / 125) * 5 + F.floor(F.col("geom.ymin") / 100)
    found = ly.trees(spark, sf).groupBy(at.alias("tile")).agg(F.count(F.lit(1)).alias("trees"))
    return tb.attach(tiles, found, "tile").fillna({"trees": 0})


@query(
    "merge_tiles",
    """SELECT o_orderkey AS id, 0 AS tile, o_orderstatus AS tag, o_totalprice AS price, CAST(NULL AS BIGINT) AS line
FROM orders UNION ALL
SELECT l_orderkey, 1, min(l_returnflag), NULL, CAST(min(l_linenumber) AS BIGINT) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""",
)
def merge_tiles(spark, sf):
    """Orders, then their lines: an order seen in the first tile is taken from there."""
    first = ly.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(0).alias("tile"),
        F.col("o_orderstatus").alias("tag"),
        F.col("o_totalprice").alias("price"),
    )
    second = (
        ly.table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("id"))
        .agg(F.min("l_returnflag").alias("tag"), F.min("l_linenumber").cast("long").alias("line"))
        .withColumn("tile", F.lit(1))
    )
    return tb.merge_tiles([first, second], "id")


@query(
    "write_table_csv",
    ly.cte(ly.SCORED) + "SELECT code, name, tree_cover_pct_state, impervious_ratio FROM scored",
)
def write_table_csv(spark, sf):
    table = ly.scored_areas(spark, sf).select("code", "name", "tree_cover_pct_state", "impervious_ratio")
    path = writers.write_table_csv(table, scratch_path(spark, "csv"))
    return readers.read_keyed_csv(spark, path, "code", table.schema)


@query(
    "read_keyed_csv",
    "SELECT '0' || CAST(o_orderkey AS VARCHAR) AS code, o_totalprice AS price FROM orders",
)
def read_keyed_csv(spark, sf):
    """Codes with a leading zero, which reading them as numbers would lose."""
    table = ly.table(spark, sf, "orders").select(
        F.concat(F.lit("0"), F.col("o_orderkey").cast("string")).alias("code"),
        F.col("o_totalprice").alias("price"),
    )
    path = writers.write_table_csv(table, scratch_path(spark, "keyed"))
    return readers.read_keyed_csv(spark, path, "code", schema("code bigint, price double"))


@query(
    "write_metrics_json",
    "SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag",
)
def write_metrics_json(spark, sf):
    metrics = (
        ly.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("flag"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 9).alias("mean"))
    )
    path = writers.write_metrics_json(metrics, scratch_path(spark, "metrics"))
    return spark.read.schema(metrics.schema).json(path)


# --- projections, filters, cleaning ------------------------------------------


@query(
    "drop_missing",
    ly.cte(ly.SCORED)
    + "SELECT * FROM scored WHERE tree_cover_pct_state IS NOT NULL AND vegetation_cover_pct_state IS NOT NULL",
)
def drop_missing(spark, sf):
    return tb.drop_missing(
        ly.scored_areas(spark, sf), ["tree_cover_pct_state", "vegetation_cover_pct_state"]
    )


@query(
    "to_number",
    ly.cte(ly.RAW_TREES)
    + "SELECT tree_id, TRY_CAST(diameter_breast_height AS DOUBLE) AS diameter FROM raw_trees",
)
def to_number(spark, sf):
    return ly.raw_trees(spark, sf).select(
        "tree_id", v.to_number(F.col("diameter_breast_height")).alias("diameter")
    )


@query(
    "null_implausible",
    "SELECT o_orderkey AS id, CASE WHEN floor(o_totalprice / 1000) <= 300 THEN floor(o_totalprice / 1000) END AS diameter FROM orders",
)
def null_implausible(spark, sf):
    sized = ly.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("diameter")
    )
    return tb.null_implausible(sized, "diameter", v.MAX_DIAMETER_CM)


@query("standardise_text", "SELECT o_orderkey AS tree_id, o_orderpriority AS scientific_name FROM orders")
def standardise_text(spark, sf):
    return ly.raw_trees(spark, sf).select(
        "tree_id", v.standardise_text(F.col("scientific_name")).alias("scientific_name")
    )


@query(
    "label_missing",
    ly.cte(ly.RAW_TREES)
    + f"SELECT tree_id, coalesce(useful_life_expectency, '{v.NOT_ASSESSED}') AS life, coalesce(latitude, 0e0) AS latitude FROM raw_trees",
)
def label_missing(spark, sf):
    return ly.raw_trees(spark, sf).select(
        "tree_id",
        v.label_missing(F.col("useful_life_expectency"), v.NOT_ASSESSED).alias("life"),
        v.label_missing(F.col("latitude"), 0.0).alias("latitude"),
    )


@query("keep_columns", "SELECT doc_id, lang, n_chars FROM documents")
def keep_columns(spark, sf):
    docs = ly.table(spark, sf, "documents")
    return tb.keep_columns(docs, ["doc_id", "amenity", "lang", "shop", "n_chars"])


_MULTI = """multi AS (SELECT p_partkey AS id,
  CASE p_partkey % 5 WHEN 0 THEN '[''' || split_part(p_name, ' ', 1) || ''' ''' || split_part(p_name, ' ', 2) || ''']'
    WHEN 1 THEN '["' || p_brand || '", ''' || p_type || ''']' WHEN 2 THEN '[' || p_brand || ']'
    WHEN 3 THEN NULL ELSE p_brand END AS tag, p_name, p_brand, p_type FROM part)"""


@query(
    "normalise_multivalue",
    f"""WITH {_MULTI} SELECT id, CASE id % 5 WHEN 0 THEN replace(p_name, ' ', ';')
  WHEN 1 THEN p_brand || ';' || p_type ELSE tag END AS tag, replace(p_name, ' ', ';') AS words FROM multi""",
)
def normalise_multivalue(spark, sf):
    k, words = F.col("p_partkey"), F.split("p_name", " ")
    quoted = F.format_string("['%s' '%s']", words[0], words[1])
    mixed = F.format_string("[\"%s\", '%s']", "p_brand", "p_type")
    tag = (
        F.when(k % 5 == 0, quoted)
        .when(k % 5 == 1, mixed)
        .when(k % 5 == 2, F.concat(F.lit("["), "p_brand", F.lit("]")))
        .when(k % 5 == 4, F.col("p_brand"))
    )
    return ly.table(spark, sf, "part").select(
        k.alias("id"),
        v.normalise_multivalue(tag).alias("tag"),
        v.normalise_multivalue(words, is_array=True).alias("words"),
    )


@query("lookup_first", ly.cte(ly.ROADS) + f"SELECT road_id, {ly.SQL_WIDTH} AS width FROM roads")
def lookup_first(spark, sf):
    width = v.lookup_first(F.col("highway"), v.ROAD_WIDTH_M, v.DEFAULT_ROAD_WIDTH_M)
    return ly.roads(spark, sf).select("road_id", width.alias("width"))


@query("ordinal_midpoint", ly.cte(ly.TREES) + f"SELECT tree_id, {ly.SQL_YEARS} AS years FROM trees")
def ordinal_midpoint(spark, sf):
    years = v.ordinal_midpoint(F.col("useful_life_expectency"))
    return ly.trees(spark, sf).select("tree_id", years.alias("years"))


@query("of_kind", ly.cte(ly.PARKS) + "SELECT park_id FROM parks WHERE polygon")
def of_kind(spark, sf):
    return tb.of_kind(ly.parks(spark, sf), g.POLYGON_KINDS).select("park_id")


@query(
    "exclude_value",
    ly.cte(ly.RAW_TREES)
    + f"SELECT tree_id, useful_life_expectency AS life FROM raw_trees WHERE useful_life_expectency IS DISTINCT FROM '{v.NOT_ASSESSED}'",
)
def exclude_value(spark, sf):
    trees = ly.raw_trees(spark, sf).select("tree_id", F.col("useful_life_expectency").alias("life"))
    return tb.exclude_value(trees, "life", v.NOT_ASSESSED)


@query(
    "clamp",
    ly.cte(ly.SCORED)
    + """SELECT code, CASE WHEN tree_cover_pct_state IS NOT NULL THEN least(greatest(tree_cover_pct_state * 2 - 50, 0e0), 1e2) END AS both_sides,
  CASE WHEN population_density IS NOT NULL THEN least(population_density, 1e3) END AS above, greatest(impervious_ratio, 25e-2) AS below FROM scored""",
)
def clamp(spark, sf):
    return ly.scored_areas(spark, sf).select(
        "code",
        v.clamp(F.col("tree_cover_pct_state") * 2 - 50, 0, 100).alias("both_sides"),
        v.clamp(F.col("population_density"), high=1000).alias("above"),
        v.clamp(F.col("impervious_ratio"), low=0.25).alias("below"),
    )


@query(
    "mask_by_coverage",
    """SELECT c_custkey AS code, CASE WHEN c_nationkey < 10 THEN coalesce(n, 0) END AS orders,
  CASE WHEN c_nationkey < 10 THEN top END AS top FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
)
def mask_by_coverage(spark, sf):
    stats = aggregates.area_stats(
        ly.table(spark, sf, "orders").withColumnRenamed("o_custkey", "code"),
        "code",
        {"orders": F.count(F.lit(1)), "top": F.max("o_totalprice")},
    )
    areas = ly.table(spark, sf, "customer").select(F.col("c_custkey").alias("code"), "c_nationkey")
    full = tb.attach(areas, stats, "code")
    return tb.mask_by_coverage(full, F.col("c_nationkey") < 10, ["orders"], ["top"]).drop("c_nationkey")


@query(
    "round_for_display",
    ly.cte(ly.SCORED)
    + """SELECT code, round_even(impervious_ratio, 2) AS impervious_ratio,
  coalesce(CAST(round_even(tree_cover_pct_state, 1) AS VARCHAR), 'no data') AS tree_cover_pct_state FROM scored""",
)
def round_for_display(spark, sf):
    table = ly.scored_areas(spark, sf).select("code", "impervious_ratio", "tree_cover_pct_state")
    once = tb.round_for_display(table, ["impervious_ratio"], 2)
    return tb.round_for_display(once, ["tree_cover_pct_state"], 1, text=["tree_cover_pct_state"])


@query(
    "rename_select",
    "SELECT CAST(l_orderkey AS VARCHAR) AS code, CAST(l_quantity AS BIGINT) AS trees, l_tax AS share FROM lineitem",
)
def rename_select(spark, sf):
    return tb.rename_select(
        ly.table(spark, sf, "lineitem"),
        {"l_orderkey": "code", "l_quantity": "trees", "l_tax": "share"},
        {"code": "string", "trees": "bigint"},
    )


# --- joins on keys -----------------------------------------------------------


def _sides(spark, sf):
    """Spend per customer of the data, and balances of the customers: neither holds all keys."""
    orders = ly.table(spark, sf, "orders").withColumn("code", F.col("o_custkey") * 2)
    spend = orders.groupBy("code").agg(F.max("o_totalprice").alias("spend"))
    known = ly.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("balance")
    )
    return spend, known


_SIDES = """WITH spend AS (SELECT o_custkey * 2 AS code, max(o_totalprice) AS spend FROM orders GROUP BY o_custkey),
known AS (SELECT c_custkey AS code, c_acctbal AS balance FROM customer)
"""


@query("attach", _SIDES + "SELECT code, balance, spend FROM known LEFT JOIN spend USING (code)")
def attach(spark, sf):
    spend, known = _sides(spark, sf)
    return tb.attach(known, spend, "code")


@query(
    "join_common",
    _SIDES
    + "SELECT code, spend, balance, s_name AS name FROM spend JOIN known USING (code) JOIN supplier ON s_suppkey = code",
)
def join_common(spark, sf):
    spend, known = _sides(spark, sf)
    third = ly.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))
    return tb.join_common([spend, known, third], "code")


@query("join_all", _SIDES + "SELECT code, spend, balance FROM spend FULL JOIN known USING (code)")
def join_all(spark, sf):
    spend, known = _sides(spark, sf)
    return tb.join_all(spend, known, "code")


@query(
    "join_keep_right",
    _SIDES + "SELECT k.code, spend, balance FROM spend s RIGHT JOIN known k ON s.code = k.code",
)
def join_keep_right(spark, sf):
    spend, known = _sides(spark, sf)
    return tb.join_keep_right(spend, known, "code")


@query("complete_on", _SIDES + "SELECT code, spend FROM known LEFT JOIN spend USING (code)")
def complete_on(spark, sf):
    spend, known = _sides(spark, sf)
    return tb.complete_on(known, spend, "code")


@query(
    "align_columns",
    _SIDES
    + """, lines AS (SELECT l_suppkey AS code, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT code, spend, balance, n FROM spend FULL JOIN known USING (code) FULL JOIN lines USING (code)""",
)
def align_columns(spark, sf):
    spend, known = _sides(spark, sf)
    lines = ly.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return tb.align_columns([spend, known, lines], "code")


# --- aggregates --------------------------------------------------------------


@query(
    "area_stats",
    """SELECT l_suppkey AS code, count(*) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 9) AS mean,
  max(l_extendedprice) AS top FROM lineitem GROUP BY l_suppkey""",
)
def area_stats(spark, sf):
    lines = ly.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "code")
    return aggregates.area_stats(
        lines,
        "code",
        {
            "n": F.count(F.lit(1)),
            "total": F.sum("l_quantity"),
            "mean": F.round(F.avg("l_quantity"), 9),
            "top": F.max("l_extendedprice"),
        },
    )


_BY_CUSTOMER = ly.cte(
    """trees AS (SELECT o_custkey % 40 AS code, CASE WHEN o_custkey % 40 > 2 AND o_orderkey % 13 <> 0 THEN o_orderpriority END AS species FROM orders)"""
)


@query(
    "shannon_diversity",
    _BY_CUSTOMER
    + """SELECT code, round(h, 9) AS diversity FROM (SELECT DISTINCT code FROM trees) LEFT JOIN (
  SELECT code, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM
    (SELECT code, species, count(*) AS c FROM trees WHERE species IS NOT NULL GROUP BY code, species) GROUP BY code) USING (code)""",
)
def shannon_diversity(spark, sf):
    code = F.col("o_custkey") % 40
    named = (code > 2) & (F.col("o_orderkey") % 13 != 0)
    trees = ly.table(spark, sf, "orders").select(
        code.alias("code"), F.when(named, F.col("o_orderpriority")).alias("species")
    )
    found = aggregates.shannon_diversity(trees, "code", "species")
    return found.withColumn("diversity", F.round("diversity", 9))


@query(
    "share_matching",
    ly.cte(ly.TREES)
    + f"""SELECT tree_id % 25 AS code, round(avg(CASE WHEN useful_life_expectency = '{v.LONG_LIFE}' THEN 1e0 ELSE 0e0 END)
  FILTER (useful_life_expectency <> '{v.NOT_ASSESSED}' AND tree_id % 25 <> 7), 9) AS share FROM trees GROUP BY 1""",
)
def share_matching(spark, sf):
    code = F.col("tree_id") % 25
    trees = ly.trees(spark, sf).withColumn("code", code)
    life = F.col("useful_life_expectency")
    found = aggregates.share_matching(
        trees, "code", life == v.LONG_LIFE, (life != v.NOT_ASSESSED) & (code != 7)
    )
    return found.withColumn("share", F.round("share", 9))


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS distinct_values FROM lineitem")
def distinct_count(spark, sf):
    return aggregates.distinct_count(ly.table(spark, sf, "lineitem"), "l_partkey")


@query(
    "missing_profile",
    ly.cte(ly.SCORED)
    + """SELECT * FROM (SELECT 'tree_cover_pct_state' AS column_name, count(*) FILTER (tree_cover_pct_state IS NULL) AS missing FROM scored
UNION ALL SELECT 'vegetation_cover_pct_state', count(*) FILTER (vegetation_cover_pct_state IS NULL) FROM scored
UNION ALL SELECT 'population_density', count(*) FILTER (population_density IS NULL) FROM scored
UNION ALL SELECT 'predicted_mean_uhi_2018', count(*) FILTER (predicted_mean_uhi_2018 IS NULL) FROM scored) WHERE missing > 0""",
)
def missing_profile(spark, sf):
    return aggregates.missing_profile(ly.scored_areas(spark, sf))


def _describe_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 6) AS std,
  min({c}) AS min, round(quantile_cont({c}, 0.25), 9) AS q25, round(quantile_cont({c}, 0.5), 9) AS q50,
  round(quantile_cont({c}, 0.75), 9) AS q75, max({c}) AS max FROM {table}"""
        for c in cols
    )


@query("describe_table", ly.cte(ly.MODEL) + _describe_sql("model", [*ly.MODEL_FEATURES, "y"]))
def describe_table(spark, sf):
    # Quartiles take several passes, so the columns are kept.
    rows = ly.model_table(spark, sf).select(*ly.MODEL_FEATURES, "y").persist()
    found = aggregates.describe_table(rows, [*ly.MODEL_FEATURES, "y"])
    return found.withColumns(
        {
            "mean": F.round("mean", 7),
            "std": F.round("std", 6),
            **{c: F.round(c, 9) for c in ("q25", "q50", "q75")},
        }
    )


_PAIR_COLUMNS = ["tree_cover_pct_state", "vegetation_cover_pct_state", "impervious_ratio"]
_SCORE = "predicted_mean_uhi_2018"


@query(
    "correlation_matrix",
    ly.cte(ly.SCORED)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS r FROM scored"
        for a in [*_PAIR_COLUMNS, _SCORE]
        for b in [*_PAIR_COLUMNS, _SCORE]
        if a != b
    )
    + "".join(f" UNION ALL SELECT '{a}', '{a}', 1e0" for a in [*_PAIR_COLUMNS, _SCORE]),
)
def correlation_matrix(spark, sf):
    found = aggregates.correlation_matrix(ly.scored_areas(spark, sf), [*_PAIR_COLUMNS, _SCORE])
    return found.withColumn("r", F.round("r", 6))


_GAPS = {"x_quantity": "x_quantity", "y": "y", "gap": "CASE WHEN x_quantity <= 25 THEN y END"}


@query(
    "correlation_with_gaps",
    ly.cte(ly.MODEL)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({x}, {y}), 6) AS r FROM model"
        for a, x in _GAPS.items()
        for b, y in _GAPS.items()
    )
    + "".join(f" UNION ALL SELECT 'level', '{c}', NULL" for c in [*_GAPS, "level"])
    + "".join(f" UNION ALL SELECT '{c}', 'level', NULL" for c in _GAPS),
)
def correlation_with_gaps(spark, sf):
    """Correlations beside a constant column, and over NaN."""
    gap = F.when(F.col("x_quantity") <= 25, F.col("y")).otherwise(float("nan"))
    rows = ly.model_table(spark, sf).select("x_quantity", "y", gap.alias("gap"), F.lit(7.5).alias("level"))
    return aggregates.correlation_matrix(rows, rows.columns).withColumn("r", F.round("r", 6))


@query(
    "target_correlations",
    ly.cte(ly.SCORED)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature, round(corr({a}, {_SCORE}), 6) AS r FROM scored" for a in _PAIR_COLUMNS
    ),
)
def target_correlations(spark, sf):
    found = aggregates.target_correlations(ly.scored_areas(spark, sf), _PAIR_COLUMNS, _SCORE)
    return found.withColumn("r", F.round("r", 6))


@query(
    "linear_trend",
    ly.cte(ly.MODEL)
    + """, fit AS (SELECT regr_slope(y, x_quantity) AS slope, regr_intercept(y, x_quantity) AS intercept,
  min(x_quantity) AS lo, max(x_quantity) AS hi FROM model)
SELECT point, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(lo + (hi - lo) * point / 49e0, 6) AS x,
  round(slope * (lo + (hi - lo) * point / 49e0) + intercept, 6) AS y FROM fit, (SELECT unnest(range(50)) AS point)""",
)
def linear_trend(spark, sf):
    found = aggregates.linear_trend(ly.model_table(spark, sf), "x_quantity", "y")
    return found.withColumns({c: F.round(c, 6) for c in ("slope", "intercept", "x", "y")})


@query(
    "histogram",
    ly.cte(ly.TREES)
    + """, b AS (SELECT min(diameter_breast_height) AS lo, max(diameter_breast_height) AS hi,
  quantile_cont(diameter_breast_height, 0.5) AS median FROM trees)
SELECT CAST(least(floor((diameter_breast_height - lo) / ((hi - lo) / 32)), 31) AS BIGINT) AS bin, count(*) AS n,
  lo + (hi - lo) / 32 * least(floor((diameter_breast_height - lo) / ((hi - lo) / 32)), 31) AS bin_start,
  lo + (hi - lo) / 32 * (least(floor((diameter_breast_height - lo) / ((hi - lo) / 32)), 31) + 1) AS bin_end, median
FROM trees, b WHERE diameter_breast_height IS NOT NULL GROUP BY ALL""",
)
def histogram(spark, sf):
    return aggregates.histogram(ly.trees(spark, sf), "diameter_breast_height", 32)


@query(
    "duplicate_count",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates FROM lineitem",
)
def duplicate_count(spark, sf):
    return aggregates.duplicate_count(ly.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "completeness",
    ly.cte(ly.SCORED)
    + """SELECT count(*) AS total_rows, count(*) FILTER (t AND v AND p) AS complete_rows,
  round(count(*) FILTER (t AND v AND p) / count(*), 9) AS complete_share,
  round((count(*) FILTER (NOT t) + count(*) FILTER (NOT v) + count(*) FILTER (NOT p)) / (3 * count(*)), 9) AS missing_share
FROM (SELECT tree_cover_pct_state IS NOT NULL AS t, vegetation_cover_pct_state IS NOT NULL AS v, population_density IS NOT NULL AS p FROM scored)""",
)
def completeness(spark, sf):
    found = aggregates.completeness(
        ly.scored_areas(spark, sf),
        ["tree_cover_pct_state", "vegetation_cover_pct_state", "population_density"],
    )
    return found.withColumns({c: F.round(c, 9) for c in ("complete_share", "missing_share")})


@query("value_counts", "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark, sf):
    return aggregates.value_counts(ly.table(spark, sf, "documents"), "lang")


@query(
    "layer_ranges",
    ly.cte(ly.SCORED)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS layer, min({c}) AS low, (min({c}) + max({c})) / 2 AS mid, max({c}) AS high, round(avg({c}), 9) AS mean FROM scored"
        for c in [*_PAIR_COLUMNS, _SCORE]
    ),
)
def layer_ranges(spark, sf):
    found = aggregates.layer_ranges(ly.scored_areas(spark, sf), [*_PAIR_COLUMNS, _SCORE])
    return found.withColumn("mean", F.round("mean", 9))


# --- ranking, top-k, sampling ------------------------------------------------


@query(
    "average_rank",
    """SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity AS quantity,
  CAST(floor(rank() OVER (ORDER BY l_quantity DESC) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2e0) AS BIGINT) AS rank
FROM lineitem""",
)
def average_rank(spark, sf):
    lines = ly.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").alias("quantity"),
    )
    return quantiles.average_rank(lines, "quantity", cast="bigint")


@query(
    "first_per_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER
  (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""",
)
def first_per_key(spark, sf):
    lines = ly.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return tb.first_per_key(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_quantity"])


@query(
    "top_k",
    ly.cte(ly.SCORED)
    + f"""SELECT * FROM (SELECT 'hot' AS side, code, {_SCORE} FROM scored WHERE {_SCORE} IS NOT NULL ORDER BY {_SCORE} DESC, code LIMIT 6)
UNION ALL SELECT * FROM (SELECT 'cool' AS side, code, {_SCORE} FROM scored WHERE {_SCORE} IS NOT NULL ORDER BY {_SCORE}, code LIMIT 10)""",
)
def top_k(spark, sf):
    scored = ly.scored_areas(spark, sf).select("code", _SCORE)
    hot = ranking.top_k(scored, _SCORE, 6, tie="code").withColumn("side", F.lit("hot"))
    cool = ranking.top_k(scored, _SCORE, 10, tie="code", ascending=True)
    return hot.unionByName(cool.withColumn("side", F.lit("cool")))


@query(
    "arg_extreme",
    "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_partkey LIMIT 1",
)
def arg_extreme(spark, sf):
    lines = ly.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return ranking.arg_extreme(lines, "l_extendedprice", tie="l_partkey")


@query(
    "sorted_names",
    ly.cte(ly.SCORED)
    + """SELECT name, bool_or(tree_cover_pct_state IS NOT NULL AND vegetation_cover_pct_state IS NOT NULL) AS complete
FROM scored GROUP BY name""",
)
def sorted_names(spark, sf):
    scored = ly.scored_areas(spark, sf)
    every = ranking.sorted_names(scored, "name")
    complete = ranking.sorted_names(
        scored, "name", ["tree_cover_pct_state", "vegetation_cover_pct_state"]
    ).withColumn("complete", F.lit(True))
    return tb.attach(every, complete, "name").fillna({"complete": False})


@query(
    "sample_rows",
    ly.cte(ly.SCORED)
    + "SELECT code, impervious_ratio FROM scored ORDER BY md5(code || ':42'), code LIMIT 300",
)
def sample_rows(spark, sf):
    scored = ly.scored_areas(spark, sf).select("code", "impervious_ratio")
    return ranking.sample_rows(scored, 300, 42, "code")


@query(
    "sort_by_metric",
    "SELECT l_suppkey AS model, round(avg(l_discount), 9) AS rmse FROM lineitem GROUP BY l_suppkey",
)
def sort_by_metric(spark, sf):
    table = ly.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.round(F.avg("l_discount"), 9).alias("rmse")
    )
    return ranking.sort_by_metric(table, "rmse", tie="model")


# --- sets --------------------------------------------------------------------


def _vintages(spark, sf):
    old = ly.table(spark, sf, "orders").select((F.col("o_custkey") * 3).alias("code"))
    new = ly.table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).alias("code"))
    return old, new


_VINTAGES = """WITH old AS (SELECT DISTINCT o_custkey * 3 AS code FROM orders),
new AS (SELECT DISTINCT l_partkey * 2 AS code FROM lineitem),
both_sides AS (SELECT code FROM old INTERSECT SELECT code FROM new)
"""


@query(
    "code_overlap",
    _VINTAGES
    + """SELECT codes_a, codes_b, common, common / codes_a AS share_a, common / codes_b AS share_b FROM (
SELECT (SELECT count(*) FROM old) AS codes_a, (SELECT count(*) FROM new) AS codes_b, (SELECT count(*) FROM both_sides) AS common)""",
)
def code_overlap(spark, sf):
    return tb.code_overlap(*_vintages(spark, sf), "code")


@query("common_codes", _VINTAGES + "SELECT code FROM both_sides")
def common_codes(spark, sf):
    return tb.common_codes(*_vintages(spark, sf), "code")


@query(
    "code_difference",
    _VINTAGES
    + """SELECT code, 'retired' AS change FROM (SELECT code FROM old EXCEPT SELECT code FROM new)
UNION ALL SELECT code, 'new' FROM (SELECT code FROM new EXCEPT SELECT code FROM old)""",
)
def code_difference(spark, sf):
    return tb.code_difference(*_vintages(spark, sf), "code")


@query(
    "union_tiles",
    """SELECT c_custkey AS id, c_mktsegment AS tag, CAST(NULL AS VARCHAR) AS name FROM customer
UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier""",
)
def union_tiles(spark, sf):
    a = ly.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("tag")
    )
    b = ly.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tb.union_tiles([a, b])
