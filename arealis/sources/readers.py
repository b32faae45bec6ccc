"""Readers: delimited text, GeoJSON, Parquet layers, nested observations."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import quote, urlsplit

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.functions import geometry as g
from arealis.sources.wkb import decode_wkb

_SEPARATORS = (",", ";", "\t", "|")
_BOM = "﻿"


def sniff_separator(header: str) -> str:
    """The candidate that splits the header line most often."""
    return max(_SEPARATORS, key=header.count)


def holds_line_breaks(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether a record may run over a line's end, found by all tasks over the lines as they lie.

    If every line closes the quoted fields it opens, each is a record. A line with a quote
    anywhere but around a field or doubled counts as open.
    """
    near = re.escape(sep)
    paired = F.replace(F.col("value"), F.lit('""'), F.lit(""))
    blank = "[ ]*" if sep == "\t" else "[ \\t]*"
    rest = F.regexp_replace(paired, f'(^|{near}){blank}"[^"]*"{blank}(?={near}|$)', "$1")
    return not spark.read.text(path).where(F.contains(rest, F.lit('"'))).isEmpty()


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    line_breaks: bool | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """Delimited text with a header, its separator found from the first line.

    Columns are matched by header name, so ``schema`` may list a subset in any
    order; a byte-order mark on the first name is dropped. No types are inferred:
    a value that is no value of its type becomes null, and ``seen`` counts those
    (``unread_<column>``). Quoted fields may hold line breaks; as a break then doesn't
    end a record, a file with any is read by one task. Files without are split. Which they are
    is told by a pass over their lines, which ``line_breaks`` spares if it is known.
    """
    header = spark.read.text(path).limit(1).first()[0]
    sep = sniff_separator(header)
    if line_breaks is None:
        line_breaks = holds_line_breaks(spark, path, sep)
    raw = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("enforceSchema", False)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .csv(path)
    )
    named = raw.toDF(*(c.lstrip(_BOM).strip() for c in raw.columns))
    kept = [f for f in schema if f.name in named.columns]
    read = {f.name: F.col(f.name).try_cast(f.dataType) for f in kept}
    if seen is not None:
        lost = [F.count_if(F.col(c).isNotNull() & x.isNull()).alias(f"unread_{c}") for c, x in read.items()]
        named = named.observe(seen, *lost)
    return named.select(*(x.alias(c) for c, x in read.items()))


def from_geojson(text: str) -> Column:
    """A GeoJSON geometry in text form to a geometry column; unreadable text to null.

    ``text`` is the SQL of the column holding it.
    """
    kind = f"get_json_object({text}, '$.type')"
    body = f"get_json_object({text}, '$.coordinates')"

    def read(depth: int) -> str:
        return f"from_json({body}, '{'array<' * depth}double{'>' * depth}')"

    def pairs(coords: str) -> str:
        return f"transform({coords}, c -> {g._point('c[0]', 'c[1]')})"

    def rings(coords: str) -> str:
        return f"transform({coords}, ring -> {pairs('ring')})"

    one = f"transform(array({read(1)}), c -> array({g._point('c[0]', 'c[1]')}))"
    many = f"flatten(transform({read(4)}, member -> {g._orient(rings('member'))}))"
    parts = (
        f"CASE WHEN {kind} = 'Point' THEN {one}"
        f" WHEN {kind} IN ('LineString', 'MultiPoint') THEN array({pairs(read(2))})"
        f" WHEN {kind} = 'MultiLineString' THEN {rings(read(3))}"
        f" WHEN {kind} = 'Polygon' THEN {g._orient(rings(read(3)))}"
        f" WHEN {kind} = 'MultiPolygon' THEN {many} END"
    )
    return g.geometry(kind, parts)


def read_geojson(spark: SparkSession, path: str, properties: T.StructType, lines: bool = False) -> DataFrame:
    """Features to rows with their properties and ``geom``.

    A FeatureCollection is one JSON value without places to cut, so each file is parsed
    by one task, which streams it into one row a feature; the shapes are then dealt
    out and read by all. ``lines=True`` reads one feature per line, which splits.
    """
    feature = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("properties", properties), T.StructField("geometry", T.StringType())]
    )
    if lines:
        rows = spark.read.text(path).select(F.from_json("value", feature).alias("f"))
    else:
        whole = spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))]))
        features = whole.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
        rows = features.repartition(spark.sparkContext.defaultParallelism)
    return rows.select("f.properties.*", from_geojson("f.geometry").alias("geom"))


def read_layer_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, geometry: str = "geometry"
) -> DataFrame:
    """A Parquet layer; a binary ``geometry`` column is decoded once, a struct is used as it is."""
    df = spark.read.parquet(path)
    geom = geometry if geometry in df.columns else "geom"
    if columns is not None:
        df = df.select(*columns, geom)
    if isinstance(df.schema[geom].dataType, T.BinaryType):
        return decode_wkb(df, geom)
    return df.withColumnRenamed(geom, "geom")


def read_layer_dir(spark: SparkSession, root: str) -> DataFrame:
    """One Parquet layer per sub-directory, with its name in ``layer``.

    A layer's first dataset in name order counts, with all its parts; layers without
    any give no rows. A dataset is a file, a directory of part files, or the part
    files that Spark wrote straight into the sub-directory.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(root)
    # what follows the root in the file's path, whichever scheme either is written with
    folder = quote(urlsplit(root.rstrip("/")).path)
    inside = F.split(F.element_at(F.split(F.col("_metadata.file_path"), re.escape(folder) + "/"), -1), "/")
    name = F.when(F.size(inside) == 2, F.regexp_replace(inside[1], r"^(part-)\d.*$", "$1")).otherwise(inside[1])
    tagged = rows.select("*", inside[0].alias("layer"), name.alias("_dataset")).where("_dataset IS NOT NULL")
    first = tagged.groupBy("layer").agg(F.min("_dataset").alias("_dataset"))
    # one short row a layer
    return tagged.join(first, ["layer", "_dataset"], "left_semi").drop("_dataset")


def read_boundaries(
    spark: SparkSession, path: str, region: str, region_col: str = "GCC_NAME21"
) -> DataFrame:
    """Boundary areas of one region; the filter reaches the scan."""
    return in_region(read_layer_parquet(spark, path), region, region_col)


def in_region(boundaries: DataFrame, region: str, region_col: str) -> DataFrame:
    return boundaries.where(F.col(region_col) == region)


# Fields of one weather reading.
OBSERVATION_SCHEMA = (
    "struct<observations:struct<data:array<struct<name:string,wmo:bigint,"
    "local_date_time_full:string,air_temp:double,rel_hum:double,wind_spd_kmh:double>>>>"
)


def read_observations_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The nested weather feed as one typed row per reading.

    A file is one feed and is read by one task; with ``lines=True`` each line is one,
    and files split.
    """
    return explode_observations(spark.read.text(path, wholetext=not lines), "value")


def explode_observations(df: DataFrame, col: str) -> DataFrame:
    rows = df.select(F.explode(F.from_json(col, OBSERVATION_SCHEMA)["observations"]["data"]).alias("r"))
    stamp = F.try_to_timestamp(F.col("r.local_date_time_full"), F.lit("yyyyMMddHHmmss"))
    return rows.select(
        "r.name",
        "r.wmo",
        stamp.cast("timestamp_ntz").alias("local_time"),
        "r.air_temp",
        "r.rel_hum",
        "r.wind_spd_kmh",
    )


def read_keyed_csv(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """A table written by ``write_table_csv``, with its code column kept as text."""
    fields = [
        T.StructField(f.name, T.StringType() if f.name == key else f.dataType) for f in schema
    ]
    return spark.read.schema(T.StructType(fields)).option("header", True).csv(path)
