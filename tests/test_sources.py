from __future__ import annotations

import json
import struct

from pyspark.sql import Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.functions import geometry as g
from arealis.plans import cleaning
from arealis.sources import readers, wkb, writers
from tests.shapes import HOLED, box, layer

SCHEMA = T.StructType([T.StructField("code", T.StringType()), T.StructField("x", T.DoubleType())])


def test_delimited_sniffs_and_strips_mark(spark, tmp_path):
    for i, sep in enumerate([",", ";", "\t"]):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"﻿code{sep}note{sep}x\n007{sep}hi{sep}1.5\n008{sep}yo{sep}bad\n", encoding="utf-8")
        rows = readers.read_delimited(spark, str(path), SCHEMA).collect()
        assert [(r.code, r.x) for r in rows] == [("007", 1.5), ("008", None)]


def test_geojson_collection_of_every_kind(spark, tmp_path):
    square = [[list(p) for p in r] for r in box(0, 0, 4, 4)]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    shapes = {
        "point": {"type": "Point", "coordinates": [1, 2]},
        "line": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]},
        "lines": {"type": "MultiLineString", "coordinates": [[[0, 0], [3, 4]], [[0, 0], [1, 0]]]},
        "holed": {"type": "Polygon", "coordinates": [square[0][::-1], hole]},
        "multi": {"type": "MultiPolygon", "coordinates": [[square[0], hole], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]},
        "none": None,
    }
    features = [{"type": "Feature", "properties": {"id": k}, "geometry": s} for k, s in shapes.items()]
    path = tmp_path / "all.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = readers.read_geojson(spark, str(path), T.StructType([T.StructField("id", T.StringType())]))
    rows = {r.id: (r.k, r.a, r.l) for r in df.select("id", F.col("geom.kind").alias("k"), g.area("geom").alias("a"), g.length("geom").alias("l")).collect()}
    assert rows["point"] == ("Point", 0.0, 0.0)
    assert rows["line"] == ("LineString", 0.0, 5.0)
    assert rows["lines"] == ("MultiLineString", 0.0, 6.0)
    assert rows["holed"][:2] == ("Polygon", 15.0)
    assert rows["multi"][:2] == ("MultiPolygon", 15.5)
    assert rows["none"][0] is None

    back = writers.geojson_lines(df.where("geom IS NOT NULL")).collect()
    kept = {json.loads(r.value)["properties"]["id"]: json.loads(r.value)["geometry"] for r in back}
    assert len(kept["multi"]["coordinates"]) == 2
    assert len(kept["multi"]["coordinates"][0]) == 2
    assert kept["line"]["coordinates"] == [[0, 0], [3, 4]]


def test_wkb_round_trip_and_big_endian(spark, tmp_path):
    df = layer(spark, [("a", HOLED)])
    path = writers.write_layer(df, str(tmp_path / "layer"), wkb=True)
    back = readers.read_layer_parquet(spark, path)
    assert back.select("geom").first() == df.select("geom").first()
    big = struct.pack(">BI", 0, 2) + struct.pack(">I", 2) + struct.pack(">dddd", 0, 1, 2, 3)
    read = lambda raw: (wkb.read_wkb(raw)[0], [p.tolist() for p in wkb.read_wkb(raw)[1]])
    assert read(big) == ("LineString", [[[0.0, 1.0], [2.0, 3.0]]])
    with_height = struct.pack("<BI", 1, 1001) + struct.pack("<ddd", 1, 2, 3)
    assert read(with_height) == ("Point", [[[1.0, 2.0]]])
    with_srid = struct.pack("<BII", 1, 1 | 0x20000000, 4326) + struct.pack("<dd", 1, 2)
    assert read(with_srid) == ("Point", [[[1.0, 2.0]]])
    mixed = layer(spark, [("a", HOLED), ("b", box(0, 0, 1, 1))]).unionByName(
        layer(spark, [("m", [[(1, 2)], [(3, 4)]])], kind="MultiPoint")
    ).unionByName(layer(spark, [("l", [[(0, 0), (1, 1)], [(2, 2), (3, 3), (4, 5)]])], kind="MultiLineString"))
    mixed = mixed.unionByName(mixed.limit(1).withColumns({"id": F.lit("none"), "geom": F.lit(None).cast(g.GEOM_TYPE)})).coalesce(1)
    again = readers.read_layer_parquet(spark, writers.write_layer(mixed, str(tmp_path / "mixed"), wkb=True))
    want = {r.id: r.geom for r in mixed.collect()}
    found = {r.id: r.geom for r in again.collect()}
    flat = lambda geom: geom and [(p.x, p.y) for part in geom.parts for p in part]
    assert {k: flat(v) for k, v in found.items()} == {k: flat(v) for k, v in want.items()}


def test_layer_dir_takes_first_file(spark, tmp_path):
    for name, value in (("b/2", 2), ("b/1", 1), ("a/1", 7)):
        spark.range(value, value + 1).coalesce(1).write.parquet(str(tmp_path / "made" / name))
    root = tmp_path / "root"
    for name in ("a", "b", "empty"):
        (root / name).mkdir(parents=True)
    for name in ("b/2", "b/1", "a/1"):
        part = next((tmp_path / "made" / name).glob("*.parquet"))
        (root / f"{name}.parquet").write_bytes(part.read_bytes())
    rows = readers.read_layer_dir(spark, str(root)).collect()
    assert {(r.layer, r.id) for r in rows} == {("a", 7), ("b", 1)}


def test_codes_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("0123", 1.5)], SCHEMA)
    path = writers.write_table_csv(df, str(tmp_path / "csv"))
    assert readers.read_keyed_csv(spark, path, "code", SCHEMA).first().code == "0123"


def test_boundary_filter_reaches_the_scan(spark, tmp_path):
    path = writers.write_layer(layer(spark, [("a", "R", box(0, 0, 1, 1))], "id string, region string"), str(tmp_path / "b"))
    plan = readers.read_boundaries(spark, path, "R", "region")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(region,R)" in plan


def test_observations(spark, tmp_path):
    reading = {"name": "Park", "wmo": 95936, "local_date_time_full": "20240102030400", "air_temp": 21.5, "rel_hum": 40, "wind_spd_kmh": None}
    path = tmp_path / "obs.json"
    path.write_text(json.dumps({"observations": {"data": [reading, {**reading, "local_date_time_full": "soon"}]}}, indent=1))
    rows = readers.read_observations_json(spark, str(path)).collect()
    assert str(rows[0].local_time) == "2024-01-02 03:04:00"
    assert (rows[0].air_temp, rows[1].local_time) == (21.5, None)


def test_street_map_cleaning(spark):
    roads = layer(spark, [(["a", "b"], "['residential' 'service']", 1, box(0, 0, 1, 1)[0:1])], "osmid array<string>, highway string, junk int", "LineString")
    clean = cleaning.clean_osm({"roads": roads}, grid=None)["roads"]
    row = clean.first()
    assert (row.osmid, row.highway) == ("a;b", "residential;service")
    assert "junk" not in clean.columns


OPEN = ['"a', 'x,"a', 'x, "a', '5" pipe,"start', '"abc""', '"""abc', '"a,""b', 'in 5" here', '"a"b,"c']
CLOSED = ["a,b", '"a","b"', '"a, ""b"" c",d', '"",""', '"""a"""', ',"",', ' "a" ,b', '"\'",x', '"a\\"', "", '"' + '{""k"":1,' * 5000 + '"']


def test_lines_that_leave_a_field_open(spark, tmp_path):
    for i, (line, want) in enumerate([(x, True) for x in OPEN] + [(x, False) for x in CLOSED]):
        path = tmp_path / f"{i}.csv"
        path.write_text(f"a,b\n{line}\n1,2\n")
        assert readers.holds_line_breaks(spark, str(path), ",") is want, line
    for sep, name in (("|", "bar"), ("\t", "tab")):
        path = tmp_path / f"{name}.csv"
        path.write_text(f'a{sep}b\n"x{sep}y"{sep}"z"\n')
        assert not readers.holds_line_breaks(spark, str(path), sep)
        path.write_text(f'a{sep}b\nx{sep}"z\nw"\n')
        assert readers.holds_line_breaks(spark, str(path), sep)


def test_files_without_line_breaks_are_split(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = [(i, f'say "{i}", again') for i in range(20_000)]
    text = "a,b\n" + "".join(f'{a},"{b.replace(chr(34), chr(34) * 2)}"\n' for a, b in rows)
    plain, broken = tmp_path / "plain.csv", tmp_path / "broken.csv"
    plain.write_text(text)
    broken.write_text(text + '-1,"two\nlines"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        split, whole = (readers.read_delimited(spark, str(p), schema) for p in (plain, broken))
        assert split.rdd.getNumPartitions() > 4 and whole.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, split.collect())) == rows
        assert sorted(map(tuple, whole.collect())) == [(-1, "two\nlines"), *rows]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_delimited_keeps_line_breaks_and_counts_what_it_can_not_read(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('code,x\n1,"2.5"\n"a\nb",7\n"say ""hi""",bad\n')
    seen = Observation("seen")
    rows = readers.read_delimited(spark, str(path), SCHEMA, seen=seen).collect()
    assert [tuple(r) for r in rows] == [("1", 2.5), ("a\nb", 7.0), ('say "hi"', None)]
    assert seen.get == {"unread_code": 0, "unread_x": 1}


def test_features_without_shape_or_values(spark):
    df = layer(spark, [("a", HOLED)]).withColumns({"geom": F.lit(None).cast(g.GEOM_TYPE), "n": F.lit(None).cast("int")})
    value = json.loads(writers.geojson_lines(df).first().value)
    assert value == {"type": "Feature", "properties": {"id": "a", "n": None}, "geometry": None}


def test_layer_dir_reads_all_parts_of_the_first_dataset(spark, tmp_path):
    root = tmp_path / "some layers"
    spark.range(100).repartition(4).write.parquet(str(root / "one"))
    spark.range(30).repartition(3).write.parquet(str(root / "two" / "a.parquet"))
    spark.range(50).coalesce(1).write.parquet(str(root / "two" / "b.parquet"))
    found = {r.layer: r["count"] for r in readers.read_layer_dir(spark, str(root)).groupBy("layer").count().collect()}
    assert found == {"one": 100, "two": 30}


def test_quality_counts_nan(spark):
    from arealis.plans import quality

    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert quality.layer_quality_report(spark, {"a": df}).first().missing_values == 2


def test_collections_grow_in_number_with_the_features(spark, tmp_path):
    made = layer(spark, [(str(i), box(i, 0, i + 1, 1)) for i in range(300)])
    path = writers.write_geojson_collections(made, str(tmp_path / "many"), features=30)
    files = [json.loads(p.read_text()) for p in (tmp_path / "many").glob("file=*/*.txt")]
    assert len(files) == 10 and all(x["type"] == "FeatureCollection" for x in files)
    assert sorted(int(f["properties"]["id"]) for x in files for f in x["features"]) == list(range(300))
    back = readers.read_geojson(spark, path, made.select("id").schema)
    assert {(r.id, r.x) for r in back.select("id", "geom.xmin").withColumnRenamed("xmin", "x").collect()} == {(str(i), float(i)) for i in range(300)}
