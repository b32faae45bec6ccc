"""Every registered query against its SQL, over whole tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events"
    " documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    wanted = sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    assert found == wanted
    spark.catalog.clearCache()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_layers_of_the_matrix_are_not_held_in_memory(spark, monkeypatch):
    """Shapes take many times the room of the rows they are made from: kept by every executor, they filled its heap."""
    from workload import spatial

    seen, own = [], spatial.features.feature_matrix
    monkeypatch.setattr(spatial.features, "feature_matrix", lambda layers, *a: seen.append(layers) or own(layers, *a))
    spark.catalog.clearCache()
    assert entry.queries()["feature_matrix_fine"](spark, SF).count() == 400
    (layers,) = seen
    for name in ("trees", "canopy", "vegetation", "buildings", "roads", "parks", "water", "heat", "people"):
        assert not getattr(layers, name).storageLevel.useMemory, name
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
