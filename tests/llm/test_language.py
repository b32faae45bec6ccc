"""Language identification: held-out accuracy and the cases without an answer."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import functions as F

from arealis.llm import language
from arealis.llm.text import utf8

SCHEMA = "doc_id long, text string, lang string, score string, held_out int"


def test_held_out_documents_are_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.identify(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(out) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    unseen = [r for r in out if r["held_out"]]
    assert len(unseen) > 200 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_training_starts_no_workers_for_lists(spark, monkeypatch):
    """A table made of a list of rows goes through Python workers that no other step uses."""
    rows = [(t, lang) for i in range(20) for t, lang in ((f"der hund und das haus {i}", "de"), (f"the dog and the house {i}", "en"))]
    rows += [("le chien \u00e9t\u00e9", "fr'\u00df"), ("...", "none")]
    labelled = spark.createDataFrame(rows, "text string, lang string")

    def refuse(*_, **__):
        raise AssertionError("a list is sent to Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert language.fit(labelled).languages == ["de", "en", "fr'\u00df"]


def test_texts_without_an_answer(spark):
    rows = [(i, "the cat and the dog of the house", "en", "s", 1) for i in range(30)]
    rows += [(100 + i, "le chat et le chien de la maison", "fr", "s", 1) for i in range(30)]
    rows += [(200, None, "en", "s", 1), (201, "", None, None, None), (202, "12 !? ...", "en", None, 1), (None, "the house", None, None, 0), (203, "le chien", None, None, 0)]
    rows += [(204, "la maison " * 20000, None, None, 0), (204, "la maison " * 20000, None, None, 0)]
    found = {}
    for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert [found[i][0] for i in (200, 201, 202)] == [("und", 0.0)] * 3
    assert found[None][0][0] == "en" and found[203][0][0] == "fr"
    assert [x[0] for x in found[204]] == ["fr", "fr"] and found[204][0] == found[204][1]
    empty = spark.createDataFrame([], SCHEMA)
    assert language.identify(empty).count() == 0
    unlabelled = spark.createDataFrame(rows, SCHEMA).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    kept = language.filtered(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "score", "held_out"]
    assert kept.count() == len(rows) - 3


def test_more_labels_than_there_is_room_for_many_texts_of_each(spark, monkeypatch):
    rng = random.Random(4)
    words = {k: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(rng.randint(2, 6))) for _ in range(12)] for k in range(70)}
    rows = [(f"l{k:02}", " ".join(rng.choice(w) for _ in range(30))) for k, w in words.items() for _ in range(2 if k == 69 else 8)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(language, "SAMPLES", 350)
    monkeypatch.setattr(language, "MARKS", 100)
    model = language.fit(df)
    assert len(model.languages) == 70 and len(model.landmarks) == 100
    new = [(f"l{k:02}", " ".join(rng.choice(w) for _ in range(40))) for k, w in words.items()]
    out = language.predict(spark.createDataFrame(new, "lang string, text string"), model, ["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 68


def test_another_script_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IN ('en', 'de')").select("doc_id", "text", "lang")
    other = ["съешь же ещё этих мягких французских булок", "漢字かな交じり文を書く", "γειά σου κόσμε αυτό είναι ένα κείμενο"]
    more = spark.createDataFrame([(-1 - i, " ".join(x.split()[k:] + x.split()), None) for i, x in enumerate(other) for k in range(5)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.filtered(docs.unionByName(more)).select("doc_id").collect()}
    with_letters = {r["doc_id"] for r in docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert kept == with_letters


def test_presence_is_the_set_of_grams():
    texts = ["Abba b", "", "é É", "a-b"]
    x, n = language.presence(*utf8(pa.array(texts)))
    assert n.tolist() == [5, 0, 2, 2]
    sizes = [[len({t[i : i + k] for i in range(len(t) - k + 1)}) for k in (1, 2, 3, 4)] for t in ("abba b", "", "é é", "a b")]
    at = 0
    for j, width in enumerate(language.WIDTHS.values()):
        found = (x[:, at : at + width] > 0).sum(axis=1)
        assert all(found[i] == sizes[i][j] for i in range(4))
        norms = np.linalg.norm(x[:, at : at + width], axis=1)
        assert np.allclose(norms[found > 0], 1)
        at += width


def test_a_row_does_not_depend_on_its_neighbours():
    alone = language.presence(*utf8(pa.array(["so weit"])))[0][0]
    for before, after in (("x", " y"), ("x", "y"), (".", "."), ("", "")):
        assert (language.presence(*utf8(pa.array([before, "so weit", after])))[0][1] == alone).all()
