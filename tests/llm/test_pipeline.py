"""The pipeline against a plain Python version of what each stage decides."""

from __future__ import annotations

import corpus_pipeline
from tests.llm import brute
from tests.llm.conftest import SF


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.kept(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        tables.append({r["doc_id"]: r for r in docs.collect()})
    raw, known, single, clean, safe = tables
    assert set(known) == {i for i, r in raw.items() if r["text"] and any(c.isalpha() for c in r["text"])}
    rows = sorted((i, r["text"]) for i, r in known.items())
    assert set(single) == {i for i, _, c in brute.components(rows) if i == c} and len(single) < len(known)
    rows = sorted((i, r["text"]) for i, r in single.items())
    judged = brute.contaminated(rows, items)
    assert set(clean) == {r[0] for r in judged if not r[2] or 2 * r[2] < r[1]}
    hit = {r[0] for r in judged if r[2]}
    assert all((clean[i]["text"] == single[i]["text"]) == (i not in hit) for i in clean)
    left = brute.contaminated([(i, r["text"]) for i, r in clean.items()], items)
    assert not any(r[2] for r in left)
    assert set(safe) == set(clean)
    found = {r[0] for r in brute.personal([(i, r["text"]) for i, r in clean.items()]) if r[6]}
    assert all(safe[i]["text"] != clean[i]["text"] and safe[i]["n_chars"] == len(safe[i]["text"]) for i in found)
    left = brute.personal([(i, r["text"]) for i, r in safe.items()])
    assert found and not any(r[6] for r in left)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    sizes = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["n_words"]
    assert sizes == {i: len(brute.WORDS.findall(r["text"].encode())) for i, r in safe.items()}


def test_queries_have_operators():
    import __spark_entry__ as entry

    names = {x.split("_")[0] for x in entry.queries() if x.startswith("op") and x[2].isdigit()}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
