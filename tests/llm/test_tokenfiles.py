"""Packed token files against the tokenizer's own output."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arealis.llm import tokenfiles

COLUMNS = ["doc_id", "start", "n_tokens", "ids_crc32"]
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


class Memory(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


class Kept(io.BytesIO):
    def close(self):
        pass


def brute(rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    docs = [(i, np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in rows]
    docs = [(i, len(x), zlib.crc32(x.tobytes())) for i, x in docs]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, d[2], d[1]))
    out, at = [], 0
    for i, n, crc in docs:
        out.append((i, at, n, crc))
        at += n
    return out


def test_token_files(docs, rows, same):
    files = tokenfiles.token_files(docs, PATH).cache()
    same(tokenfiles.contents(files), COLUMNS, brute(rows))
    assert sum(r["n_docs"] for r in files.collect()) == len(rows)


def test_odd_rows(spark, same):
    rows = [(None, "a"), (5, "b c"), (5, "b c"), (5, ""), (5, None), (None, None), (7, "x" * 5000), (8, "<|endoftext|>Déjà vú ́x")]
    long = " ".join(f"Word{i} it's {i} näive, <|startoftext|> ́ and so on" for i in range(30_000))
    rows += [(9, long), (10, long.replace(" ", "")[:300_000]), (11, " " * 200_000 + "z")]
    df = spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "doc_id long, text string, part int, ids string, n long")
    same(tokenfiles.contents(tokenfiles.token_files(df, PATH)), COLUMNS, brute(rows))
    assert tokenfiles.contents(tokenfiles.token_files(df.limit(0), PATH)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBzÀéßİʼ'sStd,.;:!?<|>- \t\n\u00a0\u0301\u0327\u3000١9中ǅ"), max_size=40) | st.sampled_from(["<|endoftext|>", "it's.", "Ǆe,", "e\u0301."]), max_size=8))
def test_words_encode_as_whole_texts_do(parts):
    texts = ["".join(parts), *parts, None]
    with open(PATH, encoding="utf-8") as f:
        lookup = tokenfiles.Lookup(f.read())
    own = lookup.own
    got = []
    for _, _, ids, n in tokenfiles.encoded(pa.array(texts, pa.string()), lookup):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [own.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_files_of_lost_tasks_are_not_read(spark, tmp_path, same):
    rows = [(i, f"text {i}") for i in range(20)]
    files = tokenfiles.token_files(spark.createDataFrame(rows, "doc_id long, text string"), PATH, folder=str(tmp_path)).cache()
    files.count()
    (tmp_path / "part-000000-lost.ids").write_bytes(b"half a file")
    same(tokenfiles.contents(files), COLUMNS, brute(rows))


def test_random_access(spark, tmp_path, table_rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    df = spark.createDataFrame(table_rows, "doc_id long, text string")
    files = tokenfiles.token_files(df, PATH, end=None, folder=f"file://{tmp_path}").orderBy("part").collect()
    text = dict(table_rows)
    for f in files:
        store, at = fs.FileSystem.from_uri(f["path"])
        file = tokenfiles.Reader(store.open_input_file(at))
        assert file.width == 16 and len(file.ids) == f["n_docs"] and file.n == f["n_ids"]
        for k in range(0, len(file.ids), 7):
            ids = own.encode(text[int(file.ids[k])] or "", add_special_tokens=False).ids
            assert file.document(k).tolist() == ids
            a = int(file.starts[k])
            assert file.read(a + 2, a + 5).tolist() == [*ids, *file.read(a + len(ids), a + 9).tolist()][2:5]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=300), max_size=6), st.sampled_from([64, 128]))
def test_round_trip_of_every_width(width, lists, block):
    sink = Kept()
    writer = tokenfiles.Writer(sink, width, block)
    docs = [np.array(x, np.uint32) & np.uint32((1 << width) - 1) for x in lists]
    for i, x in enumerate(docs):
        writer.add(None if i == 1 else -i, x)
    writer.close()
    file = tokenfiles.Reader(Memory(sink.getvalue()))
    assert [file.document(k).tolist() for k in range(len(docs))] == [x.tolist() for x in docs]
    assert file.given.tolist() == [i != 1 for i in range(len(docs))] and file.ids.tolist() == [0 if i == 1 else -i for i in range(len(docs))]
    assert len(sink.getvalue()) <= 64 + (file.n + 64) * width / 8 + 8 * (file.n // block + 2) + 17 * len(docs) + 8


def test_runs_hold_long_documents_in_pieces(monkeypatch):
    monkeypatch.setattr(tokenfiles, "RUN", 100)
    sink = Kept()
    writer = tokenfiles.Writer(sink, 9, 64)
    for n in (0, 5, 350, 0, 60, 60, 0):
        writer.add(n, np.arange(n, dtype=np.uint32))
    writer.close()
    file = tokenfiles.Reader(Memory(sink.getvalue()))
    assert [(k, j, len(x)) for k, j, x in file.runs()] == [(0, 2, 5), (2, 3, 100), (2, 3, 100), (2, 3, 100), (2, 3, 50), (3, 5, 60), (5, 7, 60)]


def test_ids_that_do_not_fit_are_refused():
    with pytest.raises(ValueError):
        tokenfiles.Writer(Kept(), 4).add(1, np.array([16], np.uint32))
    assert [tokenfiles.width_of(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]
