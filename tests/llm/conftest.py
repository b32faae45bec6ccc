from __future__ import annotations

import random

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def planted() -> list[tuple[int, str | None]]:
    """Copies, near copies, shared passages, periodic, empty, null and very long texts."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(160)]
    passage = " ".join(word() for _ in range(60))
    rows: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a b c d")]
    for i in range(7, 27):
        text = list(base)
        for _ in range(i % 7):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    rows += [(i, " ".join(word() for _ in range(40)) + "\n" + passage + "\r\n" + word()) for i in range(27, 35)]
    rows += [(35, "x " * 300), (36, "ab " * 150), (37, "é" * 500), (38, " ".join(base)), (39, " ".join(base))]
    rows.append((40, " ".join(word() for _ in range(20000))))
    rows.append((41, rows[-1][1][:60000]))
    rows += [(i, " ".join(word() for _ in range(3 + i % 5))) for i in range(42, 60)]
    spotted = [rng.choice(["the", "of", "is", word(), word(), word()]) for _ in range(300)]
    for i in range(60, 70):
        text = list(spotted)
        for _ in range(2 * (i % 5)):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    return rows


@pytest.fixture(scope="session")
def rows():
    return planted()


@pytest.fixture(scope="session")
def table_rows():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The planted rows with columns whose names operators might use themselves."""
    data = [(i, t, "xx", "s", len(t or ""), "k", 1) for i, t in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, key string, part int"
    ).repartition(3)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, columns, wanted):
        got = plain(df.select(*columns), *columns)
        assert got == sorted(wanted, key=repr)

    return check
