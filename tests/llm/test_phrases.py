"""Collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from arealis.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, size=3, least=10, inside=50, top=2000):
    """(lang, text) to the rows of a result."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).decode()
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, size + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in often.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        found = []
        for p, a in often.items():
            if p in most and 100 * most[p] >= inside * a:
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, own[p[:k]], own[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -s))
    return out


def planted():
    rng = random.Random(3)
    base = [f"w{i}" for i in range(30)] + ["É", "ß", "new york", "ice cream van", "a-b", "Per Cent"]
    rows = []
    for i in range(300):
        words = [rng.choice(base[: 12 + i % 25]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for w in words)
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    rows += [("en", None), (None, ""), ("xx", " ., "), ("en", "single")]
    # without an end of a piece, and with many; a hot pair with all sorts of words after it
    rows.append(("de", " ".join(rng.choice(base) for _ in range(200_000))))
    rows.append(("en", ". ".join(" ".join(rng.choice(base) for _ in range(40)) for _ in range(6000))))
    rows += [("en", f"hot pair {rng.choice('abcdef')}{rng.randrange(40)} end") for _ in range(800)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    rows = planted()
    data = [(i, lang, text, 1, 2, "x") for i, (lang, text) in enumerate(rows)]
    return rows, spark.createDataFrame(data, "doc_id long, lang string, text string, n long, w1 long, words string").repartition(5)


@pytest.mark.parametrize("arguments", [{}, {"size": 2, "least": 3}, {"size": 4, "least": 5, "inside": 80, "top": 25}])
def test_collocations(frame, same, arguments):
    rows, df = frame
    wanted = brute(rows, **arguments)
    assert len(wanted) > 50
    same(phrases.collocations(df, **arguments), COLUMNS, wanted)


def test_frequent_prefixes_and_small_buffers_change_nothing(frame, same, monkeypatch):
    rows, df = frame
    found = phrases._frequent
    monkeypatch.setattr(phrases, "SAMPLE", 1.0)
    monkeypatch.setattr(phrases, "HELD", 20_000)
    monkeypatch.setattr(phrases, "BUCKETS", 64)
    hot = []
    monkeypatch.setattr(phrases, "_frequent", lambda *a: hot.append(found(*a)) or hot[0])
    same(phrases.collocations(df), COLUMNS, brute(rows))
    assert len(hot[0]) > 10


def test_nothing_to_count(spark):
    df = spark.createDataFrame([(1, "en", None), (2, None, "a b")], "doc_id long, lang string, text string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(df.limit(0)).columns == COLUMNS


def test_padding_keeps_the_counts_of_all_shorter_phrases():
    rng = np.random.default_rng(2)
    lang, window = rng.integers(0, 2, 4000), rng.integers(1, 9, (3, 4000)).astype(np.uint64)
    window[2, rng.random(4000) < 0.2] = phrases.PAD
    window[1:, rng.random(4000) < 0.1] = phrases.PAD
    lang, window, n, _ = phrases._counted(lang, window, np.ones(4000, np.int64))
    assert n.sum() == 4000
    for least in (1, 5, 30, 10_000):
        parts = list(phrases._padded(lang, window, n, np.ones(len(n), np.int64), least))
        out = [np.concatenate([p[i] for p in parts], axis=-1) for i in range(3)]
        for k in range(4):
            def sums(lang, window, n):
                c = Counter()
                for own, w, x in zip(lang.tolist(), window[:k].T.tolist(), n.tolist(), strict=True):
                    if 0 not in w:
                        c[own, *w] += x
                return {p: x for p, x in c.items() if x >= least or k == 0}  # noqa: B023

            assert sums(*out) == sums(lang, window, n)
