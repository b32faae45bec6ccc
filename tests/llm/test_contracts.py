"""Operators against plain Python, on planted rows and on a whole small table."""

from __future__ import annotations

import hashlib
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arealis.llm import decontaminate, jaccard, packing, pii, sharding, spotsigs, substrings, suffixes
from tests.llm import brute
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_sharding(docs, rows, table, table_rows, same):
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    same(sharding.by_bytes(docs), columns, brute.sharded(rows))
    same(sharding.by_bytes(table), columns, brute.sharded(table_rows))


def test_sharding_of_repeated_and_null_ids(spark, same):
    rows = [(None, "a"), (5, "b")] + [(5, "c" * 50)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(sharding.by_bytes(df), ["doc_id", "size", "text_crc32", "shard", "slot"], brute.sharded(rows))
    assert sharding.by_bytes(df.limit(0)).count() == 0


def test_spot_signatures(docs, rows, table, table_rows, same):
    for df, own in ((docs, rows), (table, table_rows)):
        out = spotsigs.edited(df)
        same(out, ["doc_id", "n_chars", "edited_sha256"], brute.edited(own))
        got = out.collect()
        text = dict(own)
        by_text = {}
        for r in got:
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            assert by_text.setdefault(text[r["doc_id"]] or "", r["fingerprint"]) == r["fingerprint"]
    long = [r for r in got if r["n_chars"] > 600]
    assert sum(r["near_edited"] for r in long) > 3 * sum(r["near_next"] for r in long)


def test_spot_signatures_of_few_rows(spark):
    df = spark.createDataFrame([(1, "the cat sat on a mat")], "doc_id long, text string")
    assert [r["near_next"] for r in spotsigs.edited(df).collect()] == [1.0]
    assert spotsigs.edited(df.limit(0)).count() == 0
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id long, text string")
    assert spotsigs.edited(ties).count() == 4


def test_spot_pairs(docs, rows):
    members, pairs = spotsigs.near_pairs(docs, 0.75)
    sets = {r["doc_id"]: frozenset(r["sigs"]) for r in spotsigs.fingerprints(docs).collect()}
    least = {}
    for i, s in sets.items():
        least[s] = min(i, least.get(s, i))
    assert {r["doc_id"]: r["class"] for r in members.collect()} == {i: least[s] for i, s in sets.items()}
    wanted = {
        (min(i, j), max(i, j))
        for a, i in least.items()
        for b, j in least.items()
        if i < j and a and len(a & b) >= 0.75 * len(a | b)
    }
    assert {(r["class_a"], r["class_b"]) for r in pairs.collect()} == wanted and wanted


def test_decontamination(spark, docs, rows, table, table_rows, same):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    wanted = brute.contaminated(table_rows, items)
    assert any(r[2] for r in wanted) and not all(r[2] for r in wanted)
    same(decontaminate.contamination(table, bench), columns, wanted)
    own = [(1, "One"), (2, None), (3, "b c d"), (4, rows[30][1]), (5, rows[30][1]), (6, "x " * 12), (7, "!!")]
    small = spark.createDataFrame(own, "item_id long, text string")
    same(decontaminate.contamination(docs, small), columns, brute.contaminated(rows, own))
    assert decontaminate.contamination(docs, small.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), small).count() == 0


def test_blocks_of_the_benchmark_give_the_same_hits(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = sorted(decontaminate.contamination(docs, bench).collect())
    blocks = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w, k: blocks(b, w, k, size=2000))
    assert sorted(decontaminate.contamination(docs, bench).collect()) == whole


def test_a_large_benchmark_is_joined_not_sent(spark, docs, rows, same, monkeypatch):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    own = [(1, "One"), (2, None), (3, "b c d"), (4, rows[30][1]), (5, rows[30][1]), (6, "x " * 12), (7, "!!"), (8, "a b c d")]
    own += [(i, rows[i][1]) for i in range(9, 20)]
    bench = spark.createDataFrame(own, "item_id long, text string")
    blocks, send, sent = decontaminate.blocks, type(spark.sparkContext).broadcast, []
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w, k: blocks(b, w, k, size=100))
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value) or send(self, value))
    copies = docs.unionByName(docs.where("doc_id in (0, 30, 35)"))
    again = [r for r in rows if r[0] in (0, 30, 35)]
    wanted = brute.contaminated(rows, own)
    same(decontaminate.contamination(copies, bench), columns, wanted + [r for r in wanted if r[0] in dict(again)])
    assert not any(isinstance(x, decontaminate.Block) for x in sent)
    cut = sorted(decontaminate.cleaned(docs, bench).select("doc_id", "text", "n_chars").collect())
    monkeypatch.undo()
    assert cut == sorted(decontaminate.cleaned(docs, bench).select("doc_id", "text", "n_chars").collect()) and cut


def test_decontaminated_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, f"before it {item}, and this is what stands after the passage for a while", 5), (2, item, 5), (3, None, 5), (4, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    out = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(docs, bench).collect()}
    assert out == {1: "before it , and this is what stands after the passage for a while", 3: None, 4: "clean"}


def test_passages_are_cut_in_one_python_pass(spark, docs, monkeypatch):
    """Two passes in a stage hold two Python workers a task, and the pool keeps them."""
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    blocks = decontaminate.blocks
    for size in (decontaminate.BLOCK, 0):
        monkeypatch.setattr(decontaminate, "blocks", lambda b, w, k, size=size: blocks(b, w, k, size=size))
        plan = decontaminate.cleaned(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1


def test_repeated_words(docs, rows, table, table_rows, same):
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    for df, own in ((docs, rows), (table, table_rows)):
        wanted = brute.repeated_words(own)
        assert any(r[2] for r in wanted) and not all(r[2] for r in wanted)
        same(substrings.deduplicated(df), columns, wanted)


def test_frequent_windows_change_nothing(docs, rows, same, monkeypatch):
    monkeypatch.setattr(substrings, "SAMPLE", 1.0)
    monkeypatch.setattr(substrings, "SEEN", 2)
    same(substrings.deduplicated(docs), ["doc_id", "n_words", "n_removed", "kept_sha256"], brute.repeated_words(rows))


def test_repeated_words_of_repeated_rows(spark, same):
    rows = [(1, "w " * 40), (1, "w " * 40), (None, " ".join(map(str, range(50)))), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    same(substrings.deduplicated(df), columns, brute.repeated_words(rows))
    assert substrings.deduplicated(df.limit(0)).count() == 0


def test_repeated_bytes(docs, rows, table, table_rows, same):
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for df, own in ((docs, rows), (table, table_rows)):
        wanted = brute.repeated_bytes(own)
        assert any(r[2] for r in wanted) and not all(r[2] for r in wanted)
        same(suffixes.deduplicated(df), columns, wanted)


def test_frequent_minimisers_change_nothing(docs, rows, same, monkeypatch):
    monkeypatch.setattr(suffixes, "SAMPLE", 1.0)
    monkeypatch.setattr(suffixes, "SEEN", 2)
    same(suffixes.deduplicated(docs), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], brute.repeated_bytes(rows))


def test_repeated_bytes_of_repeated_rows(spark):
    text = "".join(chr(33 + i % 90) for i in range(0, 4000, 7))
    df = spark.createDataFrame([(5, text), (5, text), (7, text), (None, "q" * 99), (9, text[:99])], "doc_id long, text string")
    out = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.deduplicated(df).collect())
    own = brute.repeated_bytes([(5, text)])[0][2]
    assert out == [(0, 0), (5, own), (5, own), (7, len(text)), (9, 0)]
    assert suffixes.deduplicated(df.limit(0)).count() == 0


def test_repeated_bytes_of_texts_with_equal_short_tags(spark, same):
    # the lowest 40 bits of the 64-bit hashes of these two are equal
    one, two = (hashlib.sha512(str(i).encode()).hexdigest() for i in (1086763, 1443694))
    rows = [(1, one), (2, two), (3, "before " + two + " after"), (4, two + one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert df.selectExpr(f"xxhash64(text) & {(1 << 40) - 1} as tag").distinct().count() == 3
    wanted = brute.repeated_bytes(rows)
    assert [r[2] for r in wanted] == [0, 0, 128, 256]
    same(suffixes.deduplicated(df), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], wanted)


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(3)
    texts = [b"", b"a", b"aaaaaa", b"abracadabra", b"mississippi" * 5, b"\x00\x00\xff\x00", bytes(rng.integers(97, 99, 500).astype(np.uint8))]
    texts += [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (2, 3, 50, 400)]
    for raw in texts:
        data = np.frombuffer(raw, np.uint8)
        sa = suffixes.suffix_array(data)
        assert sa.tolist() == sorted(range(len(raw) + 1), key=lambda i: raw[i:])
        prefix = suffixes.common_prefixes(data, sa)
        for a, b in zip(sa, sa[1:], strict=False):
            n = 0
            while a + n < len(raw) and b + n < len(raw) and raw[a + n] == raw[b + n]:
                n += 1
            assert prefix[b] == n


PERSONAL = [
    (1, "mail a.b+c@x-y.example.com, or a@b.c_d@e.f and q@w.e@r.t"),
    (2, "é 1.2.3.4 256.1.1.1 001.002.003.004 1.2.3.4.5.6.7.8 99999999999999999999.1.1.1"),
    (3, "cards 4111 1111 1111 1111, 4111111111111112, 4984250489669609 and 5-5-5"),
    (4, "call +1 (988) 555-2485 or +44 20 7946 0958 or +1 2 or +"),
    (5, "+1 (525) 555-3296 4524132264652876 together"),
    (6, None),
    (7, ""),
    (8, "9" * 30000),
    (9, "a" * 30000),
    (10, "x@" * 5000 + " (((" * 2000),
    (11, "a@b.co " * 400),
    (5, "+1 (525) 555-3296 4524132264652876 together"),
]


def test_personal_data_base(spark, docs, rows, table, table_rows, same):
    columns = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    own = spark.createDataFrame(PERSONAL, "doc_id long, text string")
    for df, plain_rows in ((own, PERSONAL), (docs, rows), (table, table_rows)):
        same(pii.spans(df), columns, [r[:6] for r in brute.personal(plain_rows)])
    assert pii.spans(own.limit(0)).count() == 0


def test_personal_data_adds_what_a_failed_match_swallowed(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = spark.createDataFrame([(-1, PERSONAL[4][1]), (-2, "a clean text of 12 words")], "doc_id long, text string")
    out = {r["doc_id"]: r["spans"] for r in pii.spans(table.select("doc_id", "text").unionByName(more)).where("doc_id < 0").collect()}
    assert out == {-1: "card:18:34,phone:0:17", -2: ""}


def test_personal_data_is_learned_from_all_matches(spark):
    """A kind that stands in the last documents by hash only is learned, too, and sets a threshold."""
    text = F.concat(F.lit("call 10.0.0."), F.col("id") % 256, F.lit(" or 300.1.1."), F.col("id"), F.lit(" now"))
    many = spark.range(30_000).select(text.alias("text"))
    last = many.agg(F.max(F.shiftrightunsigned(F.xxhash64("text"), 1))).first()[0] * 0.9
    mails = spark.range(3000).select(F.concat(F.lit("write to n"), "id", F.lit("@m.de")).alias("text"))
    mails = mails.where(F.shiftrightunsigned(F.xxhash64("text"), 1) > F.lit(last))
    assert mails.count() > 50
    assert set(pii.fit(many.unionByName(mails)).thresholds) == {"email", "ip"}


def test_runs_of_overlapping_spans(spark):
    rows = [(s, s + n, (r, 0), 1) for s, n, r in ((0, 5, 0.9), (4, 6, 0.95), (9, 3, 0.97), (12, 2, 0.5), (13, 4, 0.4), (20, 1, 0.1))]
    kind = "array<struct<s:int,e:int,rank:struct<p:double,n:int>,kind:int>>"
    df = spark.createDataFrame([(rows,), ([],), (rows[3:],)], f"x {kind}")
    found = [[(r["s"], r["e"]) for r in row[0]] for row in df.select(pii._best_of_runs(F.col("x"))).collect()]
    assert found == [[(9, 12), (12, 14), (20, 21)], [], [(12, 14), (20, 21)]]
    base = spark.createDataFrame([([(0, 3, 9), (1, 20, 25), (2, 21, 40)], [(1, s, e, [1.0]) for s, e in ((0, 3), (2, 4), (9, 10), (8, 9), (26, 30), (39, 41), (40, 41))])], "b array<struct<kind:int,s:int,e:int>>, c array<struct<kind:int,s:int,e:int,f:array<double>>>")
    assert [(r["s"], r["e"]) for r in base.select(pii._apart(F.col("b"), F.col("c")).alias("x")).first()[0]] == [(0, 3), (9, 10), (40, 41)]


def test_many_matches_in_one_text(spark, same):
    text = lambda n: " ".join(f"x{i}@a{i}.de +49 30 {i:07d} é" if i % 2 else f"10.1.{i % 300}.{i % 256}," for i in range(n))
    long, text = text(100_000), text(4000)
    rows = [(i, f"mail n{i}@m.de or 10.0.0.{i} and 1.2.3.444 or 300.1.1.{i}") for i in range(40)]
    table = spark.createDataFrame([*rows, (-1, text)], "doc_id long, text string")
    own = spark.createDataFrame([(-1, long)], "doc_id long, text string")
    model = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert model is not None
    start = time.perf_counter()
    found = pii.find(own, model).select(F.size("__base"), pii._shown(F.col("__base"))).collect()[0]
    took = time.perf_counter() - start
    wanted = brute.personal([(-1, long)])[0]
    assert found[0] == sum(wanted[1:5]) > 100_000 and found[1] == wanted[6]
    assert took < 60  # a thousand and more if every match met every other
    wanted = brute.personal([(-1, text)])[0]
    out = {r["doc_id"]: r["text"] for r in pii.redacted(table).collect()}
    parts, at = [], 0
    for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in wanted[6].split(","))):
        if s >= at:
            parts += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    assert out[-1] == "".join([*parts, text[at:]])


def test_redaction(spark):
    rows = [(i, f"write to n{i}@mail.example.com or 10.0.0.{i} now 1 2 3", 5, i) for i in range(30)] + [(99, None, 5, 1), (98, "clean", 5, 1)]
    out = {r["doc_id"]: r for r in pii.redacted(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, s int")).collect()}
    assert out[3]["text"] == "write to [EMAIL] or [IP] now 1 2 3" and out[3]["n_chars"] == len(out[3]["text"])
    assert out[99]["text"] is None and out[98]["text"] == "clean" and out[98]["n_chars"] == 5


def test_jaccard_join_of_rows_without_an_id(spark, table):
    many = table.crossJoin(spark.range(15)).select("doc_id", F.concat_ws(" ", "text", F.lit("copy"), "id", F.xxhash64("text", "id")).alias("text"))
    many = many.withColumn("doc_id", F.monotonically_increasing_id())

    def seconds(df):
        start = time.perf_counter()
        found = jaccard.linked(df).collect()
        return time.perf_counter() - start, found

    usual, wanted = seconds(many)
    took, found = seconds(many.withColumn("doc_id", F.lit(None).cast("long")))
    assert len(found) == len(wanted) and {r["component_id"] for r in found} == {None}
    assert took < 2 * usual + 5


def test_jaccard_join(docs, rows, table, table_rows, same):
    columns = ["doc_id", "n_shingles", "component_id"]
    for df, own in ((docs, rows), (table, table_rows)):
        same(jaccard.linked(df), columns, brute.components(own))


def test_one_of_each_component_stays(spark, docs, rows):
    stay = {r["doc_id"] for r in jaccard.first_of_each(docs).collect()}
    assert stay == {i for i, _, c in brute.components(rows) if i == c}
    assert jaccard.first_of_each(docs).columns == docs.columns
    same = [(None, "a b"), (None, "a b"), (1, None), (1, None), (2, "x y"), (3, "X  y"), (3, "other"), (4, "")]
    out = jaccard.first_of_each(spark.createDataFrame(same, "doc_id long, text string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([same[0], same[2], same[3], same[4], same[6], same[7]], key=repr)


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
def test_signatures_meet(share):
    """Sets within the bound share a posting, whatever the allocation of credits."""
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 4, 7, 20, 47, 48, 63, 64, 100, 190, 255, 256, 400):
        for _ in range(20):
            a = rng.integers(0, 1 << 62, size).astype(np.uint64)
            extra = rng.integers(0, 1 << 62, size).astype(np.uint64)
            gone = int(rng.integers(0, size // 4 + 1))
            b = np.concatenate([a[gone:], extra[: (3 * (size - gone) * 100 // 75 - 0) // 3 - (size - gone)]])[: 4 * size // 3]
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both):
                continue
            costly = rng.choice(x, min(3, size), replace=False)
            known = jaccard.signatures(x, np.array([0, len(x)]), {}, np.zeros(0, np.uint64))[1]
            row, sig, _ = jaccard.signatures(
                np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), dict.fromkeys(range(9), share), np.unique(known)[:3] if costly.size else known
            )
            assert set(sig[row == 0]) & set(sig[row == 1])


def test_large_groups_and_blocks_change_nothing(spark, docs, rows, same, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "SAMPLE", 1.0)
    monkeypatch.setattr(jaccard, "SEEN", 2)
    same(jaccard.linked(docs), ["doc_id", "n_shingles", "component_id"], brute.components(rows))
    assert jaccard.linked(docs.limit(0)).count() == 0


def _bins(rows, capacity):
    """What every packing must obey, and that best fit left no piece where it fits better elsewhere alone."""
    room, sources, texts = {}, {}, {}
    for r, source, text in rows:
        room[r["bin"]] = room.get(r["bin"], capacity) - r["n_words"]
        if r["n_words"] < capacity:
            assert source is None or source not in sources.setdefault(r["bin"], set())
            assert text is None or text not in texts.setdefault(r["bin"], set())
        sources.setdefault(r["bin"], set()).add(source)
        texts.setdefault(r["bin"], set()).add(text)
    for r, _, _ in rows:
        assert room[r["bin"]] == r["room"] >= 0
    return room


def test_packing(spark, rows):
    own = [(i, t, None if i % 11 == 0 else f"s{i % 5}") for i, t in rows] + [(3, "one", "s3")] * 3 + [(None, "null id", "s9")]
    out = packing.packed(spark.createDataFrame(own, "doc_id long, text string, source string"), capacity=100, chunk=20).collect()
    by_id = {i: (s, t) for i, t, s in own}
    _bins([(r, *by_id[r["doc_id"]]) for r in out], 100)
    words_of = {}
    for r in out:
        words_of[r["doc_id"]] = words_of.get(r["doc_id"], 0) + r["n_words"]
        assert r["start"] == 100 * r["piece"]
    assert words_of.pop(None) == 2 and words_of.pop(3) == 4
    assert words_of == {i: len(brute.WORDS.findall((t or "").encode())) for i, t, _ in own if i not in (3, None)}
    assert packing.packed(spark.createDataFrame(own, "doc_id long, text string, source string").limit(0)).count() == 0
    assert packing.packed(spark.createDataFrame([(1, "a")], "doc_id long, text string")).count() == 1


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([(7, 1, 1), (6, 2, 2), (3, 1, 4), (3, 4, 8), (0, 1, 1)], 10) == [0, 1, 1, 0, 2]
    rng = np.random.default_rng(1)
    pieces = [(int(rng.integers(0, 60)), 1 << int(rng.integers(0, 6)), 1 << int(rng.integers(0, 30))) for _ in range(400)]
    got = packing.best_fit(pieces, 100)
    state = []
    for (size, a, b), at in zip(pieces, got, strict=True):
        fits = [(room, k) for k, (room, x, y) in enumerate(state) if room >= size and not (x & a or y & b)]
        want = min(fits)[1] if fits else len(state)
        assert at == want
        if want == len(state):
            state.append((100, 0, 0))
        room, x, y = state[want]
        state[want] = (room - size, x | a, y | b)
