"""Benchmark passages in documents, found by winnowing.

Of every run of WINDOW - K + 1 consecutive hashes of K words the smallest is kept as a
fingerprint, on both sides by the same rule, so each shared span of WINDOW words shares a
fingerprint. Where a document's fingerprint is one of the benchmark's, the hit is extended:
the windows around it are compared whole by two independent 64-bit hashes. Items shorter
than WINDOW are one window each and are looked up by their own length.

A benchmark of at most BLOCK bytes is sent to all tasks as sorted arrays, so texts are not
shuffled. A larger one stays on Spark: only a bitmap of fixed size is sent, and the windows
around the fingerprints that it lets pass are joined with the benchmark's windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from arealis.llm.packs import first_copies, identity
from arealis.llm.store import kept, text_batches
from arealis.llm.text import ALNUM, BASES, LOWER, grams, merge, mix, ranges, rows_of, sliding_min, slices, span_hashes, utf8, words

WINDOW, K = 10, 5
#: Bytes of the largest benchmark that is sent to the tasks: texts, ids and ITEM bytes a row.
BLOCK, ITEM = 16 << 20, 64
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_FILTER = 1 << 22
#: Bits of the bitmap that stands for a larger benchmark, and of each of its pieces (powers of two).
BITS, PIECE = 28, 19


@dataclass
class Tokens:
    """Words of a run of rows: two hashes each, and the first word of each row."""

    one: np.ndarray
    two: np.ndarray | None
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def tokens(data: np.ndarray, borders: np.ndarray, both: bool = True) -> Tokens:
    low = LOWER[data]
    starts, ends, first = words(low, borders, ALNUM)
    one = span_hashes(low, starts, ends, BASES[0])
    return Tokens(one, span_hashes(low, starts, ends, BASES[1]) if both else None, first, starts, ends)


def winnow(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Positions of the fingerprints: the smallest k-gram of each window, with its equals."""
    g, w = grams(hashes, k), window - k + 1
    low = sliding_min(g, w)
    if not len(low):
        return np.zeros(0, np.int64)
    row = rows_of(first)
    inside = row[: len(low)] == row[window - 1 : window - 1 + len(low)]
    chosen = np.zeros(len(g), bool)
    for i in range(w):
        chosen[i : i + len(low)] |= inside & (g[i : i + len(low)] == low)
    return np.flatnonzero(chosen)


@dataclass
class Block:
    """A benchmark: fingerprints, and windows by length with the items that have them."""

    marks: np.ndarray
    seen: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # hashes, second hashes, item borders, items
    items: np.ndarray


def _item_windows(t: Tokens, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By length: both hashes and the row of each window of an item, in order of hashes."""
    n = np.diff(t.first)
    for length in sorted({int(x) for x in n if 0 < x < window} | ({window} if (n >= window).any() else set())):
        has = np.flatnonzero(n >= window if length == window else n == length)
        at = ranges(t.first[has], n[has] - length + 1)
        item = np.repeat(has, n[has] - length + 1)
        a = span_hashes(t.one, at, at + length, BASES[2])
        b = span_hashes(t.two, at, at + length, BASES[2])
        order = np.lexsort((item, b, a))
        yield length, a[order], b[order], item[order]


def _block(ids: list[int], texts: list[str], window: int, k: int) -> Block:
    data, borders = utf8(pa.array(texts, pa.large_string()))
    t = tokens(data, borders)
    marks = np.unique(grams(t.one, k)[winnow(t.one, t.first, window, k)])
    seen = np.zeros(_FILTER, bool)
    seen[(marks & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    out = {}
    for length, a, b, item in _item_windows(t, window):
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        heads = np.flatnonzero(new)
        out[length] = (a[heads], b[heads], np.append(heads, len(a)), item)
    return Block(marks, seen, out, np.array(ids, object))


def blocks(benchmark: DataFrame, window: int = WINDOW, k: int = K, size: int = BLOCK) -> list[Block] | None:
    """The benchmark as a block, none if it is empty; None if it exceeds ``size`` bytes."""
    rows = _items(benchmark)
    weight = F.octet_length("text") + F.coalesce(F.octet_length(F.col("item_id").cast("string")), F.lit(0)) + F.lit(ITEM)
    if (rows.agg(F.sum(weight)).first()[0] or 0) > size:
        return None
    part = rows.collect()
    return [_block([r["item_id"] for r in part], [r["text"] for r in part], window, k)] if part else []


def _items(benchmark: DataFrame) -> DataFrame:
    """Ids and texts; null texts have no words."""
    return benchmark.select(F.col("item_id").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _slots(hashes: np.ndarray, length: int) -> np.ndarray:
    """Places in the bitmap of fingerprints (with the window's length) or of short windows."""
    return (mix(hashes + np.uint64(length)) >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(items: DataFrame, window: int, k: int) -> np.ndarray:
    """The packed bits of all fingerprints and short windows, made piece by piece in tasks."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                t = tokens(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                at = winnow(t.one, t.first, window, k)
                found = [_slots(grams(t.one, k)[at], window)] if len(at) else []
                found += [_slots(a, length) for length, a, _, _ in _item_windows(t, window) if length < window]
                if found:
                    slot = np.unique(np.concatenate(found))
                    piece, heads = np.unique(slot >> PIECE, return_index=True)
                    bodies = [x.astype("<i4").tobytes() for x in np.split(slot & ((1 << PIECE) - 1), heads[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(bodies, pa.binary())], ["piece", "slots"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = -1, np.zeros(0, bool)

        def done() -> Iterator[pa.RecordBatch]:
            if now >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(bits).tobytes()], pa.binary())], ["piece", "slots"])

        for batch in batches:
            for piece, slots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece != now:
                    yield from done()
                    now, bits = piece, np.zeros(1 << PIECE, bool)
                bits[np.frombuffer(slots, "<i4")] = True
        yield from done()

    schema, n = "piece int, slots binary", int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = items.select("text").mapInArrow(deal, schema).repartition(n, "piece").sortWithinPartitions("piece").mapInArrow(build, schema)
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in pieces.toLocalIterator():
        begin = r["piece"] << (PIECE - 3)
        out[begin : begin + (1 << (PIECE - 3))] = np.frombuffer(r["slots"], np.uint8)
    return out


def _listed(items: DataFrame, window: int) -> DataFrame:
    """length, a, b, item: the windows of all items by both hashes, ids as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array([str(x) for x in batch.column("item_id").to_pylist()], object)
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                t = tokens(data[borders[i] : borders[j]], borders[i : j + 1] - borders[i])
                for length, a, b, item in _item_windows(t, window):
                    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (item[1:] != item[:-1]))
                    a, b, item = a[new], b[new], item[new]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), length, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                         pa.array(names[i:j][item], pa.string())],
                        ["length", "a", "b", "item"],
                    )

    return kept(items.mapInArrow(run, "length int, a long, b long, item string"), "windows")


def _joined(source: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``source`` with ``__at`` (hit windows: length, first words in the text) and ``__names`` (items).

    Both follow from the text alone, so texts go by their identity. Windows are joined by
    both hashes; one that many documents have is hot on their side only, where the skew
    join splits it.
    """
    items = _items(benchmark)
    listed = _listed(items, window)
    lengths = sorted(r["length"] for r in listed.select("length").distinct().collect())
    shared = source.sparkSession.sparkContext.broadcast(_bitmap(items, window, k))

    def passing(slots: np.ndarray) -> np.ndarray:
        return (shared.value[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in first_copies(batches):
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                own, edge = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
                t = tokens(own, edge, both=False)
                row, n = rows_of(t.first), len(t.one)
                for length in lengths:
                    if length == window:
                        at = winnow(t.one, t.first, window, k)
                        if len(at):
                            at = at[passing(_slots(grams(t.one, k)[at], window))]
                        at = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
                        at = at[(at >= 0) & (at + window <= n)]
                    else:
                        at = np.arange(max(0, n - length + 1))
                    at = at[row[at] == row[at + length - 1]]
                    a = span_hashes(t.one, at, at + length, BASES[2])
                    if length < window:
                        maybe = passing(_slots(a, length))
                        at, a = at[maybe], a[maybe]
                    if not len(at):
                        continue
                    if t.two is None:
                        t.two = span_hashes(LOWER[own], t.starts, t.ends, BASES[1])
                    b = span_hashes(t.two, at, at + length, BASES[2])
                    order = np.lexsort((at, b, a, row[at]))
                    at, a, b = at[order], a[order], b[order]
                    of = row[at]
                    heads = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (of[1:] != of[:-1])))
                    places = np.split((at - t.first[of]).astype("<i4"), heads[1:])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(i + of[heads])), pa.array(np.full(len(heads), length, np.int32)),
                         pa.array(a[heads].view(np.int64)), pa.array(b[heads].view(np.int64)), pa.array([x.tobytes() for x in places], pa.binary())],
                        ["id", "length", "a", "b", "at"],
                    )

    key = ["length", "a", "b"]
    texts = source.select(identity(F.col("text")).alias("id"), "text")
    asked = texts.mapInArrow(candidates, "id binary, length int, a long, b long, at binary")
    hit = kept(asked.join(listed.select(*key), key, "left_semi").dropDuplicates(["id", *key]), "hits")
    spans = hit.groupBy("id").agg(F.collect_list(F.struct("length", "at")).alias("__at"))
    names = hit.select("id", *key).join(listed, key).select("id", "item").distinct().groupBy("id").agg(F.sort_array(F.collect_list("item")).alias("__names"))
    found = spans.join(names, "id").withColumnRenamed("id", "__id")
    return source.withColumn("__id", identity(F.col("text"))).join(found, "__id", "left").select(*source.columns, "__at", "__names")


def _windows_at(t: Tokens, data: np.ndarray, b: Block, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the candidate window starts, those that the block has, and their entries in it."""
    a, second, _, _ = b.windows[length]
    h = span_hashes(t.one, at, at + length, BASES[2])
    found = np.minimum(np.searchsorted(a, h), len(a) - 1)
    # equal first hashes stand together; the second hash picks the entry
    ok = np.flatnonzero(a[found] == h)
    if not len(ok):
        return at[:0], found[:0]
    if t.two is None:
        low = LOWER[data]
        t.two = span_hashes(low, t.starts, t.ends, BASES[1])
    at, found, h = at[ok], found[ok], h[ok]
    h2 = span_hashes(t.two, at, at + length, BASES[2])
    hit = second[found] == h2
    open_ = ~hit
    while open_.any():
        found[open_] += 1
        inside = open_ & (found < len(a))
        inside[inside] = a[found[inside]] == h[inside]
        hit[inside] = second[found[inside]] == h2[inside]
        open_ = inside & ~hit
    return at[hit], found[hit]


def hits(t: Tokens, data: np.ndarray, b: Block, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit spans (row, first word, end) and the (row, item) pairs, as arrays."""
    row, n = rows_of(t.first), len(t.one)
    spans, pairs = [], []
    for length in b.windows:
        if length == window:
            at = winnow(t.one, t.first, window, k)
            g = grams(t.one, k)[at] if len(at) else np.zeros(0, np.uint64)
            maybe = b.seen[(g & np.uint64(_FILTER - 1)).astype(np.int64)]
            at, g = at[maybe], g[maybe]
            if len(at):
                at = at[b.marks[np.minimum(np.searchsorted(b.marks, g), len(b.marks) - 1)] == g]
            # all windows that hold the fingerprint
            at = np.unique((at[:, None] - np.arange(window - k + 1)).ravel())
            at = at[(at >= 0) & (at + window <= n)]
        else:
            at = np.arange(max(0, n - length + 1))
        at = at[row[at] == row[at + length - 1]]
        if not len(at):
            continue
        at, entry = _windows_at(t, data, b, at, length)
        _, _, borders, item = b.windows[length]
        count = borders[entry + 1] - borders[entry]
        spans.append((at, at + length))
        pairs.append(np.unique(np.repeat(row[at], count) * len(b.items) + item[ranges(borders[entry], count)]))
    if not spans:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    s, e = merge(np.concatenate([x[0] for x in spans]), np.concatenate([x[1] for x in spans]))
    both = np.unique(np.concatenate(pairs))
    # spans of neighbouring rows may touch, so they are cut at the rows' borders
    cut = np.searchsorted(t.first, s, "right") != np.searchsorted(t.first, e - 1, "right")
    if cut.any():
        covered = ranges(s, e - s)
        new = np.append(True, (np.diff(covered) != 1) | (np.diff(row[covered]) != 0))
        heads = np.flatnonzero(new)
        s, e = covered[heads], covered[np.append(heads[1:], len(covered)) - 1] + 1
    return s, e, both // len(b.items), both % len(b.items)


def _marked(part: pa.RecordBatch, t: Tokens, edge: np.ndarray, covered: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    """The rows with what ``mark`` adds, of the words that are covered."""
    row, rows = rows_of(t.first), part.num_rows
    words_hit = np.flatnonzero(covered)
    new = np.append(True, (np.diff(words_hit) != 1) | (np.diff(row[words_hit]) != 0))[: len(words_hit)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(words_hit)) - 1
    of = row[words_hit[head]]
    start = t.starts[words_hit[head]] - edge[of]
    end = t.ends[words_hit[tail]] - edge[of] if len(head) else start
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(of, np.arange(rows + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))], ["s", "e"]),
    )
    return pa.RecordBatch.from_arrays(
        [*part.columns, pa.array(np.diff(t.first).astype(np.int64)), lists,
         pa.array(np.bincount(row[words_hit], minlength=rows).astype(np.int64)),
         pa.array(items, pa.list_(pa.string()))],
        [*part.schema.names, "__n_words", "__spans", "__n_hit", "__items"],
    )


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """All columns of ``docs``, and for each row what the benchmark covers.

    Adds ``__n_words``, ``__spans`` (hit words as array of byte spans in the UTF-8 text,
    first byte and end, joined where words follow each other), ``__n_hit`` and ``__items``
    (ids as strings, ascending). Null texts have no words; short items match as a whole;
    repeated rows and items are each judged; an empty benchmark hits nothing.
    """
    source, run, schema = _marking(docs, benchmark, window, k)
    return source.mapInArrow(run, schema)


def _marking(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> tuple[DataFrame, Batches, StructType]:
    """The rows that ``mark`` reads, what tasks do with their batches, and the columns that this gives."""
    text_batches(docs.sparkSession)
    sent = blocks(benchmark, window, k)
    source = docs.withColumn("text", F.col("text").cast("string"))
    schema = source.selectExpr("*", "0L as __n_words", "array(struct(0L as s, 0L as e)) as __spans", "0L as __n_hit", "array('') as __items").schema
    if sent is None:
        return _joined(source, benchmark, window, k), _found, schema
    shared = [docs.sparkSession.sparkContext.broadcast(b) for b in sent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, borders = utf8(batch.column("text"))
            for i, j in slices(borders):
                own, edge = data[borders[i] : borders[j]], borders[i : j + 1] - borders[i]
                t = tokens(own, edge, both=False)
                covered, items = np.zeros(len(t.one), bool), [set() for _ in range(j - i)]
                for value in shared:
                    b = value.value
                    s, e, r, item = hits(t, own, b, window, k)
                    covered[ranges(s, e - s)] = True
                    for x, y in zip(r.tolist(), item.tolist(), strict=True):
                        items[x].add(str(b.items[y]))
                yield _marked(batch.slice(i, j - i), t, edge, covered, [sorted(x) for x in items])

    return source, run, schema


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_joined`` with what ``mark`` adds."""
    for batch in batches:
        data, borders = utf8(batch.column("text"))
        plain = batch.select([x for x in batch.schema.names if x not in ("__at", "__names")])
        for i, j in slices(borders):
            edge = borders[i : j + 1] - borders[i]
            t = tokens(data[borders[i] : borders[j]], edge, both=False)
            covered = np.zeros(len(t.one), bool)
            for r, windows in enumerate(batch.column("__at").slice(i, j - i).to_pylist()):
                for x in windows or ():
                    at = t.first[r] + np.frombuffer(x["at"], "<i4").astype(np.int64)
                    covered[ranges(at, np.full(len(at), x["length"]))] = True
            items = [x or [] for x in batch.column("__names").slice(i, j - i).to_pylist()]
            yield _marked(plain.slice(i, j - i), t, edge, covered, items)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Null and wordless texts have no words and are clean (the digest of no items is that of
    the empty text); repeated rows are each judged. Empty tables give an empty or a clean
    result. Other columns are ignored.
    """
    marked = mark(docs.select("doc_id", "text"), benchmark)
    return marked.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, most: float = 0.5) -> DataFrame:
    """The documents without the benchmark's passages, all columns.

    Hit words and what stands between them are cut out; a document of whose words ``most``
    or more are hit goes. ``n_chars`` follows the text where the column exists. Documents
    that hit nothing stay as they are, also null and wordless ones.
    """
    names = docs.columns
    source, marked, _ = _marking(docs, benchmark)

    # in the same pass: a second one would hold two Python workers a task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in marked(batches):
            n_hit, n_words = (batch.column(c).to_numpy() for c in ("__n_hit", "__n_words"))
            batch = batch.take(pa.array(np.flatnonzero((n_hit == 0) | (n_hit < most * n_words))))
            at = batch.schema.names.index("text")
            texts, spans = batch.column(at).to_pylist(), batch.column("__spans").to_pylist()
            for i, found in enumerate(spans):
                if found:
                    raw, out, last = texts[i].encode(), [], 0
                    for x in found:
                        out.append(raw[last : x["s"]])
                        last = x["e"]
                    texts[i] = b"".join([*out, raw[last:]]).decode("utf-8", "replace")
            columns = [pa.array(texts, pa.string()) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    out = source.mapInArrow(cut, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
