"""Pieces of texts on their way to the bucket of their minimiser.

A row is all pieces that one task sends to one bucket at a time: numbers and bytes in one
compressed block. Buckets are many more than tasks, so a task holds one small bucket at a
time. Also the identity of texts, and the join that brings the found spans back to them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of pieces gathered before they are sent, and buckets a shuffle partition.
FLUSH = 24 << 20
BUCKETS = 8
#: Effort of the compression of what is shuffled.
LEVEL = 6
LOWEST = -(1 << 63)
PACKED = "bucket int, block binary"


def identity(text: Column) -> Column:
    """16 bytes that stand for a text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def ids(column: pa.Array) -> np.ndarray:
    """Identities as rows of two integers."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


@dataclass
class Pieces:
    """Pieces with the text they are from, its place in the order of ids, and their start in it."""

    owner: np.ndarray  # n rows of 64-bit numbers
    order: np.ndarray  # int64
    start: np.ndarray  # int32
    length: np.ndarray  # int32, bytes
    count: np.ndarray  # int32, windows
    mark: np.ndarray  # uint64, the minimiser
    flag: np.ndarray  # uint8
    body: np.ndarray  # uint8

    def __len__(self) -> int:
        return len(self.start)

    @property
    def borders(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])


def concat(parts: list[Pieces]) -> Pieces:
    return Pieces(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("owner", "order", "start", "length", "count", "mark", "flag", "body")))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their places: the high bytes, mostly equal, then compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, kind: str, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(self.raw, np.uint8, n * size, self.at).reshape(size, n)
        self.at += n * size
        return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def gather(raw: bytes, starts: np.ndarray, lengths: np.ndarray) -> bytes:
    """The given spans one after the other; for spans of a hundred bytes faster than an index a byte."""
    return b"".join([raw[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])


def encode(p: Pieces, at: np.ndarray, raw: bytes, borders: np.ndarray, marks: np.ndarray) -> bytes:
    """The chosen pieces as one block; ``raw`` is the body and ``borders`` the pieces' in it.

    Orders go as differences, and lengths that all exceed the windows by one number as that.
    """
    length, count = p.length[at], p.count[at]
    more = int(length[0] - count[0])
    fixed = bool((length - count == more).all())
    out = [np.array([len(at), p.owner.shape[1], more if fixed else -1], "<i8").tobytes()]
    out += [_planes(p.owner[at, k].astype("<u8")) for k in range(p.owner.shape[1])]
    out += [_planes(np.diff(p.order[at], prepend=0).astype("<i8")), _planes(p.start[at].astype("<i4")), _planes(count.astype("<i4"))]
    out += [] if fixed else [_planes(length.astype("<i4"))]
    out += [_planes(marks[at].astype("<u4")), p.flag[at].astype("u1").tobytes()]
    out.append(gather(raw, borders[at], length))
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(out))


def decode(block: bytes) -> Pieces:
    raw = _Reader(zstandard.ZstdDecompressor().decompress(block))
    n, width, more = (int(x) for x in np.frombuffer(raw.raw, "<i8", 3))
    raw.at = 24
    owner = np.stack([raw.take("<u8", n) for _ in range(width)], axis=1)
    order, start, count = np.cumsum(raw.take("<i8", n)), raw.take("<i4", n), raw.take("<i4", n)
    length = raw.take("<i4", n) if more < 0 else count + np.int32(more)
    mark, flag = raw.take("<u4", n).astype(np.uint64), raw.take("u1", n)
    return Pieces(owner, order, start, length, count, mark, flag, np.frombuffer(raw.raw, np.uint8, -1, raw.at))


@dataclass
class Sender:
    """Gathers pieces and emits a row a bucket when enough have come."""

    buckets: int
    #: Whether the receiver wants the minimisers: 24 bits beside the bucket, which tell
    #: those of one bucket apart well enough to see which stand alone.
    marked: bool = False
    held: list[Pieces] = field(default_factory=list)
    size: int = 0

    def add(self, p: Pieces) -> Iterator[pa.RecordBatch]:
        self.held.append(p)
        self.size += len(p.body) + 45 * len(p)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held and sum(map(len, self.held)):
            p = concat(self.held)
            to = (p.mark % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            heads = np.flatnonzero(np.append(True, np.diff(to[order]) != 0))
            borders, raw = p.borders, p.body.tobytes()
            marks = (p.mark // np.uint64(self.buckets)) & np.uint64(0xFFFFFF if self.marked else 0)
            blocks = [encode(p, order[a:b], raw, borders, marks) for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to[order[heads]].astype(np.int32)), pa.array(blocks, pa.binary())], ["bucket", "block"])
        self.held, self.size = [], 0


def buckets(docs: DataFrame) -> int:
    return BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(
    packed: DataFrame,
    work: Callable[[Pieces], Iterator[pa.RecordBatch]],
    schema: str,
    direct: Callable[[bytes], Iterator[pa.RecordBatch]] | None = None,
) -> DataFrame:
    """Run ``work`` on all pieces of each bucket; blocks of negative buckets go to ``direct``."""
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for bucket, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket < 0:
                    yield from direct(block.as_py())
                    continue
                if bucket != now and held:
                    yield from work(concat(held))
                    held = []
                now = bucket
                held.append(decode(block.as_py()))
        if held:
            yield from work(concat(held))

    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def spans_batch(owner: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
    """One row a text with its spans as pairs of 32-bit numbers."""
    if not len(starts):
        return None
    order = np.lexsort((starts, owner[:, 1], owner[:, 0]))
    owner, pairs = owner[order], np.stack([starts[order], ends[order]], axis=1).astype("<i4")
    heads = np.flatnonzero(np.append(True, (np.diff(owner.view(np.int64), axis=0) != 0).any(axis=1)))
    tails = np.append(heads[1:], len(owner))
    return pa.RecordBatch.from_arrays(
        [pa.array([owner[a].tobytes() for a in heads], pa.binary()), pa.array([pairs[a:b].tobytes() for a, b in zip(heads, tails, strict=True)], pa.binary())],
        ["id", "spans"],
    )


SPANS = "id binary, spans binary"


def with_spans(docs: DataFrame, spans: DataFrame, facts: DataFrame) -> DataFrame:
    """Each document (id, text and further columns) with its spans and the facts of its text.

    Texts travel compressed. A text with many copies makes one key hot on the side of the
    documents only, which Spark's skew join splits.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                bodies = [press.compress(x.as_buffer()) if x.is_valid else b"" for x in b.column("text")]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(bodies, pa.binary())], [*names, "body"])

    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names, F.lit(b"").alias("body")).schema
    packed = docs.select(*names, "text").mapInArrow(pack, schema)
    found = spans.groupBy("id").agg(F.collect_list("spans").alias("spans"))
    known = facts.join(found, "id", "full_outer")
    return packed.join(known, "id", "left")


def first_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with one row for each different text of a task, and the texts' identities."""
    seen: set[bytes] = set()
    for batch in batches:
        at = []
        for i, x in enumerate(batch.column("id").to_pylist()):
            if x not in seen:
                seen.add(x)
                at.append(i)
        if at:
            batch = batch if len(at) == batch.num_rows else batch.take(pa.array(at))
            yield batch, ids(batch.column("id"))


def unpacked(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of ``with_spans`` a few at a time, with the bytes of their texts and their borders."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        bodies, at, held, total = batch.column("body"), 0, [], 0
        for i in range(batch.num_rows):
            body = bodies[i].as_py()
            held.append(press.decompress(body) if body else b"")
            total += len(held[-1])
            if total >= size or i + 1 == batch.num_rows:
                borders = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
                yield batch.slice(at, len(held)), np.frombuffer(b"".join(held), np.uint8), borders
                at, held, total = i + 1, [], 0
