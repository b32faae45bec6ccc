"""Best-fit packing of documents into training sequences, with conflicts.

Documents are dealt by hash into chunks of bounded size, so no source and no group of
copies decides a task's work, and each chunk packs its own bins. In a chunk the longest
pieces go first. Bins are kept in the order of their room left and carry two bitmaps: the
sources and the duplicate clusters they hold. A search starts at the tightest bin with
enough room and goes on to the next one until a bin without a conflict is found; otherwise
a new bin opens. A document longer than a bin is cut into full pieces and a rest, so
nothing is lost.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import text_batches
from arealis.llm.text import NOT_SPACE, utf8, words

#: Words of a bin, and documents of a chunk on average.
CAPACITY, CHUNK = 2048, 4096


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (size, source bit, cluster bit) piece, in the given order.

    A piece of a whole bin's size gets its own; a piece of size 0 may share any bin that
    its bits allow. Bits are single-bit numbers; 0 conflicts with nothing.
    """
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for size, source, cluster in pieces:
        at = bisect.bisect_left(rooms, (size, -1))
        while at < len(rooms):
            room, b = rooms[at]
            if not (sources[b] & source or clusters[b] & cluster):
                break
            at += 1
        if at < len(rooms):
            rooms.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        bisect.insort(rooms, (room - size, b))
        out.append(b)
    return out


def _bits(values: list) -> list[int]:
    known: dict = {}
    return [0 if v is None else 1 << known.setdefault(v, len(known)) for v in values]


def packed(docs: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK, cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_words, n_pieces, bin and room: where each piece of a document goes.

    Sizes are words of the whole text. ``bin`` is a text, unique over all chunks; ``start``
    is the piece's first word in its document; ``room`` what its bin has left in the end.
    In a bin no two documents share a source, nor a duplicate cluster: the column
    ``cluster``, or else the text itself. Null sources and null texts conflict with
    nothing. Null and empty texts are one piece of size 0. Equal sizes are packed in the
    order of ids, then texts; repeated rows are packed each. An empty table gives an empty
    result; other columns are ignored.
    """
    text_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source"),
        (F.xxhash64(F.col(cluster)) if cluster else F.when(text.isNotNull(), F.xxhash64(text))).alias("cluster"),
        text.alias("text"),
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            data, borders = utf8(batch.column(at))
            first = words(data, borders, NOT_SPACE)[2]
            rest = [batch.column(c) for c in range(batch.num_columns) if c != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(first).astype(np.int64))], ["doc_id", "source", "cluster", "words"])

    sized = own.mapInArrow(measure, "doc_id long, source string, cluster long, words long")
    n = max(1, -(-docs.count() // chunk))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id and text go to different chunks by their place in their task
    lot = F.pmod(F.xxhash64("doc_id", "cluster", F.monotonically_increasing_id()), F.lit(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("chunk", "doc_id", "source", "cluster", "words")), strict=True):
                if row[0] != now and held:
                    yield from fill(held)
                    held = []
                now = row[0]
                held.append(row)
        if held:
            yield from fill(held)

    def fill(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        source, same = _bits([r[2] for r in rows]), _bits([r[3] for r in rows])
        pieces = []
        for i, r in enumerate(rows):
            count = max(1, -(-r[4] // capacity))
            for k in range(count):
                pieces.append((min(capacity, r[4] - k * capacity), i, k, count))
        lowest = -(1 << 63)
        pieces.sort(key=lambda p: (-p[0], lowest if rows[p[1]][1] is None else rows[p[1]][1], rows[p[1]][3] or 0, p[2]))
        bins = best_fit([(p[0], source[p[1]], same[p[1]]) for p in pieces], capacity)
        room = [capacity] * (max(bins) + 1)
        for p, b in zip(pieces, bins, strict=True):
            room[b] -= p[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[p[1]][1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
             pa.array([p[2] * capacity for p in pieces], pa.int64()), pa.array([p[0] for p in pieces], pa.int64()),
             pa.array([p[3] for p in pieces], pa.int64()), pa.array([f"{rows[0][0]}-{b}" for b in bins], pa.string()),
             pa.array([room[b] for b in bins], pa.int64())],
            ["doc_id", "piece", "start", "n_words", "n_pieces", "bin", "room"],
        )

    dealt = sized.withColumn("chunk", lot).repartition(parts, "chunk").sortWithinPartitions("chunk", "doc_id", "cluster", "words")
    return dealt.mapInArrow(
        run, "doc_id long, piece long, start long, n_words long, n_pieces long, bin string, room long"
    )
