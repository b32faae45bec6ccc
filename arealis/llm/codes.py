"""Vector codes: each part of a vector becomes the number of its nearest codebook entry.

All arithmetic is on integers, so codes don't depend on the order of rows or tasks. The
nearest entry is found through a grid: a part's coarse cell is a box, and an entry whose
least distance to the box passes another entry's greatest one can't be nearest anywhere
in it. What is left of the codebook is worked out once a cell, kept, and measured exactly.

A fitting round reads the vectors once, sums them by entry inside the tasks, and sends one
sum a component of the codebook to the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.store import kept
from arealis.llm.text import mix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows worked on together, and cells that a task remembers for a part before it starts anew.
ROWS, CELLS = 1 << 14, 1 << 16
#: Sums travel as digits of this many bits, so that no number of rows overflows a long.
DIGIT = 40
#: Rows of one label are dealt over so many keys of the join that brings the label's sum.
SALTS = 16
_U = np.uint64


@dataclass(frozen=True)
class Codebooks:
    """For each part its entries, each a tuple of integers; ``size`` is the length of a vector."""

    size: int
    parts: tuple[tuple[tuple[int, ...], ...], ...]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for e in p for x in e).encode()).hexdigest()


def cuts(size: int, parts: int) -> list[int]:
    """Borders of consecutive parts, equal where ``size`` can be divided."""
    return [i * size // parts for i in range(parts + 1)]


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return n * scale // d


class Grid:
    """The nearest entry of one part's codebook, by remembered cells."""

    def __init__(self, entries: Sequence[Sequence[int]], width: int):
        self.exact = entries
        most = max((abs(x) for e in entries for x in e), default=0)
        #: Components up to this size can't overflow the squares of 64-bit integers.
        self.limit = math.isqrt((1 << 62) // max(width, 1)) // 4
        self.small = most <= self.limit
        self.cells: dict[bytes, int] = {}
        if self.small:
            self.book = np.array(entries, np.int64).reshape(len(entries), width)
            spread = int(np.ptp(self.book, axis=0).max()) if self.book.size else 0
            # a sixteenth of the spread or little more: most entries are ruled out
            self.shift = (spread // 16).bit_length()
            self.odd = mix(np.arange(1, width + 1, dtype=_U)) | _U(1)

    def masks(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries, as bits, that can be nearest to a point of it."""
        low = cells << self.shift
        high = low + ((1 << self.shift) - 1)
        near = np.zeros((len(cells), len(self.book)), np.int64)
        far = np.zeros_like(near)
        for j, entry in enumerate(self.book):
            a, b = low - entry, high - entry
            least = np.maximum(np.maximum(a, -b), 0)
            near[:, j] = (least * least).sum(1)
            most = np.maximum(np.abs(a), np.abs(b))
            far[:, j] = (most * most).sum(1)
        open_ = near <= far.min(1, keepdims=True)
        return (open_ * (1 << np.arange(len(self.book)))).sum(1)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """The mask of each point's cell."""
        cells = points >> self.shift
        hashed = (mix(cells.view(_U)) * self.odd).sum(1, dtype=_U)
        _, first, place = np.unique(hashed, return_index=True, return_inverse=True)
        own = cells[first]
        names = [c.tobytes() for c in own]
        if len(self.cells) > CELLS:
            self.cells.clear()
        new = [i for i, c in enumerate(names) if c not in self.cells]
        if new:
            self.cells.update(zip((names[i] for i in new), self.masks(own[new]).tolist(), strict=True))
        out = np.array([self.cells[c] for c in names], np.int64)[place]
        # two cells of one hash: the later ones weigh all entries
        out[(cells != own[place]).any(1)] = -1
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row; the lower entry of equally near ones."""
        masks = self.candidates(points)
        best = np.full(len(points), np.iinfo(np.int64).max)
        entry = np.zeros(len(points), np.int64)
        for j, own in enumerate(self.book):
            rows = np.flatnonzero((masks >> j) & 1)
            gap = points[rows] - own
            far = (gap * gap).sum(1)
            better = far < best[rows]
            best[rows[better]], entry[rows[better]] = far[better], j
        return entry, best

    def nearest_of_large(self, point: Sequence[int]) -> tuple[int, int]:
        """The same for numbers of any size."""
        far = [sum((a - b) ** 2 for a, b in zip(point, e, strict=True)) for e in self.exact]
        return far.index(min(far)), min(far)


class Coder:
    """All parts of a batch of vectors."""

    def __init__(self, books: Codebooks, scale: int):
        self.borders, self.scale = cuts(books.size, len(books.parts)), scale
        self.grids = [Grid(p, b - a) for p, (a, b) in zip(books.parts, itertools.pairwise(self.borders), strict=True)]
        self.limit = min((g.limit if g.small else -1) for g in self.grids)

    def run(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, object, object]]:
        """For each part: its number, rows, their integer components, entries and distances.

        Rows of very large components come apart from the rest, as Python integers.
        """
        large = ~(np.abs(vectors).max(1, initial=0) < self.limit / self.scale - 1)
        rows = np.flatnonzero(~large)
        points = np.floor(vectors[rows] * self.scale).astype(np.int64)
        huge = [(i, [whole(x, self.scale) for x in vectors[i]]) for i in np.flatnonzero(large)]
        for part, (grid, (a, b)) in enumerate(zip(self.grids, itertools.pairwise(self.borders), strict=True)):
            if len(rows):
                own = np.ascontiguousarray(points[:, a:b])
                yield part, rows, own, *grid.nearest(own)
            for i, x in huge:
                entry, far = grid.nearest_of_large(x[a:b])
                yield part, np.array([i]), np.array([x[a:b]], object), np.array([entry]), [far]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Some thousand rows and their vectors at a time."""
    held: list[pa.RecordBatch] = []

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table, np.asarray(flat, np.float64).reshape(len(table), size)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield joined()
            held = []
    if held:
        yield joined()


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label and vector (array of double) of the rows that are fit for coding, and the vectors' length.

    Null vectors and those with a null, NaN or infinite component go. The length is the
    one that most vectors have (of equally frequent ones the least).
    """
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), vector.alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = kept(rows.where(F.col("vector").isNotNull() & good), "vectors")
    often = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows, often[0]["size"] if often else 0


def fit(rows: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of the usable rows of one length, from the vectors of smallest vec_id on.

    Null ids come last, vectors of one id by their components. Fewer vectors than entries
    give as many entries as there are vectors.
    """
    rows = rows.where(F.size("vector") == size).select("vec_id", "vector")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    seeds = [[whole(x, scale) for x in r["vector"]] for r in first]
    borders = list(itertools.pairwise(cuts(size, parts)))
    books = Codebooks(size, tuple(tuple(tuple(s[a:b]) for s in seeds) for a, b in borders))
    for _ in range(rounds if seeds else 0):
        books = _moved(rows, books, scale)
    return books


def _moved(rows: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """Each entry at the floor of its parts' mean; unused ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, scale)
        # the last column counts
        sums = [np.zeros((len(p), b - a + 1), object) for p, (a, b) in zip(books.parts, itertools.pairwise(coder.borders), strict=True)]
        for _, vectors in _blocks(batches, books.size):
            for part, _, points, entry, _ in coder.run(vectors):
                order = np.argsort(entry, kind="stable")
                start = np.flatnonzero(np.diff(entry[order], prepend=-1))
                total = np.add.reduceat(points[order], start, axis=0)
                found = entry[order][start]
                sums[part][found, :-1] += total.astype(object)
                sums[part][found, -1] += np.diff(np.append(start, len(order))).astype(object)
        out = []
        for part, own in enumerate(sums):
            for (entry, place), total in np.ndenumerate(own):
                left, digit = abs(int(total)), 0
                while left:
                    out.append((part, entry, place, digit, (left & ((1 << DIGIT) - 1)) * (1 if total > 0 else -1)))
                    left, digit = left >> DIGIT, digit + 1
        names = ["part", "entry", "place", "digit", "value"]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if n == "value" else pa.int32()) for n, c in zip(names, columns, strict=True)], names
        )

    schema = "part int, entry int, place int, digit int, value long"
    found = rows.select("vector").mapInArrow(run, schema).groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value"))
    sums: dict[tuple[int, int, int], int] = {}
    for r in found.collect():
        at = (r["part"], r["entry"], r["place"])
        sums[at] = sums.get(at, 0) + (r["value"] << (DIGIT * r["digit"]))

    def moved(part: int, entry: int, own: tuple[int, ...]) -> tuple[int, ...]:
        count = sums.get((part, entry, len(own)), 0)
        return tuple(sums.get((part, entry, i), 0) // count for i in range(len(own))) if count else own

    return Codebooks(books.size, tuple(tuple(moved(p, j, e) for j, e in enumerate(part)) for p, part in enumerate(books.parts)))


def encode(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances, summed) of usable rows.

    Vectors of another length than the codebooks' can't be coded: code and error are null.
    An error past 63 bits is null.
    """
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, scale)
        for table, vectors in _blocks(batches, books.size):
            code = np.zeros((len(table), len(books.parts)), np.uint8)
            error = np.zeros(len(table), object)
            for part, at, _, entry, far in coder.run(vectors):
                code[at, part] = entry
                error[at] += np.asarray(far, object)
            table = table.combine_chunks()
            texts = [c.tobytes().hex() for c in code]
            fits = [int(e) if e < 1 << 63 else None for e in error]
            yield from table.select(["vec_id", "label"]).append_column("code", pa.array(texts, pa.string())).append_column(
                "error", pa.array(fits, pa.int64())
            ).to_batches()

    coded = rows.where(F.size("vector") == books.size).mapInArrow(run, f"vec_id long, label {label}, code string, error long")
    other = rows.where(F.size("vector") != books.size).select("vec_id", "label", F.lit(None).cast("string"), F.lit(None).cast("long"))
    return coded.union(other)


def decoded(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with the vector that its code stands for (array of double; null code: null)."""
    parts = [
        F.element_at(
            F.array(*[F.array(*[F.lit(x / scale) for x in e]) for e in part]),
            F.conv(F.substring("code", 2 * i + 1, 2), 16, 10).cast("int") + 1,
        )
        for i, part in enumerate(books.parts)
    ]
    return codes.withColumn("decoded", F.when(F.col("code").isNotNull(), F.concat(*parts)))


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable row of ``vectors``.

    Null vectors and those with null or non-finite components have no row; repeated rows
    and rows of one id or of none each have one. label_error sums error over equal labels, null
    being one of them (null past 63 bits). A vector of another length than most has no code.
    A length that 8 doesn't divide is cut as evenly as can be. An empty table gives an empty
    result; other columns are ignored.
    """
    rows, size = usable(vectors)
    books = fit(rows, size)
    coded = kept(encode(rows, books), "codes")
    totals = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    totals = totals.select(
        F.col("label").alias("of"), F.expr("try_cast(total AS long)").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("deal")
    )
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    met = salted.join(totals, salted["label"].eqNullSafe(totals["of"]) & (salted["salt"] == totals["deal"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
