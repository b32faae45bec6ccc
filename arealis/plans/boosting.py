"""Boosted regression trees grown leaf by leaf or level by level, on binned rows.

Rows are binned once, one byte a value, and kept as blocks of some thousand. A pass over
the blocks sums gradients by (leaf, feature, bin) for all models that are fitted
together: the folds of a cross-validation, the draws of a search. Only those sums reach the
driver: leaves x features x 256 numbers, whatever the number of rows. A split's smaller child is
summed, the larger one is what is left of the parent.

Gradients are summed as integers, so a fit doesn't depend on how rows are dealt out. The
loss is squared error: the first derivative is prediction - target, the second 1 a row.

A fitted model becomes an MLlib boosted model, so that it is saved, scored and explained as any.
"""

from __future__ import annotations

import heapq
import itertools
import json
import math
import random
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealis.plans import errors
from arealis.session import kept, scratch_path

#: Bins of a feature; the last byte value is for missing values.
BINS, MISSING = 255, 255
#: Rows of a block, and trees that a pass walks again before predictions are written down.
ROWS, PENDING = 1 << 15, 10
#: Blocks that a task has in its memory at a time, and that it reads at most where there are more than ``WAVES`` tasks a core.
HELD, READ = 4, 64
#: Tasks that a core takes of a pass, one after another, and blocks below which a task isn't parted for that: starting one costs as much as some blocks.
WAVES, WORTH = 2, 16
#: Bytes of blocks up to which they are kept in memory between passes.
CACHED = 1 << 31
#: Sums, 4 KB each, that tasks may send to the driver without being added up by others before.
DIRECT = 1 << 12
#: Bytes of blocks up to which every task may have the whole table, and rounds from which passes cost more than that.
SENT, LONG = 1 << 25, 50
#: Cells that a table of a tree's nodes may have, and nodes up to which a tree is walked node by node.
CELLS, FEW = 1 << 14, 255
#: A split has to gain more than this.
LEAST_GAIN = 1e-6
#: Sums that a task holds in one pass: (node, feature) pairs of 4 KB each.
PASS = 1 << 14
#: Such pairs that a task adds up over all tasks.
ADDED = 64
#: Shares of rows that are drawn at most 0, 1, .. times.
DRAWN = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class Settings:
    """What one model is fitted with.

    ``leaves`` bounds a tree that grows its best leaf first; None grows level by level.
    ``min_weight`` is the least sum of second derivatives of a child (its rows, here) and ``l2``
    is added to it where it divides. ``columns`` and ``rows`` are the shares drawn for a tree.
    ``held`` is the fold left out.
    """

    rounds: int = 200
    rate: float = 0.1
    leaves: int | None = None
    depth: int | None = 6
    l2: float = 1.0
    min_weight: float = 1.0
    min_rows: int = 1
    columns: float = 1.0
    rows: float = 1.0
    seed: int = 42
    held: int | None = None
    #: What stands for a missing value, by feature; None sends it the better way.
    fill: tuple[float | None, ...] | None = None
    #: A forest's tree: rows are drawn a Poisson number of times, and so many features are tried at a split.
    bootstrap: bool = False
    tried: int | None = None


@dataclass
class Tree:
    """Nodes from the root on, children after their parent; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    count: list[int] = field(default_factory=list)

    def add(self, value: float, count: int) -> int:
        for name, x in (("feature", -1), ("bin", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value), ("gain", 0.0), ("count", count)):
            getattr(self, name).append(x)
        return len(self.value) - 1

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node where each column of ``bins`` (features x rows) ends."""
        at = np.zeros(bins.shape[1], np.int32)
        if len(self.value) <= FEW:
            todo: list[tuple[int, np.ndarray | slice]] = [(0, slice(None))]
            while todo:
                node, own = todo.pop()
                f = self.feature[node]
                if f < 0:
                    at[own] = node
                    continue
                x = bins[f][own]
                go = x <= self.bin[node]
                if self.missing_left[node]:
                    go |= x == MISSING
                todo += [(side, np.flatnonzero(way) if isinstance(own, slice) else own[way]) for side, way in ((self.left[node], go), (self.right[node], ~go))]
            return at
        feature, split, left, right = (np.array(x, np.int32) for x in (self.feature, self.bin, self.left, self.right))
        way = np.array(self.missing_left)
        rows = np.arange(bins.shape[1]) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            node = at[rows]
            x = bins[feature[node], rows]
            go = np.where(x == MISSING, way[node], x <= split[node])
            at[rows] = node = np.where(go, left[node], right[node])
            rows = rows[feature[node] >= 0]
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.walk(bins)]

    def finder(self, result: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """What ``result`` says of the node where each column of bins ends.

        Between a feature's cuts all bins go the same way, so a table over the stretches of all
        features that are cut holds every answer, unless it would be too large: then the tree is walked.
        """
        cuts = {f: np.unique([k for g, k in zip(self.feature, self.bin, strict=True) if g == f]) for f in {*self.feature} - {-1}}
        size = math.prod(len(c) + 2 for c in cuts.values())
        if size > CELLS:
            return lambda bins: result[self.walk(bins)]
        cells = np.arange(size)
        whole = np.zeros((max(cuts, default=0) + 1, size), np.uint8)
        steps, step = [], 1
        for f, cut in cuts.items():
            # the stretches up to each cut, the one above all, and missing values
            stretch = np.searchsorted(cut, np.arange(256), "left")
            stretch[MISSING] = len(cut) + 1
            whole[f] = np.array([*cut, min(cut[-1] + 1, MISSING - 1), MISSING], np.uint8)[cells // step % (len(cut) + 2)]
            steps.append((f, stretch * step))
            step *= len(cut) + 2
        table = result[self.walk(whole)]

        def find(bins: np.ndarray) -> np.ndarray:
            at = np.zeros(bins.shape[1], np.int64)
            for f, own in steps:
                at += own[bins[f]]
            return table[at]

        return find


@dataclass
class Model:
    """A start value and trees, each of which counts ``rate`` times; values up to an edge are in its bin."""

    base: float
    rate: float
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix (rows x features), transposed."""
        return to_bins(x, self.edges)

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(np.asarray(x, float))
        return self.base + self.rate * sum((t.predict(bins) for t in self.trees), np.zeros(bins.shape[1]))


def to_bins(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty((len(edges), len(x)), np.uint8)
    for f, own in enumerate(edges):
        out[f] = np.searchsorted(own, x[:, f], "left")
        out[f, np.isnan(x[:, f])] = MISSING
    return out


# --- binned rows -------------------------------------------------------------


@dataclass(frozen=True)
class Binned:
    """Blocks of rows: bins, target, fold, number of the first row, predictions of each model."""

    blocks: DataFrame
    edges: list[np.ndarray]
    #: By fold: rows, sum of the target, least and greatest target.
    folds: dict[int, tuple[int, float, float, float]]
    #: Tasks of a pass.
    tasks: int = 1

    def rows(self) -> int:
        return sum(v[0] for v in self.folds.values())

    def size(self, models: int = 0) -> int:
        """Bytes of the blocks, with predictions of so many models."""
        return self.rows() * (len(self.edges) + 12 + 8 * models)


def bin_edges(df: DataFrame, names: Sequence[str]) -> list[np.ndarray]:
    """Ascending borders of each feature's bins.

    Up to 255 different values have a bin each, parted midway; of more, quantiles (off by a
    thousandth of the rows at most) are the upper ends of the bins.
    """
    if not names:
        return []
    x = [F.nanvl(F.col(c), F.lit(None).cast("double")) for c in names]
    # a rough count, off by a twentieth, costs a third of a finer one; the values themselves tell whether they are few
    many = df.agg(*[F.approx_count_distinct(c, 0.05).alias(f"n{i}") for i, c in enumerate(x)]).first()
    few = [i for i in range(len(names)) if many[i] <= BINS * 1.3]
    values: dict[int, list[float]] = {}
    if few:  # some 400 values at most
        found = df.agg(*[F.array_sort(F.collect_set(x[i])).alias(f"v{i}") for i in few]).first()
        values = {i: v for i, v in zip(few, found, strict=True) if len(v) <= BINS}
    rest = [i for i in range(len(names)) if i not in values]
    shares = [k / (BINS - 1) for k in range(1, BINS - 1)]
    cut = dict(zip(rest, df.select(*[x[i].alias(f"q{i}") for i in rest]).approxQuantile([f"q{i}" for i in rest], shares, 0.001), strict=True)) if rest else {}
    out = []
    for i in range(len(names)):
        if i in values:
            v = np.array(values[i], float)
            middle = v[:-1] / 2 + v[1:] / 2
            # neighbours so close that the middle is the upper one
            out.append(np.where(middle < v[1:], middle, v[:-1]))
        else:
            out.append(np.unique(np.array(cut[i], float)))
    return out


def binned(df: DataFrame, names: Sequence[str], target: str, fold: str | None = None) -> Binned:
    """Bins of the rows with a target, written; null and NaN features are missing, a null fold is 0."""
    y = F.nanvl(F.col(target).cast("double"), F.lit(None).cast("double"))
    group = F.lit(0) if fold is None else F.coalesce(F.col(fold), F.lit(0))
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], y.alias("y"), group.cast("int").alias("fold")).where("y IS NOT NULL")
    rows = kept(rows, "rows")
    columns = [f"x{i}" for i in range(len(names))]
    edges = bin_edges(rows, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                many += batch.num_rows
            if many and (batch is None or many >= ROWS):
                t = pa.Table.from_batches(held)
                x = np.column_stack([t.column(c).to_numpy() for c in columns]).astype(float) if columns else np.zeros((many, 0))
                yield pa.RecordBatch.from_pylist(
                    [{
                        "first": t.column("at")[0].as_py(), "n": many, "bins": to_bins(x, edges).tobytes(), "y": t.column("y").to_numpy().tobytes(),
                        "fold": t.column("fold").to_numpy().astype(np.int32).tobytes(), "state": b"",
                    }],
                    pa.schema([("first", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("bins", "y", "fold", "state"))]),
                )
                held, many = [], 0

    schema = "first long, n long, bins binary, y binary, fold binary, state binary"
    found = rows.groupBy("fold").agg(F.count(F.lit(1)), F.sum("y"), F.min("y"), F.max("y")).collect()
    spark = df.sparkSession
    many = math.ceil(sum(r[1] for r in found) / ROWS)
    # dealt evenly, as each pass waits for its longest task
    cores = spark.sparkContext.defaultParallelism
    waves = max(1, min(WAVES, many // (WORTH * cores)))
    tasks = max(1, min(many, max(waves * cores, math.ceil(many / READ))))
    with even(spark):
        blocks = kept(rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(run, schema).repartition(tasks), "blocks")
    return Binned(blocks, edges, {r[0]: tuple(r)[1:] for r in found}, tasks)


@contextmanager
def in_memory(data: Binned, models: int = 0) -> Iterator[None]:
    """Passes inside read the blocks from memory, unless they are large: reading files takes most of a short pass."""
    held = data.size(models) <= CACHED
    if held:
        with few_blocks(data.blocks.sparkSession, data.tasks):
            data.blocks.persist()
    try:
        yield
    finally:
        if held:
            data.blocks.unpersist()


@dataclass(frozen=True)
class Table:
    """All blocks of a table in one: bins (features x rows), target, fold and number of each row."""

    bins: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    number: np.ndarray

    def outside(self, held: int | None) -> Table:
        """The rows that a model is fitted to if it leaves a fold out."""
        return self if held is None else self.where(self.fold != held)

    def where(self, use: np.ndarray) -> Table:
        return Table(self.bins[:, use], self.y[use], self.fold[use], self.number[use])

    def filled(self, fill: np.ndarray | None) -> Table:
        return self if fill is None else replace(self, bins=filled_bins(self.bins, fill))


def filled_bins(bins: np.ndarray, fill: np.ndarray) -> np.ndarray:
    return np.where((bins == MISSING) & (fill[:, None] != MISSING), fill[:, None], bins)


@contextmanager
def sent(data: Binned) -> Iterator[Broadcast]:
    """The table sent to every worker, rows in the order of their numbers, however they are dealt."""
    rows = sorted(data.blocks.select("first", "n", "bins", "y", "fold").collect(), key=lambda r: r["first"])
    parts = [(np.frombuffer(r["bins"], np.uint8).reshape(len(data.edges), -1), np.frombuffer(r["y"]), np.frombuffer(r["fold"], np.int32), np.arange(r["first"], r["first"] + r["n"], dtype=np.uint64)) for r in rows]
    table = data.blocks.sparkSession.sparkContext.broadcast(Table(*(np.concatenate(x, -1) for x in zip(*parts, strict=True))))
    try:
        yield table
    finally:
        table.unpersist()


def each(spark: SparkSession, many: int, run: Callable[[int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``run`` makes of each number below ``many``, in a task of its own."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from run(i)

    return spark.range(0, many, 1, max(1, many)).mapInArrow(numbers, schema)


# --- growing -----------------------------------------------------------------


class Grower:
    """One tree: asks for the sums of some of its nodes until it is done.

    Nodes are split on trial as soon as their sums are known, so that a pass serves all
    leaves that may come next; ``tree`` takes the splits that were chosen.
    """

    def __init__(self, s: Settings, edges: Sequence[np.ndarray], unit: float, columns: Sequence[int], number: int = 0):
        self.s, self.unit, self.columns, self.number = s, unit, list(columns), number
        self.width = np.array([len(e) for e in edges])
        self.trial = Tree()
        self.trial.add(0.0, 0)
        self.sums: dict[int, np.ndarray] = {}  # node: 2 x features x 256
        self.depth, self.best = {0: 0}, {}
        self.asked: list[int] = [0]
        self.sibling: dict[int, tuple[int, int]] = {}
        self.chosen: list[int] = []
        self.heap: list[tuple[float, int]] = []

    def take(self, found: dict[int, np.ndarray]) -> None:
        """The sums asked for; asks for more unless the tree is done."""
        asked, self.asked = self.asked, []
        for node in asked:
            self.sums[node] = found[node]
            if node in self.sibling:
                parent, other = self.sibling[node]
                self.sums[other] = self.sums[parent] - found[node]
        known = [n for a in asked for n in ((a, self.sibling[a][1]) if a in self.sibling else (a,))]
        for node in known:
            self._weigh(node)
        for node in known:
            parent = self.sibling[node][0] if node in self.sibling else None
            self.sums.pop(parent, None)
        if self.s.leaves is None:
            for node in known:
                if node in self.best:
                    self.chosen.append(node)
                    self._split(node)
            return
        if 0 in known and 0 in self.best:
            heapq.heappush(self.heap, (-self.best[0][0], 0))
        # best first, as far as the gains of new leaves are known
        while self.heap and len(self.chosen) < self.s.leaves - 1:
            node = self.heap[0][1]
            if self.trial.left[node] < 0:
                for _, other in self.heap:
                    if self.trial.left[other] < 0:
                        self._split(other)
                if self.asked:
                    return
            children = (self.trial.left[node], self.trial.right[node])
            if any(c in self.asked or (c in self.sibling and self.sibling[c][1] in self.asked) for c in children):
                return
            heapq.heappop(self.heap)
            self.chosen.append(node)
            for c in children:
                if c in self.best:
                    heapq.heappush(self.heap, (-self.best[c][0], c))

    def _value(self, g: float, n: float) -> float:
        return -g / (n + self.s.l2) if n + self.s.l2 else 0.0

    def _weigh(self, node: int) -> None:
        """The node's value and best split: first feature, lowest bin, missing values right, of equally good ones."""
        g, n = self.sums[node][0] * self.unit, self.sums[node][1].astype(float)
        any_ = self.columns[0] if self.columns else 0
        whole, rows = (float(g[any_].sum()), float(n[any_].sum())) if len(g) else (0.0, 0.0)
        self.trial.value[node], self.trial.count[node] = self._value(whole, rows), int(rows)
        if self.s.depth is not None and self.depth[node] >= self.s.depth:
            return
        l2, least = self.s.l2, max(self.s.min_weight, self.s.min_rows, 1)
        order, tried = self.columns, len(self.columns)
        best = (LEAST_GAIN,)
        if self.s.tried is not None:
            # drawn anew at every node; if none of those tried can split it, the next that can. Any gain will do
            tried, best = self.s.tried, (1e-12 * whole * whole / max(rows, 1.0),)
            if tried < len(order):
                order = np.random.default_rng([self.s.seed, self.number, node]).permutation(order).tolist()
        for at, f in enumerate(order):
            if at >= tried and len(best) > 1:
                break
            many = self.width[f]
            gl, nl = np.cumsum(g[f, :many]), np.cumsum(n[f, :many])
            for way in (False, True) if n[f, MISSING] else (False,):
                a, b = (gl + g[f, MISSING], nl + n[f, MISSING]) if way else (gl, nl)
                fits = (b >= least) & (rows - b >= least)
                if not fits.any():
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = (a * a / (b + l2) + (whole - a) ** 2 / (rows - b + l2) - whole * whole / (rows + l2)) / 2
                gain[~fits] = -1
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, way, float(a[k]), float(b[k]))
        if len(best) > 1:
            self.best[node] = best

    def _split(self, node: int) -> None:
        """Children of the best split; asks for the smaller one unless both are too deep to be split."""
        gain, f, k, way, g, n = self.best[node]
        t, rows = self.trial, self.trial.count[node]
        whole = -t.value[node] * (rows + self.s.l2)
        left, right = t.add(self._value(g, n), int(n)), t.add(self._value(whole - g, rows - n), int(rows - n))
        t.feature[node], t.bin[node], t.missing_left[node], t.left[node], t.right[node], t.gain[node] = f, k, way, left, right, gain
        self.depth[left] = self.depth[right] = self.depth[node] + 1
        if self.s.depth is not None and self.depth[left] >= self.s.depth:
            return
        small, large = (left, right) if n <= rows - n else (right, left)
        self.sibling |= {small: (node, large), large: (node, small)}
        self.asked.append(small)

    def tree(self) -> Tree:
        """The chosen splits, in order from the root, left before right."""
        out, chosen = Tree(), set(self.chosen)

        def copy(node: int) -> int:
            at = out.add(self.trial.value[node], self.trial.count[node])
            if node in chosen:
                for name in ("feature", "bin", "missing_left", "gain"):
                    getattr(out, name)[at] = getattr(self.trial, name)[node]
                todo.append((at, "right", self.trial.right[node]))
                todo.append((at, "left", self.trial.left[node]))
            return at

        todo: list[tuple[int, str, int]] = []
        copy(0)
        while todo:
            parent, side, node = todo.pop()
            getattr(out, side)[parent] = copy(node)
        return out


@dataclass
class _Work:
    """What a task needs of one model: trees since its predictions were written, and the tree that grows."""

    s: Settings
    base: float
    fill: np.ndarray | None
    pending: list[Tree]
    trial: Tree | None = None
    asked: list[int] = field(default_factory=list)
    number: int = 0

    def uses(self, fold: np.ndarray, first: int) -> np.ndarray:
        """Whether the tree is grown from each row of a block."""
        use = np.ones(len(fold), bool) if self.s.held is None else fold != self.s.held
        if self.s.rows < 1:
            use &= drawn(first, len(fold), self.s.seed, self.number) < self.s.rows
        return use

    def times(self, first: int, n: int, known: dict) -> np.ndarray | None:
        """How often each row of a block is drawn, None: once; folds of the same tree share it by ``known``."""
        if not self.s.bootstrap:
            return None
        tag = (self.s.seed, self.number)
        if tag not in known:
            known[tag] = np.searchsorted(DRAWN, drawn(first, n, *tag), "right").astype(float)
        return known[tag]

    def shares(self, first: int = 0, end: int | None = None) -> list[Callable[[np.ndarray], np.ndarray]]:
        """What each tree since the last writing, or some of them, adds to a prediction."""
        return [t.finder(self.s.rate * np.array(t.value)) for t in self.pending[first:end]]


def drawn(first: int, n: int, seed: int, number: int) -> np.ndarray:
    """A number from 0 to 1 of each row and tree, the same in every pass."""
    return drawn_of(np.arange(first, first + n, dtype=np.uint64), seed, number)


def drawn_of(x: np.ndarray, seed: int, number: int) -> np.ndarray:
    """The same of rows with these numbers."""
    x = (x ^ np.uint64((seed * 1_000_003 + number) & (2**64 - 1))) * np.uint64(0x9E3779B97F4A7C15)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _block(row: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    n = row["n"]
    bins = np.frombuffer(row["bins"], np.uint8).reshape(features, n)
    return bins, np.frombuffer(row["y"]), np.frombuffer(row["fold"], np.int32), np.frombuffer(row["state"]).reshape(-1, n), row["first"]


def _filled(w: _Work, bins: np.ndarray, known: dict[bytes, np.ndarray]) -> np.ndarray:
    """The model's bins, missing ones filled; models that fill in the same share them by ``known``."""
    if w.fill is None:
        return bins
    tag = w.fill.tobytes()
    if tag not in known:
        known[tag] = filled_bins(bins, w.fill)
    return known[tag]


def _now(w: _Work, shares: Sequence[Callable[[np.ndarray], np.ndarray]], bins: np.ndarray, state: np.ndarray | None) -> np.ndarray:
    """The model's predictions of rows with these bins, and these predictions written down."""
    at = np.full(bins.shape[1], w.base) if state is None else state.copy()
    for share in shares:
        at += share(bins)
    return at


@contextmanager
def _set(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def even(spark: SparkSession, tasks: int | None = None):
    """Jobs started inside read files in at least ``tasks``, or ``WAVES`` a core, not in one more than there are cores."""
    return _set(spark, "spark.sql.files.minPartitionNum", tasks or WAVES * spark.sparkContext.defaultParallelism)


@contextmanager
def few_blocks(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """Jobs over blocks started inside hand a task some blocks at a time, not all that it reads."""
    with even(spark, tasks), _set(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", HELD), _set(spark, "spark.sql.inMemoryColumnarStorage.batchSize", HELD):
        yield


def _sums(blocks: DataFrame, works: Sequence[_Work], features: int, unit: float, tasks: int) -> dict[tuple[int, int], np.ndarray]:
    """Integer sums of gradients and rows by (model, node), over all blocks, which ``tasks`` tasks read."""
    size = 2 * 256 * 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {m: np.zeros((len(w.asked), features, 2, 256), np.int64) for m, w in enumerate(works) if w.asked}
        shares, start = {m: works[m].shares() for m in total}, {}
        for m in total:
            w = works[m]
            # where the sums of a node begin, -1: not asked for
            slot = np.full(len(w.trial.value), -1, np.int64)
            slot[w.asked] = np.arange(len(w.asked)) * 256
            start[m] = w.trial.finder(slot)
        for batch in batches:
            for row in batch.to_pylist():
                own, y, fold, state, first = _block(row, features)
                known: dict = {}
                for m in total:
                    w = works[m]
                    bins = _filled(w, own, known)
                    place, times = start[m](bins), w.times(first, len(y), known)
                    use = (place >= 0) & w.uses(fold, first)
                    rows = np.flatnonzero(use if times is None else use & (times > 0))
                    # a pass asks for smaller children, so most rows are out
                    bins, place, many = bins.take(rows, 1), place[rows], len(w.asked) * 256
                    g = np.rint((_now(w, shares[m], bins, state[m][rows] if len(state) else None) - y[rows]) / unit)
                    if times is not None:
                        times = times[rows]
                        g *= times
                    for f in range(features):
                        key = place + bins[f]
                        total[m][:, f, 0] += np.bincount(key, g, many).astype(np.int64).reshape(-1, 256)
                        total[m][:, f, 1] += np.bincount(key, times, many).astype(np.int64).reshape(-1, 256)
        for m, own in total.items():
            keys = [(i, f) for i in range(len(own)) for f in range(features)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m] * len(keys), pa.int32()), pa.array([i * features + f for i, f in keys], pa.int32()), pa.array([own[i, f].tobytes() for i, f in keys], pa.binary())],
                ["model", "slot", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(512, np.int64)

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["model", "slot", "sums"])

        for batch in batches:
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[:2] != now:
                    if now is not None:
                        yield one()
                    now, total = key[:2], np.zeros(512, np.int64)
                total = total + np.frombuffer(key[2], np.int64, size // 8)
        if now is not None:
            yield one()

    schema = "model int, slot int, sums binary"
    # a pass is short: no more tasks than its sums need, none for a few
    asked = sum(len(w.asked) for w in works) * features
    found = blocks.mapInArrow(count, schema)
    if asked * tasks > DIRECT:
        adders = min(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(asked / ADDED))
        found = found.repartition(max(1, adders), "model", "slot").sortWithinPartitions("model", "slot").mapInArrow(add, schema)
    out: dict[tuple[int, int], np.ndarray] = {}
    with few_blocks(blocks.sparkSession, tasks):
        rows = found.collect()
    for r in rows:
        i, f = divmod(r["slot"], features)
        own = out.setdefault((r["model"], works[r["model"]].asked[i]), np.zeros((2, features, 256), np.int64))
        own[:, f] += np.frombuffer(r["sums"], np.int64).reshape(2, 256)
    return out


def _predicted(blocks: DataFrame, works: Sequence[_Work], features: int) -> DataFrame:
    """Blocks with the predictions of all models up to now. Jobs over it belong inside ``few_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a tree's table takes memory: of many trees, some are ready at a time
        ready = [w.shares() if len(w.pending) <= PENDING else None for w in works]
        for batch in batches:
            rows = batch.to_pylist()
            blocks = [_block(row, features) for row in rows]
            known: list[dict] = [{} for _ in rows]
            out: list[list[bytes]] = [[] for _ in rows]
            for m, w in enumerate(works):
                now = [_now(w, (), own, state[m] if len(state) else None) for own, _, _, state, _ in blocks]
                for a in range(0, len(w.pending), PENDING):
                    shares = ready[m] or w.shares(a, a + PENDING)
                    for at, (own, *_), filled in zip(now, blocks, known, strict=True):
                        for share in shares:
                            at += share(_filled(w, own, filled))
                for states, at in zip(out, now, strict=True):
                    states.append(at.tobytes())
            for row, states in zip(rows, out, strict=True):
                yield pa.RecordBatch.from_pylist([row | {"state": b"".join(states)}], batch.schema)

    return blocks.mapInArrow(run, blocks.schema)


def grow(blocks: DataFrame, works: Sequence[_Work], growing: dict[int, Grower], features: int, unit: float, tasks: int) -> None:
    """Grows the trees of all models until they are done; passes are shared, as far as a task can hold their sums."""
    zero, size = np.zeros((2, features, 256), np.int64), max(1, PASS // features)
    live = dict(growing)
    for m, g in growing.items():
        works[m].trial = g.trial
    while live:
        todo = [(m, node) for m, g in live.items() for node in g.asked]
        found: dict[tuple[int, int], np.ndarray] = {}
        for a in range(0, len(todo), size):
            for w in works:
                w.asked = []
            for m, node in todo[a : a + size]:
                works[m].asked.append(node)
            found |= _sums(blocks, works, features, unit, tasks)
        for m in list(live):
            live[m].take({n: found.get((m, n), zero) for n in live[m].asked})
            if not live[m].asked:
                del live[m]
    for m in growing:
        works[m].trial, works[m].asked = None, []


def start(data: Binned, s: Settings) -> tuple[float, np.ndarray | None]:
    """Mean target of the rows that a model is fitted to, and the bins that its missing values go to."""
    used = [v for k, v in data.folds.items() if k != s.held]
    rows = sum(v[0] for v in used)
    fill = None
    if s.fill is not None:
        fill = to_bins(np.array([[np.nan if x is None else x for x in s.fill]], float), data.edges)[:, 0]
    return sum(v[1] for v in used) / rows if rows else 0.0, fill


def whole_unit(data: Binned, most: int = 36, longest: int = 60) -> float:
    """A power of two of which gradients are whole multiples: a block's sums are exact, and all rows' fit a long."""
    spread = max((v[3] for v in data.folds.values()), default=0.0) - min((v[2] for v in data.folds.values()), default=0.0)
    bits = min(most, longest - sum(v[0] for v in data.folds.values()).bit_length())
    return 2.0 ** (math.frexp(spread or 1.0)[1] - bits)


def _node_sums(table: Table, g: np.ndarray, rows: np.ndarray, columns: Sequence[int]) -> np.ndarray:
    """The sums of a node from its rows, some at a time so that they are exact."""
    out = np.zeros((2, len(table.bins), 256), np.int64)
    for a in range(0, len(rows), ROWS):
        own = rows[a : a + ROWS]
        pull = g[own]
        for f in columns:
            x = table.bins[f][own]
            out[0, f] += np.bincount(x, pull, 256).astype(np.int64)
            out[1, f] += np.bincount(x, minlength=256)
    return out


def _alone(table: Table, s: Settings, base: float, edges: Sequence[np.ndarray], unit: float) -> Iterator[Tree]:
    """The trees of one model from rows that are all here: the same sums, so the same trees, as by passes."""
    features, chance, now = len(edges), random.Random(s.seed), np.full(len(table.y), base)
    every = np.arange(len(table.y))
    for number in range(s.rounds):
        grower = Grower(s, edges, unit, sorted(chance.sample(range(features), max(1, round(s.columns * features)))))
        g, t = np.rint((now - table.y) / unit), grower.trial
        rows = {0: every if s.rows >= 1 else np.flatnonzero(drawn_of(table.number, s.seed, number) < s.rows)}
        while grower.asked:
            found = {}
            for node in grower.asked:
                if node not in rows:
                    parent = grower.sibling[node][0]
                    own = rows.pop(parent)
                    x = table.bins[t.feature[parent]][own]
                    go = x <= t.bin[parent]
                    if t.missing_left[parent]:
                        go |= x == MISSING
                    rows[t.left[parent]], rows[t.right[parent]] = own[go], own[~go]
                found[node] = _node_sums(table, g, rows[node], grower.columns)
            grower.take(found)
        tree = grower.tree()
        now += tree.finder(s.rate * np.array(tree.value))(table.bins)
        yield tree


_TREE = {"feature": pa.int32(), "bin": pa.int32(), "missing_left": pa.bool_(), "left": pa.int32(), "right": pa.int32(), "value": pa.float64(), "gain": pa.float64(), "count": pa.int64()}


def _fit_apart(data: Binned, works: Sequence[_Work], unit: float) -> None:
    """Grows all trees of each model in a task of its own, which has the whole table."""
    edges = data.edges
    with sent(data) as table:

        def run(m: int) -> Iterator[pa.RecordBatch]:
            w = works[m]
            own = table.value.outside(w.s.held).filled(w.fill)
            for number, tree in enumerate(_alone(own, w.s, w.base, edges, unit)):
                lists = [pa.array([getattr(tree, c)], pa.list_(kind)) for c, kind in _TREE.items()]
                yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([number], pa.int32()), *lists], ["model", "number", *_TREE])

        names = {pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.int64(): "bigint"}
        found = each(data.blocks.sparkSession, len(works), run, ", ".join(["model int", "number int", *(f"{c} array<{names[kind]}>" for c, kind in _TREE.items())]))
        for r in sorted(found.collect(), key=lambda r: (r["model"], r["number"])):
            works[r["model"]].pending.append(Tree(**{c: list(r[c]) for c in _TREE}))


def fit_many(data: Binned, settings: Sequence[Settings]) -> tuple[list[Model], DataFrame]:
    """Fit all models together; also the blocks with every model's final predictions, worked out when read.

    All models take a pass for the same level of the same tree, so folds and draws cost
    passes once. Trees of fewer rounds are done earlier. Many rounds over a table that a task can hold
    take no passes: every model is grown in a task, to the same trees.
    """
    features, edges = len(data.edges), data.edges
    models, works, chance = [], [], []
    for s in settings:
        base, fill = start(data, s)
        models.append(Model(base, s.rate, edges))
        works.append(_Work(s, base, fill, []))
        chance.append(random.Random(s.seed))
    rows = data.rows()
    unit = whole_unit(data)
    if features and rows and data.size() <= SENT and max((s.rounds for s in settings), default=0) >= LONG:
        _fit_apart(data, works, unit)
        for model, w in zip(models, works, strict=True):
            model.trees = list(w.pending)
        return models, _predicted(data.blocks, works, features)
    blocks, cached = data.blocks, data.size(len(works)) <= CACHED
    for number in range(max((s.rounds for s in settings), default=0) if features and rows else 0):
        growing: dict[int, Grower] = {}
        for m, (s, w) in enumerate(zip(settings, works, strict=True)):
            if number < s.rounds:
                many = max(1, round(s.columns * features))
                growing[m] = Grower(s, edges, unit, sorted(chance[m].sample(range(features), many)))
                w.number = number
        grow(blocks, works, growing, features, unit, data.tasks)
        for m, g in growing.items():
            tree = g.tree()
            models[m].trees.append(tree)
            works[m].pending.append(tree)
        if max(len(w.pending) for w in works) >= PENDING:
            with few_blocks(blocks.sparkSession, data.tasks):
                written = kept(_predicted(blocks, works, features), "blocks")
                if blocks is not data.blocks:
                    blocks.unpersist()
                blocks = written.persist() if cached else written
            for w in works:
                w.pending = []
    if blocks is not data.blocks:
        blocks.unpersist()
    # not written: who only wants the trees doesn't read them
    return models, _predicted(blocks, works, features)


def held_out_rmse(blocks: DataFrame, settings: Sequence[Settings], features: int) -> list[float]:
    """Root mean squared error of each model on the fold that it left out; NaN where that has no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, y, fold, state, _ = _block(row, features)
                gap = [(state[m] - y)[fold == s.held] for m, s in enumerate(settings)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(gap)), pa.int32()), pa.array([float((x * x).sum()) for x in gap]), pa.array([len(x) for x in gap], pa.int64())], ["model", "squares", "n"]
                )

    found = blocks.mapInArrow(run, "model int, squares double, n long").groupBy("model").agg(F.sum("squares").alias("s"), F.sum("n").alias("n"))
    with few_blocks(blocks.sparkSession):
        by = {r["model"]: math.sqrt(r["s"] / r["n"]) if r["n"] else math.nan for r in found.collect()}
    return [by.get(m, math.nan) for m in range(len(settings))]


def out_of_fold(blocks: DataFrame, settings: Sequence[Settings], names: Sequence[str], features: int) -> DataFrame:
    """model (its name), fold, y and yhat of every row, from the models that left its fold out.

    Jobs over it belong inside ``few_blocks``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, y, fold, state, _ = _block(row, features)
                for m, s in enumerate(settings):
                    own = fold == s.held
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[m]] * int(own.sum()), pa.string()), pa.array(fold[own]), pa.array(y[own]), pa.array(state[m][own])], ["model", "fold", "y", "yhat"]
                    )

    return blocks.mapInArrow(run, "model string, fold int, y double, yhat double")


def out_of_fold_errors(blocks: DataFrame, settings: Sequence[Settings], names: Sequence[str], features: int, centres: dict[int, float]) -> DataFrame:
    """``errors.SUMS`` of each model (its name) on the fold that it left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, y, fold, state, _ = _block(row, features)
                some = ((names[m], s.held, y[fold == s.held], state[m][fold == s.held]) for m, s in enumerate(settings))
                yield errors.batch(errors.sums(n, i, a, b, centres) for n, i, a, b in some)

    return blocks.mapInArrow(run, errors.SUMS)


def search(
    df: DataFrame, names: Sequence[str], target: str, fold: str, draws: Sequence[Settings], fills: dict[int, tuple[float | None, ...]], together: int = 30
) -> list[float]:
    """Mean RMSE over the folds of ``fills`` for each draw.

    The table is binned once. ``together`` models are fitted in the same passes: a pass holds
    their predictions of a block, 8 bytes a row and model.
    """
    data = binned(df, names, target, fold)
    wanted = [replace(s, held=k, fill=f) for s in draws for k, f in sorted(fills.items())]
    means: list[float] = []
    # models of like length together, so that short ones don't wait
    order = sorted(range(len(wanted)), key=lambda i: (wanted[i].rounds, i))
    got: dict[int, float] = {}
    for a in range(0, len(order), together):
        some = order[a : a + together]
        with in_memory(data):
            _, blocks = fit_many(data, [wanted[i] for i in some])
            got |= dict(zip(some, held_out_rmse(blocks, [wanted[i] for i in some], len(names)), strict=True))
    k = len(fills)
    for d in range(len(draws)):
        own = [got[d * k + i] for i in range(k) if not math.isnan(got[d * k + i])]
        means.append(sum(own) / len(own) if own else math.nan)
    return means


# --- as a pipeline stage -----------------------------------------------------


def to_mllib(model: Model, spark: SparkSession, features: str, label: str) -> GBTRegressionModel:
    """The same trees as an MLlib boosted model. It has no way for missing values: they must be filled before.

    The start value is a tree of one leaf, which counts once.
    """
    path, version = scratch_path(spark, "boosted"), spark.version
    stamp = int(time.time() * 1000)

    def metadata(kind: str, uid: str, estimator: str, **more: object) -> str:
        defaults = GBTRegressor()
        known = {p.name: defaults.getOrDefault(p) for p in defaults.params if defaults.hasDefault(p)}
        if estimator == "dtr":
            for name in ("lossType", "maxIter", "stepSize", "subsamplingRate", "validationTol", "featureSubsetStrategy"):
                known.pop(name, None)
        own = {"labelCol": label, "featuresCol": features} | ({"maxIter": max(1, len(model.trees)), "stepSize": model.rate} if estimator == "gbt" else {})
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": stamp, "sparkVersion": version, "uid": uid, "paramMap": own, "defaultParamMap": known} | more)

    start = Tree()
    start.add(model.base, model.trees[0].count[0] if model.trees else 1)
    trees = [(start, 1.0), *((t, model.rate) for t in model.trees)]
    about = [(i, metadata("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", "dtr", numFeatures=len(model.edges)), w) for i, (_, w) in enumerate(trees)]
    nodes = []
    for i, (t, _) in enumerate(trees):
        for k, n in enumerate(t.count):
            f = t.feature[k]
            split = (f, [float(model.edges[f][t.bin[k]])], -1) if f >= 0 else (-1, [], -1)
            # MLlib weighs a gain by the rows of its node
            gain = t.gain[k] / n if f >= 0 and n else -1.0
            nodes.append((i, (k, t.value[k], 0.0, [float(n), n * t.value[k], n * t.value[k] ** 2], n, gain, t.left[k], t.right[k], split)))
    node = "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
    main = metadata("GBTRegressionModel", f"GBTRegressor_{uuid.uuid4().hex[:12]}", "gbt", numFeatures=len(model.edges), numTrees=len(trees))
    spark.createDataFrame([(main,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(about, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes, f"treeID int, nodeData {node}").coalesce(1).write.parquet(f"{path}/data")
    return GBTRegressionModel.load(path)


class BoostedTrees(Estimator):
    """A pipeline stage over an assembled vector without missing values; fits to an MLlib model."""

    def __init__(self, target: str, settings: Settings, features: str = "features") -> None:
        super().__init__()
        self.target, self.settings, self.features = target, settings, features

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        first = dataset.select(self.features).first()
        many = len(first[0]) if first is not None else 0
        values = vector_to_array(F.col(self.features))
        names = [f"x{i}" for i in range(many)]
        rows = dataset.select(*[values[i].alias(c) for i, c in enumerate(names)], F.col(self.target).alias("y"))
        data = binned(rows, names, "y")
        with in_memory(data):
            models, _ = fit_many(data, [self.settings])
        if any(any(t.missing_left) for t in models[0].trees):
            raise ValueError("fill missing values before fitting")
        return to_mllib(models[0], dataset.sparkSession, self.features, self.target)


def scored(df: DataFrame, model: Model, names: Sequence[str], out: str = "prediction") -> DataFrame:
    """``df`` with the model's prediction; null and NaN features go the way that was learned."""
    schema = df.drop(out).schema.add(out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names])
            table = pa.Table.from_batches([batch])
            yield from table.append_column(out, pa.array(model.predict(x))).to_batches()

    return df.drop(out).mapInArrow(run, schema)
