"""Random forests whose trees have no depth limit, on binned rows.

The upper part of a tree is grown by passes over the rows, as long as a node holds more rows
than a task should (``task_rows``): sums by (node, feature, bin), of which only those of
the nodes of one pass reach the driver. The rows of every smaller node are then sent to one
task, which finishes the subtree there, level by level for all its nodes at once. Subtrees are
written by the tasks; the driver never lists their nodes.

The fitted forest is an MLlib model, so it is saved, scored and explained as any. Its nodes are
numbered in the order in which they are made, not by their place in a full binary tree, so
no depth overflows.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arealis.plans import boosting, errors
from arealis.plans.boosting import DRAWN, MISSING, PASS, Binned, Tree, binned, drawn_of
from arealis.session import kept, scratch_path

#: Levels that forests of several folds are grown together to, and trees in the same passes.
LEVELS, TOGETHER = 8, 100
#: Tasks a core that share the trees of a table that each of them holds.
SHARES = 8

_NODE = (
    "struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
_PART = "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, gain array<double>, count array<bigint>"


@dataclass(frozen=True)
class Settings:
    """``depth`` None: a node is split until its rows have one target or can't be told apart.

    ``bootstrap`` draws each row a Poisson number of times a tree; ``min_leaf`` counts drawn
    rows. ``features`` is the number tried at a split: ``all``, ``sqrt``, ``log2`` or a share; if none
    of them can split a node, more are tried, in drawn order. ``together`` trees have their rows
    sent at the same time.
    """

    trees: int = 200
    depth: int | None = None
    min_leaf: int = 1
    features: str | float = 1.0
    bootstrap: bool = True
    seed: int = 42
    task_rows: int = 1 << 15
    together: int = 20
    #: The fold left out.
    held: int | None = None

    def tried(self, features: int) -> int:
        share = {"all": 1.0, "sqrt": math.sqrt(features) / features, "log2": math.log2(max(features, 2)) / features}.get(self.features, self.features)
        return max(1, min(features, int(float(share) * features + 1e-9)))

    def weights(self, number: np.ndarray, fold: np.ndarray, tree: int) -> np.ndarray:
        """How often each row (its number and fold) is drawn for a tree; the same in every pass."""
        w = np.searchsorted(DRAWN, drawn_of(number, self.seed, tree), "right") if self.bootstrap else np.ones(len(number), np.int64)
        if self.held is not None:
            w[fold == self.held] = 0
        return w


def _first(gain: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """Where a gain is as good as the best: sums of other order differ in their last digits."""
    return gain >= (gain.max(0) if most is None else most) * (1 - 1e-9)


def _pick(gain: np.ndarray, order: np.ndarray, tried: int) -> np.ndarray:
    """The feature of each node (features x nodes, -1: can't split): the best of those tried, or the first that can."""
    inside = np.where((order < tried) & (gain >= 0), gain, -1.0)
    best = _first(inside).argmax(0)
    none = inside.max(0) < 0
    if none.any():
        later = np.where(gain[:, none] >= 0, order[:, none], len(gain))
        best[none] = np.where(later.min(0) < len(gain), later.argmin(0), -1)
    return best


def _order(rng: np.random.Generator, features: int, nodes: int) -> np.ndarray:
    return rng.random((nodes, features)).argsort(1).argsort(1).T


# --- the upper part ----------------------------------------------------------


@dataclass
class _Top:
    """A tree as far as passes have grown it: nodes to be split next, and those that a task finishes."""

    tree: Tree = field(default_factory=Tree)
    depth: list[int] = field(default_factory=list)
    asked: list[int] = field(default_factory=list)
    small: list[int] = field(default_factory=list)

    def add(self, value: float, count: int, depth: int, s: Settings) -> int:
        at = self.tree.add(value, count)
        self.depth.append(depth)
        (self.asked if count > s.task_rows else self.small).append(at)
        return at


def _block(row: dict, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, target, fold and number of a block's rows."""
    bins, y, fold, _, first = boosting._block(row, features)
    return bins, y, fold, np.arange(first, first + len(y), dtype=np.uint64)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles whose bits they hold; of such numbers, the bits."""
    bits = (x + 0.0 if x.dtype == float else x).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def _rows_of(tree: Tree, bins: np.ndarray, nodes: Sequence[int], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drawn rows that end in one of ``nodes``, and the place of their node in that list."""
    slot = np.full(len(tree.value), -1, np.int64)
    slot[list(nodes)] = np.arange(len(nodes))
    place = slot[tree.walk(bins)]
    rows = np.flatnonzero((place >= 0) & (w > 0))
    return rows, place[rows]


def _sums(blocks: DataFrame, work: dict[int, tuple[Tree, list[int]]], s: Settings, features: int, base: float, unit: float) -> dict[tuple[int, int], np.ndarray]:
    """By (tree, node): whole-numbered sums of the target and of rows by feature and bin; in one more row the extremes."""
    width = features + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {t: np.zeros((len(nodes), width, 2, 256), np.int64) for t, (_, nodes) in work.items()}
        for own in total.values():
            own[:, features] = np.iinfo(np.int64).min
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, fold, number = _block(row, features)
                q = np.rint((y - base) / unit)
                for t, (tree, nodes) in work.items():
                    w = s.weights(number, fold, t)
                    rows, place = _rows_of(tree, bins, nodes, w)
                    own = total[t]
                    np.maximum.at(own[:, features, 0, 0], place, _ordered(-y[rows]))
                    np.maximum.at(own[:, features, 1, 0], place, _ordered(y[rows]))
                    for f in range(features):
                        key = place * 256 + bins[f][rows]
                        for k, what in enumerate((q[rows] * w[rows], w[rows])):
                            own[:, f, k] += np.bincount(key, what, len(nodes) * 256).astype(np.int64).reshape(-1, 256)
        for t, own in total.items():
            keys = [(i, f) for i in range(len(own)) for f in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(keys), pa.int32()), pa.array([i * width + f for i, f in keys], pa.int32()), pa.array([own[i, f].tobytes() for i, f in keys], pa.binary())],
                ["tree", "slot", "sums"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (t, slot), group in itertools.groupby(rows, lambda r: r[:2]):
            join = np.maximum if slot % width == features else np.add
            total = None
            for r in group:
                x = np.frombuffer(r[2], np.int64)
                total = x if total is None else join(total, x)
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["tree", "slot", "sums"])

    schema = "tree int, slot int, sums binary"
    spread = blocks.mapInArrow(count, schema).repartition("tree", "slot").sortWithinPartitions("tree", "slot")
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in spread.mapInArrow(add, schema).collect():
        i, f = divmod(r["slot"], width)
        own = out.setdefault((r["tree"], work[r["tree"]][1][i]), np.zeros((width, 2, 256), np.int64))
        own[f] = np.frombuffer(r["sums"], np.int64).reshape(2, 256)
    return out


def _split(top: _Top, t: int, node: int, found: np.ndarray, s: Settings, base: float, unit: float) -> None:
    """Splits a node by its sums; a node of one target, or at the depth, stays a leaf."""
    g, n = found[:-1, 0] * unit, found[:-1, 1].astype(float)
    # the greatest of -y and of y
    low, high = _ordered(-_ordered(found[-1, 0, :1]).view(float))[0], found[-1, 1, 0]
    if low >= high or (s.depth is not None and top.depth[node] >= s.depth):
        return
    rows = n[0].sum()
    g = g - n * (g[0].sum() / rows)  # about the node's mean
    gl, nl = np.cumsum(g, 1), np.cumsum(n, 1)
    fits = (n > 0) & (nl >= s.min_leaf) & (rows - nl >= s.min_leaf) & (nl < rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fits, gl * gl / nl + gl * gl / (rows - nl), -1.0)
    f = int(_pick(gain.max(1)[:, None], _order(np.random.default_rng([s.seed, t, 1, node]), len(g), 1), s.tried(len(g)))[0])
    if f < 0:
        return
    k = int(_first(gain[f]).argmax())
    after = k + 1 + int((n[f, k + 1 :] > 0).argmax())
    tree = top.tree
    mean, many, pull = tree.value[node], int(nl[f, k]), float(gl[f, k])
    left = top.add(mean + pull / many, many, top.depth[node] + 1, s)
    right = top.add(mean - pull / (int(rows) - many), int(rows) - many, top.depth[node] + 1, s)
    tree.feature[node], tree.bin[node], tree.left[node], tree.right[node], tree.gain[node] = f, (k + after) // 2, left, right, float(gain[f, k])


def tops(data: Binned, s: Settings) -> list[_Top]:
    """All trees down to nodes of at most ``task_rows`` drawn rows."""
    rows, total, low, high = (f(v) for f, v in zip((sum, sum, min, max), zip(*data.folds.values(), strict=True), strict=True))
    base, features = total / rows, len(data.edges)
    bits = min(32, 58 - (rows * 4).bit_length())
    unit = 2.0 ** (math.frexp((high - low) or 1.0)[1] - bits)
    out = []
    for _ in range(s.trees):
        top = _Top()
        # a forest's first node is asked for whenever the table is larger than a task
        top.add(base, rows * (2 if s.bootstrap else 1) if rows > s.task_rows else rows, 0, s)
        out.append(top)
    while any(top.asked for top in out) and features:
        todo = [(t, node) for t, top in enumerate(out) for node in top.asked]
        for top in out:
            top.asked = []
        size = max(1, PASS // (features + 1))
        for a in range(0, len(todo), size):
            work = {t: (out[t].tree, [node for _, node in some]) for t, some in itertools.groupby(todo[a : a + size], lambda x: x[0])}
            for (t, node), found in sorted(_sums(data.blocks, work, s, features, base, unit).items(), key=lambda x: x[0]):
                many = int(found[0, 1].sum())
                if many:
                    out[t].tree.value[node], out[t].tree.count[node] = base + unit * float(found[0, 0].sum()) / many, many
                    _split(out[t], t, node, found, s, base, unit)
    return out


# --- subtrees in tasks -------------------------------------------------------


def subtree(bins: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings, depth: int | None, rng: np.random.Generator) -> Tree:
    """The whole tree below a node, from its rows (``bins``: features x rows), a level at a time."""
    tried = s.tried(len(bins)) if len(bins) else 0
    # by level, the columns of a tree: feature, bin, left, right, value, gain, count
    levels: list[list[np.ndarray]] = []
    size, done, node = 1, 0, np.zeros(len(y), np.int64)
    while size:
        n = np.bincount(node, w, size)
        low, high = np.full(size, np.inf), np.full(size, -np.inf)
        np.minimum.at(low, node, y)
        np.maximum.at(high, node, y)
        mean = np.where(low == high, low, np.bincount(node, w * y, size) / n)
        none = np.full(size, -1, np.int64)
        level = [none, np.zeros(size, np.int64), none.copy(), none.copy(), mean, np.zeros(size), n.astype(np.int64)]
        levels.append(level)
        done += size
        can = (low < high) & (n >= 2 * s.min_leaf)
        if not can.any() or tried == 0 or depth == 0:
            break
        ids = np.flatnonzero(can)
        stay = can[node]
        bins, y, w, node = bins[:, stay], y[stay], w[stay], (np.cumsum(can) - 1)[node[stay]]
        # in units of the node's own spread, as sums run on through all nodes
        n, spread = n[can], (high - low)[can]
        pull = w * (y - mean[can][node]) / spread[node]
        gain, cut = np.full((len(bins), len(ids)), -1.0), np.zeros((len(bins), len(ids)), np.int64)
        at_row = np.arange(len(node))
        for f, own in enumerate(bins):
            # rows by node and bin, those of a bin in their order: numbers are sorted faster than their places
            packed = (node * 256 + own) << 32 | at_row
            packed.sort()
            order, key = packed & 0xFFFFFFFF, packed >> 32
            end = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
            of, value = key[end] // 256, key[end] % 256
            g, c = np.cumsum(pull[order])[end], np.cumsum(w[order])[end].astype(float)
            last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)
            g, c = g - np.append(0.0, g[last][:-1])[of], c - np.append(0.0, c[last][:-1])[of]
            at = np.flatnonzero(of[1:] == of[:-1])
            at = at[(c[at] >= s.min_leaf) & (n[of[at]] - c[at] >= s.min_leaf)]
            score = g[at] ** 2 / c[at] + g[at] ** 2 / (n[of[at]] - c[at])
            np.maximum.at(gain[f], of[at], score)
            hit = at[_first(score, gain[f][of[at]])][::-1]  # the lowest cut of equally good ones is set last
            cut[f][of[hit]] = (value[hit] + value[hit + 1]) // 2
        best = _pick(gain, _order(rng, len(bins), len(ids)), tried)
        parents = np.flatnonzero(best >= 0)
        if not len(parents):
            break
        new, i, f = np.full(len(ids), -1), ids[parents], best[parents]
        new[parents] = np.arange(len(parents))
        level[0][i], level[1][i], level[5][i] = f, cut[f, parents], gain[f, parents] * spread[parents] ** 2
        level[2][i], level[3][i] = done + 2 * new[parents], done + 2 * new[parents] + 1
        stay = new[node] >= 0
        bins, y, w, node = bins[:, stay], y[stay], w[stay], node[stay]
        right = bins[best[node], np.arange(len(node))] > cut[best[node], node]
        size, node = 2 * len(parents), 2 * new[node] + right
        depth = None if depth is None else depth - 1
    feature, cuts, left, right, value, gains, count = (np.concatenate(x).tolist() for x in zip(*levels, strict=True))
    return Tree(feature, cuts, [False] * len(value), left, right, value, gains, count)


def _thresholds(tree: Tree, edges: Sequence[np.ndarray]) -> list[float]:
    """The greatest value that goes left; only missing ones go right of the last bin."""
    return [float(edges[f][b]) if f >= 0 and b < len(edges[f]) else math.inf if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.bin, strict=True)]


def subtrees(data: Binned, out: Sequence[_Top], s: Settings) -> DataFrame:
    """tree, node of its upper part, and the arrays of the nodes below it, for every node that is small enough.

    A group is at most ``task_rows`` drawn rows, whatever the table, and travels as packed
    pieces of blocks. ``together`` trees are sent at a time.
    """
    features, edges = len(data.edges), data.edges
    parts = None
    for a in range(0, len(out), s.together):
        some = {t: (out[t].tree, out[t].small, out[t].depth) for t in range(a, min(len(out), a + s.together))}

        def deal(batches: Iterator[pa.RecordBatch], some: dict = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    bins, y, fold, number = _block(row, features)
                    first = row["first"]
                    for t, (tree, small, _) in some.items():
                        w = s.weights(number, fold, t)
                        rows, place = _rows_of(tree, bins, small, w)
                        order = np.argsort(place, kind="stable")
                        rows, place = rows[order], place[order]
                        pieces = np.split(rows, np.flatnonzero(place[1:] != place[:-1]) + 1) if len(rows) else []
                        ends = [small[place[i]] for i in np.cumsum([0, *map(len, pieces[:-1])])] if pieces else []
                        held = [{"tree": t, "node": e, "at": first, "n": len(p), "bins": bins[:, p].tobytes(), "y": y[p].tobytes(), "w": w[p].astype(np.uint8).tobytes()} for e, p in zip(ends, pieces, strict=True)]
                        if held:
                            yield pa.RecordBatch.from_pylist(held, pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("at", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("bins", "y", "w"))]))

        def finish(batches: Iterator[pa.RecordBatch], some: dict = some) -> Iterator[pa.RecordBatch]:
            pieces = (r for b in batches for r in b.to_pylist())
            for (t, node), group in itertools.groupby(pieces, lambda r: (r["tree"], r["node"])):
                group = list(group)
                bins = np.concatenate([np.frombuffer(r["bins"], np.uint8).reshape(features, r["n"]) for r in group], axis=1)
                y, w = (np.concatenate([np.frombuffer(r[c], kind) for r in group]) for c, kind in (("y", float), ("w", np.uint8)))
                left = None if s.depth is None else s.depth - some[t][2][node]
                tree = subtree(bins, y, w.astype(np.int64), s, left, np.random.default_rng([s.seed, t, 0, node]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t], pa.int32()), pa.array([node], pa.int32()), *(pa.array([x], pa.list_(kind)) for x, kind in (
                        (tree.feature, pa.int32()), (_thresholds(tree, edges), pa.float64()), (tree.left, pa.int32()), (tree.right, pa.int32()),
                        (tree.value, pa.float64()), (tree.gain, pa.float64()), (tree.count, pa.int64())))],
                    ["tree", "node", "feature", "threshold", "left", "right", "value", "gain", "count"],
                )

        sent = data.blocks.mapInArrow(deal, "tree int, node int, at long, n long, bins binary, y binary, w binary")
        done = sent.repartition("tree", "node").sortWithinPartitions("tree", "node", "at").mapInArrow(finish, f"tree int, node int, {_PART}")
        done = kept(done, "subtrees")
        parts = done if parts is None else parts.unionByName(done)
    return parts


# --- forests of several folds ------------------------------------------------


@dataclass(frozen=True)
class Held:
    """A forest fitted to the rows outside one fold, missing values filled in."""

    name: str
    held: int
    base: float
    fill: np.ndarray | None
    trees: list[Tree]


def fit_folds(data: Binned, wanted: Sequence[tuple[str, Settings, int, Sequence[float]]]) -> list[Held]:
    """Forests of at most ``LEVELS`` levels by (name, settings, fold left out, what stands for missing values).

    All grow by the same passes over the blocks, a level at a time: sums by node, feature and
    bin, of the smaller child of a split only. A tree draws the same rows whichever fold is left out.
    """
    features, unit = len(data.edges), boosting.whole_unit(data, 32, 56)
    out, works = [], []
    for name, s, held, fill in wanted:
        own = boosting.Settings(
            rounds=1, rate=1.0, leaves=None, depth=s.depth, l2=0.0, min_weight=0.0, min_rows=s.min_leaf, seed=s.seed,
            held=held, fill=tuple(fill), bootstrap=s.bootstrap, tried=s.tried(features),
        )
        base, bins = boosting.start(data, own)
        out.append(Held(name, held, base, bins, []))
        works += [(out[-1], boosting._Work(own, base, bins, [], number=t)) for t in range(s.trees)]
    for a in range(0, len(works) if features and data.folds else 0, TOGETHER):
        some = [w for _, w in works[a : a + TOGETHER]]
        growing = {m: boosting.Grower(w.s, data.edges, unit, range(features), w.number) for m, w in enumerate(some)}
        boosting.grow(data.blocks, some, growing, features, unit, data.tasks)
        for m, (forest, _) in enumerate(works[a : a + TOGETHER]):
            forest.trees.append(growing[m].tree())
    return out


def out_of_fold_errors(data: Binned, forests: Sequence[Held], centres: dict[int, float]) -> DataFrame:
    """``errors.SUMS`` of each forest on the fold that it left out. Jobs over it belong inside ``few_blocks``."""
    features = len(data.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(f, [t.finder(np.array(t.value)) for t in f.trees]) for f in forests]
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, fold, _, _ = boosting._block(row, features)
                out = []
                for f, finders in ready:
                    rows = np.flatnonzero(fold == f.held)
                    own = bins.take(rows, 1)
                    if f.fill is not None:
                        own = np.where((own == MISSING) & (f.fill[:, None] != MISSING), f.fill[:, None], own)
                    yhat = f.base + sum((find(own) for find in finders), np.zeros(len(rows))) / max(1, len(finders))
                    out.append(errors.sums(f.name, f.held, y[rows], yhat, centres))
                yield errors.batch(out)

    return data.blocks.mapInArrow(run, errors.SUMS)


def deep_errors(data: Binned, wanted: Sequence[tuple[str, Settings, int, Sequence[float]]], centres: dict[int, float]) -> DataFrame:
    """Sums of errors, worked out, of forests of any depth by (name, settings, fold left out, what stands for missing values).

    No forest is ever in one place: a tree's held-out predictions are added to those of the trees before and
    the tree is forgotten. Of a table that a task can hold every tree is grown in a task; of a larger one
    the tasks that finish a node's subtree predict the held-out rows that come there.
    """
    forests, features = [], len(data.edges)
    for name, s, held, fill in wanted:
        own = replace(s, held=held)
        base, bins = boosting.start(data, boosting.Settings(held=held, fill=tuple(fill)))
        if held in data.folds:
            forests.append((name, own, base, bins))
    spark = data.blocks.sparkSession
    if not features or not forests:  # without rows there is nothing to measure; without features a tree is its mean
        return errors.collected(out_of_fold_errors(data, [Held(n, s.held, base, fill, []) for n, s, base, fill in forests], centres))
    if data.size() <= boosting.SENT:
        with boosting.sent(data) as table:
            return errors.collected(_errors_here(spark, table, forests, centres))
    found = None
    with boosting.few_blocks(spark, data.tasks):
        for name, s, base, fill in forests:
            one = errors.collected(_errors_apart(data, name, s, base, fill, centres))
            found = one if found is None else found.unionByName(one)
    return found


def _errors_here(spark: SparkSession, table: Broadcast, forests: Sequence[tuple[str, Settings, float, np.ndarray]], centres: dict[int, float]) -> DataFrame:
    """``errors.SUMS`` of forests whose trees are grown in tasks that have the whole table, some trees a task."""
    share = max(1, math.ceil(sum(s.trees for _, s, _, _ in forests) / (SHARES * spark.sparkContext.defaultParallelism)))
    jobs = [(m, a, min(s.trees, a + share)) for m, (_, s, _, _) in enumerate(forests) for a in range(0, s.trees, share)]

    def run(j: int) -> Iterator[pa.RecordBatch]:
        m, first, end = jobs[j]
        _, s, base, fill = forests[m]
        rows = table.value.filled(fill)
        held, own = rows.where(rows.fold == s.held), rows.outside(s.held)
        total = np.zeros(len(held.y))
        for t in range(first, end):
            w = s.weights(own.number, own.fold, t)
            use = w > 0
            if use.any():
                total += subtree(own.bins[:, use], own.y[use], w[use], s, s.depth, np.random.default_rng([s.seed, t, 0, 0])).predict(held.bins)
            else:
                total += base
        yield pa.RecordBatch.from_arrays([pa.array([m], pa.int32()), pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["forest", "part", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for m, group in itertools.groupby(rows, lambda r: r["forest"]):
            name, s, _, _ = forests[m]
            total = sum(np.frombuffer(r["total"]) for r in group)
            y = table.value.y[table.value.fold == s.held]
            yield errors.batch([errors.sums(name, s.held, y, total / s.trees, centres)])

    parts = boosting.each(spark, len(jobs), run, "forest int, part int, total binary")
    tasks = min(len(forests), spark.sparkContext.defaultParallelism)
    return parts.repartition(tasks, "forest").sortWithinPartitions("forest", "part").mapInArrow(add, errors.SUMS)


_HELD = "at long, tree int, node int, place binary, y binary, total binary"


def _by_node(rows: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows that end in each node."""
    order = np.argsort(ends, kind="stable")
    rows, ends = rows[order], ends[order]
    for own in np.split(np.arange(len(rows)), np.flatnonzero(ends[1:] != ends[:-1]) + 1) if len(rows) else []:
        yield int(ends[own[0]]), rows[own]


def _bins(piece: dict, features: int) -> np.ndarray:
    return np.frombuffer(piece["bins"], np.uint8).reshape(features, piece["n"])


def _errors_apart(data: Binned, name: str, s: Settings, base: float, fill: np.ndarray | None, centres: dict[int, float]) -> DataFrame:
    """``errors.SUMS`` of a forest over a table of any size, from predictions added up ``together`` trees at a time.

    A node's drawn rows come to its task first, held-out rows after them, piece by piece.
    """
    features = len(data.edges)

    def fills(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["bins"] = boosting.filled_bins(_block(row, features)[0], fill).tobytes()
                yield pa.RecordBatch.from_pylist([row], batch.schema)

    blocks = data.blocks if fill is None else data.blocks.mapInArrow(fills, data.blocks.schema)
    own = replace(data, blocks=blocks, folds={i: v for i, v in data.folds.items() if i != s.held})
    if own.folds:
        out = tops(own, s)
    else:
        out = [_Top() for _ in range(s.trees)]
        for top in out:
            top.add(base, 0, 0, s)
    sent_schema = pa.schema([*((c, pa.int32()) for c in ("tree", "node", "held")), ("at", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("bins", "y", "w", "place"))])
    held_schema = pa.schema([("at", pa.int64()), ("tree", pa.int32()), ("node", pa.int32()), *((c, pa.binary()) for c in ("place", "y", "total"))])
    sums = None
    for a in range(0, len(out), s.together):
        some = {t: (out[t].tree, out[t].small, out[t].depth) for t in range(a, min(len(out), a + s.together))}

        def deal(batches: Iterator[pa.RecordBatch], some: dict = some) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    bins, y, fold, number = _block(row, features)
                    left_out = np.flatnonzero(fold == s.held)
                    for t, (tree, small, _) in some.items():
                        w = s.weights(number, fold, t)
                        rows, place = _rows_of(tree, bins, small, w)
                        sent = [
                            {"tree": t, "node": node, "held": held, "at": row["first"], "n": len(i), "bins": bins[:, i].tobytes(), "y": y[i].tobytes(), "w": w[i].astype(np.uint8).tobytes(), "place": i.astype(np.int32).tobytes()}
                            for held, (own, ends) in enumerate(((rows, np.array(small, np.int64)[place]), (left_out, tree.walk(bins[:, left_out]))))
                            for node, i in _by_node(own, ends)
                        ]
                        if sent:
                            yield pa.RecordBatch.from_pylist(sent, sent_schema)

        def finish(batches: Iterator[pa.RecordBatch], some: dict = some) -> Iterator[pa.RecordBatch]:
            pieces = (r for b in batches for r in b.to_pylist())
            for (t, node), group in itertools.groupby(pieces, lambda r: (r["tree"], r["node"])):
                drawn, waiting, below = [], [], None

                def predicted(t: int = t, node: int = node, waiting: list = waiting) -> pa.RecordBatch:
                    # where no drawn row ends, a node stays a leaf
                    yhat = [np.full(r["n"], some[t][0].value[node]) for r in waiting]
                    if below is not None:
                        whole = below.predict(np.concatenate([_bins(r, features) for r in waiting], 1))
                        yhat = np.split(whole, np.cumsum([r["n"] for r in waiting])[:-1])
                    return pa.RecordBatch.from_pylist([{"at": r["at"], "tree": t, "node": node, "place": r["place"], "y": r["y"], "total": x.tobytes()} for r, x in zip(waiting, yhat, strict=True)], held_schema)

                for r in group:
                    if not r["held"]:
                        drawn.append(r)
                        continue
                    if drawn:
                        x = np.concatenate([_bins(d, features) for d in drawn], axis=1)
                        y, w = (np.concatenate([np.frombuffer(d[c], kind) for d in drawn]) for c, kind in (("y", float), ("w", np.uint8)))
                        left = None if s.depth is None else s.depth - some[t][2][node]
                        drawn, below = [], subtree(x, y, w.astype(np.int64), s, left, np.random.default_rng([s.seed, t, 0, node]))
                    waiting.append(r)
                    if sum(r["n"] for r in waiting) >= boosting.ROWS:
                        yield predicted()
                        waiting.clear()
                if waiting:
                    yield predicted()

        given = blocks.mapInArrow(deal, "tree int, node int, held int, at long, n long, bins binary, y binary, w binary, place binary")
        done = given.repartition("tree", "node").sortWithinPartitions("tree", "node", "held", "at").mapInArrow(finish, _HELD)
        done = kept(_by_block(done, lambda at, place, y, total: _piece(at, a, place, y, total), _HELD), "held")
        sums = done if sums is None else sums.unionByName(done)
    return _by_block(sums, lambda at, place, y, total: errors.batch([errors.sums(name, s.held, y, total / len(out), centres)]), errors.SUMS)


def _piece(at: int, tree: int, place: np.ndarray, y: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array([at], pa.int64()), *(pa.array([x], pa.int32()) for x in (tree, 0)), *(pa.array([x.tobytes()], pa.binary()) for x in (place, y, total))]
    return pa.RecordBatch.from_arrays(arrays, ["at", "tree", "node", "place", "y", "total"])


def _by_block(parts: DataFrame, make: Callable[[int, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` says of each block's held-out rows, from their places, targets and the predictions of all trees, added in order."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for at, group in itertools.groupby(rows, lambda r: r["at"]):
            total, y, seen = (np.zeros(0, kind) for kind in (float, float, bool))
            for r in group:
                place = np.frombuffer(r["place"], np.int32)
                more = int(place.max()) + 1 - len(total)
                if more > 0:
                    total, y, seen = (np.append(x, np.zeros(more, x.dtype)) for x in (total, y, seen))
                total[place] += np.frombuffer(r["total"])
                y[place], seen[place] = np.frombuffer(r["y"]), True
            place = np.flatnonzero(seen)
            yield make(at, place.astype(np.int32), y[place], total[place])

    return parts.repartition("at").sortWithinPartitions("at", "tree", "node").mapInArrow(add, schema)


# --- the model ---------------------------------------------------------------


def _nodes(spark: SparkSession, data: Binned, out: Sequence[_Top], parts: DataFrame) -> DataFrame:
    """tree and MLlib's record of each node. A subtree's first node takes the number of the node it stands for."""
    upper = []
    for t, top in enumerate(out):
        x, limit = top.tree, _thresholds(top.tree, data.edges)
        upper += [(t, i, x.feature[i], limit[i], x.left[i], x.right[i], x.value[i], x.gain[i], x.count[i]) for i in range(len(x.value))]
    columns = "tree int, id int, feature int, threshold double, left int, right int, value double, gain double, count bigint"
    ahead = Window.partitionBy("tree").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spark.createDataFrame([(t, len(top.tree.value)) for t, top in enumerate(out)], "tree int, size int")
    base = parts.select("tree", "node", (F.size("value") - 1).alias("more")).withColumn("base", F.coalesce(F.sum("more").over(ahead), F.lit(0)))
    base = base.join(F.broadcast(sizes), "tree").select("tree", "node", (F.col("base") + F.col("size") - 1).cast("int").alias("base"))
    every = parts.join(base, ["tree", "node"]).select("tree", "node", "base", F.posexplode(F.arrays_zip("feature", "threshold", "left", "right", "value", "gain", "count")).alias("at", "x"))
    number = lambda c: F.when(F.col(c) < 0, F.lit(-1)).otherwise(F.col("base") + F.col(c))
    lower = every.select("tree", F.when(F.col("at") == 0, F.col("node")).otherwise(F.col("base") + F.col("at")).alias("id"), "x.feature", "x.threshold", number("x.left").alias("left"), number("x.right").alias("right"), "x.value", "x.gain", "x.count")
    # nodes without any drawn row have no subtree and stay leaves
    own = spark.createDataFrame(upper, columns).join(parts.select("tree", F.col("node").alias("id")), ["tree", "id"], "left_anti")
    n, v, inner = F.col("count").cast("double"), F.col("value"), F.col("feature") >= 0
    record = F.struct(
        F.col("id"), v.alias("prediction"), F.lit(0.0).alias("impurity"), F.array(n, n * v, n * v * v).alias("impurityStats"), F.col("count").alias("rawCount"),
        # MLlib weighs a gain by the rows of its node
        F.when(inner, F.col("gain") / n).otherwise(F.lit(-1.0)).alias("gain"), F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(F.col("feature").alias("featureIndex"), F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")).alias("split"),
    )
    return own.select(*[c.split()[0] for c in columns.split(", ")]).unionByName(lower).select(F.col("tree").alias("treeID"), record.cast(_NODE).alias("nodeData"))


def fit(data: Binned, s: Settings, spark: SparkSession, features: str = "features", label: str = "label") -> RandomForestRegressionModel:
    """The forest as an MLlib model. Without rows: trees of one leaf, 0. A missing value goes right at every split."""
    many = len(data.edges)
    if data.folds:
        out = tops(data, s)
    else:
        out = [_Top() for _ in range(s.trees)]
        for top in out:
            top.add(0.0, 1, 0, s)
    path, stamp = scratch_path(spark, "forest"), int(time.time() * 1000)
    _nodes(spark, data, out, subtrees(data, out, s)).write.parquet(f"{path}/data")
    defaults = RandomForestRegressor()
    known = {p.name: defaults.getOrDefault(p) for p in defaults.params if defaults.hasDefault(p)}

    def metadata(kind: str, uid: str, params: dict, own: dict, **more: int) -> str:
        about = {"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": stamp, "sparkVersion": spark.version, "uid": uid}
        return json.dumps(about | {"paramMap": {"labelCol": label, "featuresCol": features} | own, "defaultParamMap": params} | more)

    single = {k: v for k, v in known.items() if k not in ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")}
    trees = [(t, metadata("DecisionTreeRegressionModel", f"dtr_{uuid.uuid4().hex[:12]}", single, {}, numFeatures=many), 1.0) for t in range(s.trees)]
    main = metadata("RandomForestRegressionModel", f"RandomForestRegressor_{uuid.uuid4().hex[:12]}", known, {"numTrees": s.trees}, numFeatures=many, numTrees=s.trees)
    spark.createDataFrame([(main,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    return RandomForestRegressionModel.load(path)


class DeepForest(Estimator):
    """A pipeline stage over an assembled vector; fits to an MLlib model whose trees are as deep as they need to be."""

    def __init__(self, target: str, settings: Settings, features: str = "features") -> None:
        super().__init__()
        self.target, self.settings, self.features = target, settings, features

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        first = dataset.select(self.features).first()
        names = [f"x{i}" for i in range(len(first[0]) if first is not None else 0)]
        values = vector_to_array(F.col(self.features))
        rows = dataset.select(*[values[i].alias(c) for i, c in enumerate(names)], F.col(self.target).alias("y"))
        return fit(binned(rows, names, "y"), self.settings, dataset.sparkSession, self.features, self.target)
