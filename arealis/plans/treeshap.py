"""Exact SHAP values of tree ensembles of any size (path-dependent, Lundberg et al. 2018).

A leaf credits feature i with value * (o_i - z_i) times the Shapley-weighted sum over subsets of
its other features, where o says whether the row fits the feature's interval on the path and z is
the share of training rows that stay when the feature is unknown. The weights are a beta
integral, so that sum is the integral over t in [0, 1] of the product of z_j (1 - t) + o_j t over the
others: a polynomial, for which Gauss-Legendre nodes are exact.

The products are not formed leaf by leaf. One walk down a tree carries the product of all factors
so far, one walk up adds the leaves below each edge, and each edge credits its feature with that sum
times what it changes about the feature's own factor (as Linear TreeSHAP does, Yu et al. 2022).
So a row costs edges x nodes of integration, however long the paths are.

Trees are turned into arrays by tasks, one tree a group, and cut at ranges of leaves; a piece carries
the edges above its leaves, and as all sums are over leaves, pieces add up. The rows are passed over once
for each block of pieces; only one block at a time goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.session import kept

#: Leaves of a piece of a tree.
LEAVES = 1 << 15
#: Bytes of pieces that are sent to the tasks at once.
BLOCK = 64 << 20
# Working memory of one step in a task, in rows x edges x nodes of integration.
_CELLS = 1 << 20

_ARRAYS = {"parent": np.int32, "prev": np.int32, "feature": np.int32, "low": float, "high": float, "share": float, "value": float, "levels": np.int32}
_PIECE = "tree int, piece int, base double, distinct int, edges long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


@dataclass(frozen=True)
class Piece:
    """Edges of a tree level by level; an edge stands for the node it leads to.

    ``prev`` is the edge above that split the same feature. A row fits an edge if it lies in
    its feature's interval (``low``, ``high``], NaN being no bound; ``share`` belongs to that interval.
    """

    parent: np.ndarray
    prev: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    levels: np.ndarray
    distinct: int


@dataclass(frozen=True)
class _Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def levels(self) -> list[np.ndarray]:
        out = [np.zeros(1, np.int64)]
        while True:
            inner = out[-1][self.left[out[-1]] >= 0]
            if not len(inner):
                return out
            out.append(np.stack([self.left[inner], self.right[inner]], 1).ravel())


def _tree(nodes: pd.DataFrame, weight: float) -> _Tree:
    nodes = nodes.sort_values("id")
    ids = nodes["id"].to_numpy()
    place = lambda c: np.where(nodes[c] < 0, -1, np.searchsorted(ids, nodes[c]))
    return _Tree(
        place("leftChild"),
        place("rightChild"),
        nodes["feature"].to_numpy(np.int32),
        nodes["threshold"].to_numpy(float),
        nodes["cover"].to_numpy(float),
        nodes["prediction"].to_numpy(float) * weight,
    )


def _piece(tree: _Tree, keep: np.ndarray, features: int) -> Piece:
    """The edges that lead to nodes in ``keep``."""
    edges = int(keep.sum()) - 1
    parent, prev, feature = (np.full(edges, -1, np.int32) for _ in range(3))
    low, high = np.full(edges, np.nan), np.full(edges, np.nan)
    share, value = np.ones(edges), np.zeros(edges)
    levels, distinct, done = [], 0, 0
    # nodes of the level above, their edges, and the last edge of each feature on the way to them
    at, edge, last = np.zeros(1, np.int64), np.full(1, -1, np.int32), np.full((1, features), -1, np.int32)
    while True:
        inner = np.flatnonzero(tree.left[at] >= 0)
        child = np.stack([tree.left[at[inner]], tree.right[at[inner]]], 1).ravel()
        above, right = np.repeat(inner, 2), np.tile([False, True], len(inner))
        here = keep[child]
        child, above, right = child[here], above[here], right[here]
        if not len(child):
            break
        e = np.arange(done, done + len(child), dtype=np.int32)
        f, cut = tree.feature[at[above]], tree.threshold[at[above]]
        p = last[above, f]
        some = p >= 0
        parent[e], prev[e], feature[e] = edge[above], p, f
        for bound, side, tighter in ((low, right, np.fmax), (high, ~right, np.fmin)):
            bound[e] = np.where(some, bound[p], np.nan)
            bound[e[side]] = tighter(bound[e[side]], cut[side])
        whole = tree.cover[at[above]]
        share[e] = np.where(some, share[p], 1.0) * np.divide(tree.cover[child], whole, out=np.zeros(len(child)), where=whole > 0)
        value[e] = np.where(tree.left[child] < 0, tree.value[child], 0.0)
        last = last[above]
        last[np.arange(len(e)), f] = e
        distinct = max(distinct, int((last >= 0).sum(1).max()))
        levels.append(len(e))
        done += len(e)
        at, edge = child, e
    return Piece(parent, prev, feature, low, high, share, value, np.array(levels, np.int32), distinct)


def pieces_of(nodes: pd.DataFrame, weight: float, features: int, leaves: int = LEAVES) -> Iterator[tuple[float, Piece]]:
    """The pieces of one tree, each with its part of the expected prediction."""
    tree = _tree(nodes, weight)
    levels, many = tree.levels(), np.ones(len(tree.left), np.int64)
    for at in reversed(levels):
        inner = at[tree.left[at] >= 0]
        many[inner] = many[tree.left[inner]] + many[tree.right[inner]]
    start = np.zeros(len(many), np.int64)
    for at in levels:
        inner = at[tree.left[at] >= 0]
        start[tree.left[inner]] = start[inner]
        start[tree.right[inner]] = start[inner] + many[tree.left[inner]]
    leaf = tree.left < 0
    mean = tree.value * tree.cover / tree.cover[0] if tree.cover[0] > 0 else tree.value
    for first in range(0, int(many[0]), leaves):
        keep = (start < first + leaves) & (start + many > first)
        yield float(mean[keep & leaf].sum()), _piece(tree, keep, features)


def pieces(nodes: DataFrame, weights: Sequence[float], features: int, leaves: int = LEAVES) -> DataFrame:
    """Pieces of all trees of a node table, one row each. A group is a tree."""
    weights = list(weights)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["treeID"].iloc[0])
        return pd.DataFrame(
            [
                {"tree": t, "piece": i, "base": base, "distinct": p.distinct, "edges": len(p.parent)} | {c: getattr(p, c).tobytes() for c in _ARRAYS}
                for i, (base, p) in enumerate(pieces_of(pdf, weights[t], features, leaves))
            ]
        )

    return nodes.select("treeID", "id", "leftChild", "rightChild", "feature", "threshold", "cover", "prediction").groupBy("treeID").applyInPandas(pack, _PIECE)


def _tables(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """By edge and by whether a row fits it and the one before: the change of the product, and the credit.

    0: neither, 1: only the one before, 2: both. Fitting an edge means fitting the one before.
    """
    at, weight = np.polynomial.legendre.leggauss(max(1, (p.distinct + 1) // 2))
    at, weight = (at + 1) / 2, weight / 2
    z = p.share[:, None]
    off, on = z * (1 - at), z * (1 - at) + at
    gain_off, gain_on = np.broadcast_to(-1 / (1 - at), off.shape), (1 - z) / on
    first = (p.prev < 0)[:, None]
    off0, on0, gain0 = (np.where(first, none, x[p.prev]) for x, none in ((off, 1.0), (on, 1.0), (gain_on, 0.0)))
    change = np.stack([np.divide(off, off0, out=np.zeros_like(off), where=off0 > 0), off / on0, on / on0], 1)
    credit = np.stack([np.zeros_like(off), gain_off - gain0, gain_on - gain0], 1) * weight
    return change.reshape(-1, len(at)), credit.reshape(-1, len(at))


def shap_of_piece(x: np.ndarray, p: Piece, out: np.ndarray) -> None:
    """Adds the values of all rows (rows x features) to ``out``."""
    edges = len(p.parent)
    if not edges:
        return
    change, credit = _tables(p)
    nodes = change.shape[1]
    ends = np.cumsum(p.levels)
    spans = [slice(b - n, b) for b, n in zip(ends, p.levels, strict=True)]
    firsts = [np.flatnonzero(np.diff(p.parent[s], prepend=-2)) for s in spans]
    leaf = np.ones(edges, bool)
    leaf[p.parent[p.parent >= 0]] = False
    by_feature = np.argsort(p.feature, kind="stable")
    found, starts = np.unique(p.feature[by_feature], return_index=True)
    low, high, open_above = p.low[:, None], p.high[:, None], np.isnan(p.high)[:, None]
    step = max(1, _CELLS // (edges * nodes))
    for a in range(0, len(x), step):
        own = x[a : a + step].T[p.feature]
        # a missing value fails x <= cut, so it goes right
        fits = ~(own <= low) & ((own <= high) | open_above)
        before = fits[p.prev] | (p.prev < 0)[:, None]
        state = np.arange(0, 3 * edges, 3)[:, None] + fits + before
        total = change.take(state, 0)
        for s in spans[1:]:
            total[s] *= total[p.parent[s]]
        total[leaf] *= p.value[leaf][:, None, None]
        for s, first in zip(spans[:0:-1], firsts[:0:-1], strict=True):
            below = total[s]
            above = p.parent[s][first]
            total[above] = below[::2] + below[1::2] if 2 * len(first) == len(below) and (np.diff(first) == 2).all() else np.add.reduceat(below, first, 0)
        share = np.einsum("erk,erk->er", total, credit.take(state, 0))
        out[a : a + step, found] += np.add.reduceat(share[by_feature], starts, 0).T


def _read(row: dict) -> Piece:
    return Piece(**{c: np.frombuffer(row[c], kind) for c, kind in _ARRAYS.items()}, distinct=row["distinct"])


def _blocks(table: DataFrame, size: int) -> list[list[tuple[int, int]]]:
    """Pieces by blocks of about ``size`` bytes, in order."""
    per_edge = sum(np.dtype(kind).itemsize for c, kind in _ARRAYS.items() if c != "levels")
    out, held = [[]], 0
    for r in table.select("tree", "piece", "edges").orderBy("tree", "piece").collect():
        if out[-1] and held + r["edges"] * per_edge > size:
            out.append([])
            held = 0
        out[-1].append((r["tree"], r["piece"]))
        held += r["edges"] * per_edge
    return out


def explained(rows: DataFrame, table: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of ``key``, ``x`` (array of values) with ``shap``, the array of their contributions.

    One pass over the rows for each block; between blocks the sums so far are a written table.
    """
    spark = rows.sparkSession
    width = F.size("x")
    rows = rows.withColumn("shap", F.array_repeat(F.lit(0.0), width))
    schema = rows.schema
    blocks = _blocks(table, block)
    for i, held in enumerate(blocks):
        (tree, first), (last_tree, last) = held[0], held[-1]
        here = F.struct("tree", "piece")
        bound = lambda t, k: F.struct(F.lit(t).alias("tree"), F.lit(k).alias("piece"))
        some = table.where((here >= bound(tree, first)) & (here <= bound(last_tree, last))).orderBy("tree", "piece")
        shared = spark.sparkContext.broadcast([r.asDict() for r in some.select("distinct", *_ARRAYS).collect()])

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                out = batch["shap"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1).copy()
                for row in shared.value:
                    shap_of_piece(x, _read(row), out)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1])
                sums = pa.ListArray.from_arrays(ends, pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([sums if c == "shap" else batch[c] for c in batch.schema.names], batch.schema.names)

        rows = rows.mapInArrow(add, schema)
        if i + 1 < len(blocks):
            rows = kept(rows, "shap")
            shared.unpersist()
    return rows
