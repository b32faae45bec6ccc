"""Geometry parts in Arrow batches as flat numpy arrays with list offsets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Pairs of segments that are compared at a time.
_PAIRS = 1 << 20


@dataclass(frozen=True)
class Parts:
    """Rows of parts of points: part k of row i is ``xy[points[k]:points[k + 1]]``.

    The parts of row i are ``rows[i]:rows[i + 1]``; a null row has none and ``known`` tells.
    """

    rows: np.ndarray
    points: np.ndarray
    xy: np.ndarray
    known: np.ndarray

    def ring(self, k: int) -> np.ndarray:
        return self.xy[self.points[k] : self.points[k + 1]]


def view(column: pa.Array) -> Parts:
    """An ``array<array<struct<x, y>>>`` column without an object for any vertex."""
    known = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    rows = column.offsets.to_numpy().astype(np.int64)
    rings = column.values
    points = rings.offsets.to_numpy().astype(np.int64)
    spots = rings.values
    xy = np.stack([spots.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)
    return Parts(rows, points, xy, known)


def build(rows: np.ndarray, rings: list[np.ndarray], known: np.ndarray) -> pa.Array:
    """The column whose row i has the rings ``rows[i]:rows[i + 1]``; unknown rows are null."""
    xy = np.concatenate([np.zeros((0, 2)), *rings])
    points = np.concatenate([[0], np.cumsum([len(r) for r in rings], dtype=np.int64)]).astype(np.int32)
    spots = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, i])) for i in (0, 1)], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(points), spots)
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), inner, mask=pa.array(~known))


def segments(rings: list[np.ndarray]) -> np.ndarray:
    """x0, y0, x1, y1 of all sides of closed rings, without sides of no length."""
    pairs = [np.concatenate([r, np.roll(r, -1, axis=0)], axis=1) for r in rings if len(r)]
    out = np.concatenate([np.zeros((0, 4)), *pairs])
    return out[(out[:, 0] != out[:, 2]) | (out[:, 1] != out[:, 3])]


def crosses(rings: list[np.ndarray]) -> bool:
    """Whether any two sides properly cross; touching ends do not count.

    Sides are sorted by their left end, so each one meets only those that begin before
    it ends; blocks of such pairs are tested at once.
    """
    s = segments(rings)
    if len(s) < 4:
        return False
    low, high = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    order = np.argsort(low, kind="stable")
    s, low, high = s[order], low[order], high[order]
    bottom, top = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    after = np.arange(1, len(s) + 1)
    count = np.searchsorted(low, high, "right") - after
    ends = np.cumsum(count)

    def side(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sign((a[:, 2] - a[:, 0]) * (y - a[:, 1]) - (a[:, 3] - a[:, 1]) * (x - a[:, 0]))

    first = 0
    while first < len(s):
        done = ends[first] - count[first]
        last = max(first + 1, int(np.searchsorted(ends, done + _PAIRS, "right")))
        n = count[first:last]
        a = np.repeat(np.arange(first, last), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(after[first:last], n)
        near = (bottom[a] <= top[b]) & (bottom[b] <= top[a])
        p, q = s[a[near]], s[b[near]]
        cut = (side(p, q[:, 0], q[:, 1]) * side(p, q[:, 2], q[:, 3]) < 0) & (side(q, p[:, 0], p[:, 1]) * side(q, p[:, 2], p[:, 3]) < 0)
        if cut.any():
            return True
        first = last
    return False


def _meets(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a range and a value in it, both ends included, in blocks."""
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], low, "left")
    count = np.searchsorted(at[order], high, "right") - first
    ends = np.cumsum(count)
    i = 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - count[i] + _PAIRS, "right")))
        n = count[i:j]
        a = np.repeat(np.arange(i, j), n)
        yield a, order[np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[i:j], n)]
        i = j


def _forward(s: np.ndarray) -> np.ndarray:
    """Segments from left to right, upright ones from below."""
    back = (s[:, 0] > s[:, 2]) | ((s[:, 0] == s[:, 2]) & (s[:, 1] > s[:, 3]))
    return np.where(back[:, None], s[:, [2, 3, 0, 1]], s)


def _on(s: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Whether each point lies on its segment, given from left to right."""
    x, y = xy[:, 0], xy[:, 1]
    box = (x >= s[:, 0]) & (x <= s[:, 2]) & (y >= np.minimum(s[:, 1], s[:, 3])) & (y <= np.maximum(s[:, 1], s[:, 3]))
    return box & ((y - s[:, 1]) * (s[:, 2] - s[:, 0]) == (s[:, 3] - s[:, 1]) * (x - s[:, 0]))


def _all_covered(sides: np.ndarray, xy: np.ndarray) -> bool:
    """Whether every point lies inside the rings of these sides, all of one turn, or on a side."""
    s, way = _forward(sides), np.sign(sides[:, 0] - sides[:, 2])
    winding, touched = np.zeros(len(xy)), np.zeros(len(xy), bool)
    for a, b in _meets(s[:, 0], s[:, 2], xy[:, 0]):
        e, p = s[a], xy[b]
        touched[b[_on(e, p)]] = True
        above = (p[:, 0] < e[:, 2]) & ((p[:, 1] - e[:, 1]) * (e[:, 2] - e[:, 0]) < (e[:, 3] - e[:, 1]) * (p[:, 0] - e[:, 0]))
        winding += np.bincount(b[above], weights=way[a[above]], minlength=len(xy))
    return bool(((winding != 0) | touched).all())


def leaves(shells: list[np.ndarray], holes: list[np.ndarray]) -> bool:
    """Whether any hole has a stretch outside all shells, which turn the same way.

    Sides of holes are cut where a vertex of a shell lies on them. If no sides cross, a
    piece that doesn't run along a shell's side is wholly inside or wholly outside, so its
    middle tells.
    """
    outer = segments(shells)
    if not _all_covered(outer, np.concatenate([np.zeros((0, 2)), *holes])):
        return True
    edges, sides = _forward(outer), _forward(segments(holes))
    owner, spots = [np.arange(len(sides))] * 2, [sides[:, :2], sides[:, 2:]]
    for a, b in _meets(sides[:, 0], sides[:, 2], outer[:, 0]):
        on = _on(sides[a], outer[b, :2])
        owner.append(a[on])
        spots.append(outer[b[on], :2])
    owner, spots = np.concatenate(owner), np.concatenate(spots)
    order = np.lexsort((spots[:, 1] * np.sign(sides[owner, 3] - sides[owner, 1]), spots[:, 0], owner))
    owner, spots = owner[order], spots[order]
    piece = (owner[1:] == owner[:-1]) & (spots[1:] != spots[:-1]).any(axis=1)
    start, end = spots[:-1][piece], spots[1:][piece]
    along = np.zeros(len(start), bool)
    for a, b in _meets(edges[:, 0], edges[:, 2], start[:, 0]):
        along[b[_on(edges[a], start[b]) & _on(edges[a], end[b])]] = True
    return not _all_covered(outer, (start[~along] + end[~along]) / 2)


def twice_area(ring: np.ndarray) -> float:
    """Twice the signed area, positive when counter-clockwise."""
    if not len(ring):
        return 0.0
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())
