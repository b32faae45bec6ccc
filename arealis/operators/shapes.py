"""Convex mask, simplification and other shape work done in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.functions import arrays
from arealis.functions import geometry as g


def _outer(xy: np.ndarray) -> np.ndarray:
    """The points that are not inside the polygon of the extremes in 32 directions."""
    turn = np.linspace(0, 2 * np.pi, 32, endpoint=False)
    far = xy[np.argmax(xy @ np.stack([np.cos(turn), np.sin(turn)]), axis=0)]
    far = far[np.append(True, (far[1:] != far[:-1]).any(axis=1))]
    inside = np.full(len(xy), len(far) > 2)
    for (ax, ay), (bx, by) in zip(far, np.roll(far, -1, axis=0), strict=True):
        if (ax, ay) != (bx, by):
            inside &= (bx - ax) * (xy[:, 1] - ay) - (by - ay) * (xy[:, 0] - ax) > 0
    return xy[~inside]


def hull_points(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (Andrew's monotone chain, 1979).

    The chain is walked for the few points only that no polygon of extremes holds.
    """
    xy = np.unique(_outer(xy) if len(xy) > 64 else xy, axis=0)
    if len(xy) < 3:
        return xy

    def chain(points: np.ndarray) -> list[np.ndarray]:
        kept: list[np.ndarray] = []
        for p in points:
            while len(kept) > 1:
                (ax, ay), (bx, by) = kept[-2], kept[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                kept.pop()
            kept.append(p)
        return kept

    lower, upper = chain(xy), chain(xy[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _partial_hulls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hull of everything a task sees, folded batch by batch."""
    kept = np.empty((0, 2))
    for pdf in batches:
        kept = hull_points(np.vstack([kept, pdf[["x", "y"]].to_numpy()]))
    yield pd.DataFrame(kept, columns=["x", "y"])


def convex_hull(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row ``geom``: the convex hull of the shapes' centroids.

    The hull of hulls is the hull: every task reduces its rows to a few corners,
    these are gathered in a fan-in of tasks, then in one.
    """
    centre = g.centroid(geom)
    points = (
        df.where(F.col(geom).isNotNull())
        .select(centre.alias("c"))
        .where(F.col("c").isNotNull())
        .select("c.x", "c.y")
    )
    corners = points.mapInPandas(_partial_hulls, "x double, y double")
    corners = corners.repartition("x", "y").mapInPandas(_partial_hulls, "x double, y double")
    last = corners.coalesce(1).mapInPandas(_ring_rows, f"ring array<{g.POINT_TYPE}>")
    return last.select(g.make_polygon("array(ring)").alias(geom))


def _ring_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept = np.empty((0, 2))
    for pdf in batches:
        kept = hull_points(np.vstack([kept, pdf[["x", "y"]].to_numpy()]))
    if len(kept):
        ring = [{"x": float(x), "y": float(y)} for x, y in [*kept, kept[0]]]
        yield pd.DataFrame({"ring": [ring]})


def intersects_hull(areas: DataFrame, hull: DataFrame, key: str, out: str = "covered") -> DataFrame:
    """Whether each area meets the mask, as ``key, covered``."""
    mask = hull.select(F.struct("geom.*").alias("geom")).scalar()
    held = areas.select(key, "geom").withColumn("_mask", mask)
    return held.select(
        key, F.coalesce(g.intersects("geom", "_mask"), F.lit(False)).alias(out)
    )


def thin_line(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a line to keep (Douglas and Peucker 1973)."""
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(xy) - 1)]
    while open_spans:
        first, last = open_spans.pop()
        if last - first < 2:
            continue
        a, d = xy[first], xy[last] - xy[first]
        rel = xy[first + 1 : last] - a
        size = np.hypot(*d)
        if size == 0:
            away = np.hypot(rel[:, 0], rel[:, 1])
        else:
            away = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / size
        far = int(np.argmax(away))
        if away[far] > tolerance:
            middle = first + 1 + far
            keep[middle] = True
            open_spans += [(first, middle), (middle, last)]
    return keep


def _thin_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring is cut at its start and at the vertex farthest from it."""
    if len(ring) <= 5 or not np.array_equal(ring[0], ring[-1]):
        return ring
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    if far in (0, len(ring) - 1):
        return ring
    head, tail = ring[: far + 1], ring[far:]
    kept = np.vstack([head[thin_line(head, tolerance)], tail[thin_line(tail, tolerance)][1:]])
    return kept if len(kept) >= 4 else ring


def simplify(df: DataFrame, tolerance: float, geom: str = "geom") -> DataFrame:
    """Fewer vertices within a tolerance, in the layer's units.

    A ring keeps at least four points. A ring that would cross itself is left
    as it was.
    """

    @F.arrow_udf(f"array<array<{g.POINT_TYPE}>>")
    def thin(parts: pa.Array, kinds: pa.Array) -> pa.Array:
        held, kind, done = arrays.view(parts), kinds.to_pylist(), []
        for i in range(len(kind)):
            for k in range(held.rows[i], held.rows[i + 1]):
                xy = held.ring(k)
                if kind[i] in g.POLYGON_KINDS:
                    new = _thin_ring(xy, tolerance)
                    xy = xy if new is xy or arrays.crosses([new]) else new
                elif kind[i] in g.LINE_KINDS and len(xy) > 2:
                    xy = xy[thin_line(xy, tolerance)]
                done.append(xy)
        return arrays.build(held.rows - held.rows[0], done, held.known)

    thinned = df.withColumn("_thin", thin(F.col(f"{geom}.parts"), F.col(f"{geom}.kind")))
    return thinned.withColumn(geom, g.geometry(f"{geom}.kind", "_thin")).drop("_thin")
