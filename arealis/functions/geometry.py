"""Geometry as plain columns.

A geometry is ``struct<kind, parts, xmin, ymin, xmax, ymax>``. ``parts`` is an
array of point lists: one list per ring, line or point set. Outer rings run
counter-clockwise and holes clockwise, so signed sums over all rings need no
nesting.

Functions take the SQL text of their operands, mostly a column name, and return a
Column. The bodies are SQL too: one expression to parse instead of hundreds of calls
into the JVM, and everything stays there at run time. Helpers whose name starts with
an underscore return text, to be put together.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arealis.functions import arrays

POINT_TYPE = "struct<x:double,y:double>"
GEOM_TYPE = (
    f"struct<kind:string,parts:array<array<{POINT_TYPE}>>,"
    "xmin:double,ymin:double,xmax:double,ymax:double>"
)
POLYGON_KINDS = ("Polygon", "MultiPolygon")
LINE_KINDS = ("LineString", "MultiLineString")
POINT_KINDS = ("Point", "MultiPoint")

# Overlaps below this many square metres are rounding noise, not pieces.
MIN_PIECE_AREA = 1e-6
# The same for lines, in metres.
MIN_PIECE_LENGTH = 1e-9
# Polygons up to this many vertices are tested for crossings inside their row.
_FEW_SIDES = 48

# A point on an edge adds this to its winding number, which marks it as not
# strictly inside whatever the other edges say.
_ON_EDGE = 1 << 20

BBox = tuple[float, float, float, float]


# --- text helpers ------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it several times as ``name`` inside ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _total(values: str) -> str:
    return f"aggregate({values}, 0D, (acc, item) -> acc + item)"


def _point(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def _rotate(ring: str) -> str:
    """The ring started one vertex later, which pairs each vertex with the next."""
    return f"concat(slice({ring}, 2, greatest(size({ring}) - 1, 0)), slice({ring}, 1, 1))"


def _steps(points: str, body: str) -> str:
    """``body`` over consecutive points p and q, without closing the list."""
    n = f"greatest(size({points}) - 1, 0)"
    return f"zip_with(slice({points}, 1, {n}), slice({points}, 2, {n}), (p, q) -> {body})"


def _number(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def _is(geom: str, kinds: tuple[str, ...]) -> str:
    return f"{geom}.kind IN ({', '.join(repr(k) for k in kinds)})"


def _geometry(kind: str, parts: str) -> str:
    """Assemble a geometry and its bounding box; null parts give null."""
    box = ", ".join(
        f"'{axis}{end}', array_{end}(transform(flatten(ps), q -> q.{axis}))"
        for end in ("min", "max")
        for axis in ("x", "y")
    )
    made = f"named_struct('kind', {kind}, 'parts', ps, {box})"
    return _let("ps", parts, f"CASE WHEN ps IS NOT NULL THEN {made} END")


def _ring_twice_area(r: str) -> str:
    """Twice the signed area, positive when counter-clockwise.

    Vertices are taken relative to the first one, which keeps the digits at
    projected coordinates in the millions.
    """
    x0, y0 = f"{r}[0].x", f"{r}[0].y"
    cross = f"(p.x - {x0}) * (q.y - {y0}) - (q.x - {x0}) * (p.y - {y0})"
    return _total(f"zip_with({r}, {_rotate(r)}, (p, q) -> {cross})")


def _orient(rings: str) -> str:
    """First ring counter-clockwise, all others clockwise."""
    turned = f"if(({_ring_twice_area('r')} >= 0) = (i = 0), r, reverse(r))"
    return f"transform({rings}, (r, i) -> {turned})"


# --- building ----------------------------------------------------------------


def geometry(kind: str, parts: str) -> Column:
    """Geometry from the SQL text of its kind and its parts."""
    return F.expr(_geometry(kind, parts))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def make_point(x: Column, y: Column) -> Column:
    """Point geometry, null when either coordinate is."""
    x, y = x.cast("double"), y.cast("double")
    made = F.struct(
        F.lit("Point").alias("kind"),
        F.array(F.array(point(x, y))).alias("parts"),
        x.alias("xmin"),
        y.alias("ymin"),
        x.alias("xmax"),
        y.alias("ymax"),
    )
    return F.when(x.isNotNull() & y.isNotNull(), made)


def make_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Axis-aligned rectangle as an ordinary polygon."""
    x0, y0, x1, y1 = (c.cast("double") for c in (x0, y0, x1, y1))
    start = point(x0, y0)
    ring = F.array(start, point(x1, y0), point(x1, y1), point(x0, y1), start)
    return F.struct(
        F.lit("Polygon").alias("kind"),
        F.array(ring).alias("parts"),
        x0.alias("xmin"),
        y0.alias("ymin"),
        x1.alias("xmax"),
        y1.alias("ymax"),
    )


def bbox_polygon(bbox: BBox) -> Column:
    """A fixed study rectangle ``(xmin, ymin, xmax, ymax)``."""
    return make_box(*(F.lit(float(v)) for v in bbox))


def make_line(*points: tuple[Column, Column]) -> Column:
    """Line through a few given points."""
    xs = [x.cast("double") for x, _ in points]
    ys = [y.cast("double") for _, y in points]
    listed = F.array(*(point(x, y) for x, y in zip(xs, ys, strict=True)))
    return F.struct(
        F.lit("LineString").alias("kind"),
        F.array(listed).alias("parts"),
        F.least(*xs).alias("xmin"),
        F.least(*ys).alias("ymin"),
        F.greatest(*xs).alias("xmax"),
        F.greatest(*ys).alias("ymax"),
    )


def make_polygon(rings: str) -> Column:
    """Polygon from its rings; the first is the outer one, the rest are holes."""
    return geometry("'Polygon'", _orient(rings))


def centre_point(geom: str) -> Column:
    """The centroid as a point geometry."""
    return F.expr(
        _let(
            "c",
            _centroid(geom),
            "CASE WHEN c IS NOT NULL THEN named_struct('kind', 'Point', 'parts', array(array(c)),"
            " 'xmin', c.x, 'ymin', c.y, 'xmax', c.x, 'ymax', c.y) END",
        )
    )


def is_kind(geom: str, kinds: tuple[str, ...]) -> Column:
    return F.expr(_is(geom, tuple(kinds)))


# --- measures ----------------------------------------------------------------


def area(geom: str) -> Column:
    """Polygon area; 0 for points and lines."""
    polygon = _total(f"transform({geom}.parts, r -> {_ring_twice_area('r')})")
    return F.expr(
        f"CASE WHEN {_is(geom, POLYGON_KINDS)} THEN {polygon} / 2"
        f" WHEN {geom} IS NOT NULL THEN 0D END"
    )


def length(geom: str) -> Column:
    """Length of a line, perimeter of a polygon, 0 for points."""
    one = _total(_steps("pts", "hypot(q.x - p.x, q.y - p.y)"))
    return F.expr(_total(f"transform({geom}.parts, pts -> {one})"))


def _centroid(geom: str) -> str:
    ox, oy = f"{geom}.parts[0][0].x", f"{geom}.parts[0][0].y"

    def mean(items: str) -> str:
        """Mean of (w, x, y) items, shifted back by the first vertex."""
        summed = (
            f"aggregate({items}, named_struct('w', 0D, 'x', 0D, 'y', 0D),"
            " (a, i) -> named_struct('w', a.w + i.w, 'x', a.x + i.x, 'y', a.y + i.y))"
        )
        spot = _point(f"{ox} + m.x / m.w", f"{oy} + m.y / m.w")
        return _let("m", summed, f"CASE WHEN m.w <> 0 THEN {spot} END")

    cross = f"((p.x - {ox}) * (q.y - {oy}) - (q.x - {ox}) * (p.y - {oy}))"
    triangle = (
        f"named_struct('w', {cross} * 3, 'x', {cross} * (p.x + q.x - 2 * {ox}),"
        f" 'y', {cross} * (p.y + q.y - 2 * {oy}))"
    )
    span = "hypot(q.x - p.x, q.y - p.y)"
    piece = (
        f"named_struct('w', {span}, 'x', {span} * ((p.x + q.x) / 2 - {ox}),"
        f" 'y', {span} * ((p.y + q.y) / 2 - {oy}))"
    )
    spot = f"named_struct('w', 1D, 'x', p.x - {ox}, 'y', p.y - {oy})"
    triangles = f"flatten(transform({geom}.parts, r -> zip_with(r, {_rotate('r')}, (p, q) -> {triangle})))"
    pieces = f"flatten(transform({geom}.parts, r -> {_steps('r', piece)}))"
    spots = f"transform(flatten({geom}.parts), p -> {spot})"
    return (
        f"CASE WHEN {_is(geom, POLYGON_KINDS)} THEN {mean(triangles)}"
        f" WHEN {_is(geom, LINE_KINDS)} THEN {mean(pieces)} ELSE {mean(spots)} END"
    )


def centroid(geom: str) -> Column:
    """Area-weighted for polygons, length-weighted for lines, plain mean for points."""
    return F.expr(_centroid(geom))


def map_points(geom: str, body: str) -> Column:
    """Replace every vertex ``p`` by ``body`` and rebuild the box."""
    return geometry(f"{geom}.kind", f"transform({geom}.parts, pts -> transform(pts, p -> {body}))")


def translate(geom: str, dx: float, dy: float) -> Column:
    return map_points(geom, _point(f"p.x + {_number(dx)}", f"p.y + {_number(dy)}"))


# --- edges and the closed forms used by the spatial joins --------------------


def _edges(geom: str) -> str:
    forward = "(p.x < q.x OR (p.x = q.x AND p.y <= q.y))"
    edge = (
        "named_struct('xl', least(p.x, q.x), "
        f"'yl', if({forward}, p.y, q.y), "
        "'xr', greatest(p.x, q.x), "
        f"'yr', if({forward}, q.y, p.y), "
        "'s', CAST(signum(p.x - q.x) AS INT), "
        "'v', if(p.x = q.x, CAST(signum(q.y - p.y) AS INT), 0))"
    )
    paired = f"flatten(transform({geom}.parts, r -> zip_with(r, {_rotate('r')}, (p, q) -> {edge})))"
    # Closed rings repeat their first vertex, which pairs it with itself.
    return f"filter({paired}, e -> e.s <> 0 OR e.v <> 0)"


def edges(geom: str) -> Column:
    """Polygon edges turned left to right: ``struct<xl, yl, xr, yr, s, v>``.

    ``s`` is +1 if the ring runs right to left along the edge (interior below),
    -1 if left to right, 0 if vertical. ``v`` is +1 for a vertical edge that
    runs upwards (interior to its left), -1 downwards, 0 otherwise.
    """
    return F.expr(_edges(geom))


def _segments(geom: str) -> str:
    seg = "named_struct('x0', p.x, 'y0', p.y, 'x1', q.x, 'y1', q.y)"
    alone = "transform(r, p -> named_struct('x0', p.x, 'y0', p.y, 'x1', p.x, 'y1', p.y))"
    return (
        f"flatten(transform({geom}.parts, r -> CASE"
        f" WHEN {_is(geom, POINT_KINDS)} OR size(r) = 1 THEN {alone}"
        f" WHEN {_is(geom, POLYGON_KINDS)} THEN zip_with(r, {_rotate('r')}, (p, q) -> {seg})"
        f" ELSE {_steps('r', seg)} END))"
    )


def segments(geom: str) -> Column:
    """Segments of any geometry: ``struct<x0, y0, x1, y1>``; a point is a segment to itself."""
    return F.expr(_segments(geom))


def _winding(edge_list: str, x: str, y: str) -> str:
    # Both sides of "y < edge(x)", multiplied out so that no division rounds.
    lhs, rhs = f"({y} - e.yl) * (e.xr - e.xl)", f"(e.yr - e.yl) * ({x} - e.xl)"
    touching = (
        f"{x} >= e.xl AND {x} <= e.xr AND {y} >= least(e.yl, e.yr)"
        f" AND {y} <= greatest(e.yl, e.yr) AND {lhs} = {rhs}"
    )
    step = (
        f"CASE WHEN {touching} THEN {_ON_EDGE}"
        f" WHEN {x} >= e.xl AND {x} < e.xr AND {lhs} < {rhs} THEN e.s ELSE 0 END"
    )
    return f"aggregate({edge_list}, 0, (n, e) -> n + {step})"


def winding(edge_list: str, x: str, y: str) -> Column:
    """Winding number of (x, y), or a very large value when it lies on an edge."""
    return F.expr(_winding(edge_list, x, y))


def _strictly_inside(edge_list: str, x: str, y: str) -> str:
    return _let("w", _winding(edge_list, x, y), f"w <> 0 AND w < {_ON_EDGE // 2}")


def strictly_inside(edge_list: str, x: str, y: str) -> Column:
    """True inside, false outside and on the boundary."""
    return F.expr(_strictly_inside(edge_list, x, y))


def _height(e: str, x: str, y0: str) -> str:
    return f"(({e}.yl - {y0}) + ({e}.yr - {e}.yl) / ({e}.xr - {e}.xl) * ({x} - {e}.xl))"


def area_under_both(w: str, s: str, fa: str, fb: str, ga: str, gb: str) -> str:
    """Signed area under the lower of two lines over a width ``w``, as SQL text."""
    da, db = f"({fa} - {ga})", f"({fb} - {gb})"
    low_a, low_b = f"least({fa}, {ga})", f"least({fb}, {gb})"
    t = f"({da} / ({da} - {db}))"
    meet = f"({fa} + {t} * ({fb} - {fa}))"
    crossed = f"(({low_a} + {meet}) * {t} + ({meet} + {low_b}) * (1 - {t}))"
    return f"{s} * {w} * (CASE WHEN {da} * {db} < 0 THEN {crossed} ELSE {low_a} + {low_b} END) / 2"


def edge_pair(e: str, h: str, y0: str, lo: str, hi: str) -> dict[str, str]:
    """What a pair of edges contributes, as SQL text by name.

    A polygon is the signed sum of the regions under its edges, so an
    intersection is the signed sum, over edge pairs, of the region under both.
    Heights are measured from ``y0``, the lower bound of the pair of shapes, and x
    is held to [lo, hi].
    """
    return {
        "a": f"greatest({e}.xl, {h}.xl, {lo})",
        "b": f"least({e}.xr, {h}.xr, {hi})",
        "fa": _height(e, "{a}", y0),
        "fb": _height(e, "{b}", y0),
        "ga": _height(h, "{a}", y0),
        "gb": _height(h, "{b}", y0),
    }


def inside_length(e: str, g: str, lo: str, hi: str) -> list[dict[str, str]]:
    """The signed length of segment ``g`` under edge ``e`` with x in [lo, hi), in steps.

    Each step names columns made from those of the steps before; the last one is
    ``_inside``. Summed over all edges of a closed polygon it is the length inside.
    """
    left, right = f"greatest({e}.xl, {lo})", f"least({e}.xr, {hi})"

    def gap(t: str) -> str:
        """How far the edge lies above the segment at parameter ``t``."""
        x = f"({g}.x0 + {t} * _dx)"
        return f"{_height(e, x, '0D')} - ({g}.y0 + {t} * _dy)"

    # Where the segment lies along the edge it counts as inside: an upper edge adds
    # it, a lower edge must not take it away again.
    share = (
        "CASE WHEN _tb <= _ta THEN 0D"
        f" WHEN _p = 0 AND _q = 0 THEN if({e}.s > 0, _tb - _ta, 0D)"
        " WHEN _p >= 0 AND _q >= 0 THEN _tb - _ta"
        " WHEN _p <= 0 AND _q <= 0 THEN 0D"
        " ELSE (_tb - _ta) * greatest(_p, _q) / (abs(_p) + abs(_q)) END"
    )
    # A vertical segment on a right-hand border is outside by the half-open rule for
    # x, but a closed polygon holds it.
    overlap = f"(least(greatest({g}.y0, {g}.y1), {e}.yr) - greatest(least({g}.y0, {g}.y1), {e}.yl))"
    on_right = f"_dx = 0 AND {e}.v > 0 AND {g}.x0 = {e}.xl AND {e}.xl >= {lo} AND {e}.xl < {hi}"
    return [
        {"_dx": f"{g}.x1 - {g}.x0", "_dy": f"{g}.y1 - {g}.y0"},
        {
            "_t0": f"CASE WHEN _dx <> 0 THEN ({left} - {g}.x0) / _dx ELSE 0D END",
            "_t1": f"CASE WHEN _dx <> 0 THEN ({right} - {g}.x0) / _dx"
            f" WHEN {g}.x0 >= {left} AND {g}.x0 < {right} THEN 1D ELSE 0D END",
        },
        {
            "_ta": "least(greatest(least(_t0, _t1), 0D), 1D)",
            "_tb": "least(greatest(greatest(_t0, _t1), 0D), 1D)",
        },
        {
            "_p": f"CASE WHEN {e}.s <> 0 THEN {gap('_ta')} END",
            "_q": f"CASE WHEN {e}.s <> 0 THEN {gap('_tb')} END",
        },
        {
            "_inside": f"CASE WHEN {e}.s <> 0 THEN {e}.s * ({share}) * hypot(_dx, _dy)"
            f" WHEN {on_right} THEN greatest({overlap}, 0D) ELSE 0D END"
        },
    ]


def point_segment_distance(x: str, y: str, g: str) -> Column:
    dx, dy = f"({g}.x1 - {g}.x0)", f"({g}.y1 - {g}.y0)"
    squared = f"({dx} * {dx} + {dy} * {dy})"
    along = f"(({x} - {g}.x0) * {dx} + ({y} - {g}.y0) * {dy})"
    t = f"CASE WHEN {squared} > 0 THEN greatest(0D, least(1D, {along} / {squared})) ELSE 0D END"
    return F.expr(f"hypot({x} - ({g}.x0 + ({t}) * {dx}), {y} - ({g}.y0 + ({t}) * {dy}))")


# --- shape checks, clipping, convex mask -------------------------------------


def _cut(ring: str, axis: str, bound: float, keep_above: bool) -> str:
    """The part of a ring on one side of a line (Sutherland and Hodgman 1974)."""
    other = "y" if axis == "x" else "x"
    edge = _number(bound)
    side = ">=" if keep_above else "<="
    t = f"(({edge} - p.{axis}) / (q.{axis} - p.{axis}))"
    at = f"p.{other} + {t} * (q.{other} - p.{other})"
    met = _point(edge, at) if axis == "x" else _point(at, edge)
    p_in, q_in = f"p.{axis} {side} {edge}", f"q.{axis} {side} {edge}"
    emit = (
        f"CASE WHEN ({p_in}) AND ({q_in}) THEN array(p)"
        f" WHEN {p_in} THEN array(p, {met})"
        f" WHEN {q_in} THEN array({met})"
        f" ELSE slice(array(p), 1, 0) END"
    )
    return f"flatten(zip_with({ring}, {_rotate(ring)}, (p, q) -> {emit}))"


def clip_polygon(geom: str, bbox: BBox) -> Column:
    """Polygon cut to a rectangle; null when no area is left."""
    xmin, ymin, xmax, ymax = bbox
    ring = "r"
    for axis, bound, above in (("x", xmin, True), ("x", xmax, False), ("y", ymin, True), ("y", ymax, False)):
        ring = _let("c", ring, _cut("c", axis, bound, above))
    rings = f"filter(transform({geom}.parts, r -> {ring}), r -> size(r) >= 3 AND {_ring_twice_area('r')} <> 0)"
    closed = f"transform({rings}, r -> concat(r, slice(r, 1, 1)))"
    made = f"CASE WHEN size(cs) > 0 THEN {_geometry(f'{geom}.kind', 'cs')} END"
    return F.expr(_let("cs", closed, made))


def clip_line(geom: str, bbox: BBox) -> Column:
    """The stretches of a line inside a closed rectangle; null when none has a length.

    Each segment is held to the range of its parameter in which it lies between the
    four sides (Liang and Barsky 1984).
    """
    xmin, ymin, xmax, ymax = (_number(b) for b in bbox)
    limits = [("-d.x", f"s.x0 - {xmin}"), ("d.x", f"{xmax} - s.x0"), ("-d.y", f"s.y0 - {ymin}"), ("d.y", f"{ymax} - s.y0")]
    start = ", ".join(f"if({p} < 0, ({q}) / ({p}), 0D)" for p, q in limits)
    end = ", ".join(f"if({p} > 0, ({q}) / ({p}), 1D)" for p, q in limits)
    outside = " OR ".join(f"({p} = 0 AND {q} < 0)" for p, q in limits)
    span = f"named_struct('a', if({outside}, 2D, greatest(0D, {start})), 'b', least(1D, {end}), 's', s, 'd', d)"
    spans = f"transform({_segments(geom)}, s -> {_let('d', _point('s.x1 - s.x0', 's.y1 - s.y0'), span)})"
    at = [_point(f"k.s.x0 + k.{t} * k.d.x", f"k.s.y0 + k.{t} * k.d.y") for t in "ab"]
    parts = f"transform(filter({spans}, k -> k.a < k.b), k -> array({', '.join(at)}))"
    made = f"CASE WHEN size(cs) > 0 THEN {_geometry(repr('MultiLineString'), 'cs')} END"
    return F.expr(_let("cs", parts, made))


def clip_points(geom: str, bbox: BBox) -> Column:
    """The points inside a closed rectangle; null when none is."""
    xmin, ymin, xmax, ymax = (_number(b) for b in bbox)
    inside = f"p.x BETWEEN {xmin} AND {xmax} AND p.y BETWEEN {ymin} AND {ymax}"
    parts = f"filter(transform({geom}.parts, r -> filter(r, p -> {inside})), r -> size(r) > 0)"
    made = f"CASE WHEN size(cs) > 0 THEN {_geometry(f'{geom}.kind', 'cs')} END"
    return F.expr(_let("cs", parts, made))


def _side(s: str, x: str, y: str) -> str:
    return f"signum(({s}.x1 - {s}.x0) * ({y} - {s}.y0) - ({s}.y1 - {s}.y0) * ({x} - {s}.x0))"


def _sides(a: str, b: str) -> str:
    return f"{_side(a, f'{b}.x0', f'{b}.y0')} * {_side(a, f'{b}.x1', f'{b}.y1')}"


def _cross(a: str, b: str) -> str:
    """Two segments properly cross; touching ends do not count."""
    return f"({_sides(a, b)} < 0 AND {_sides(b, a)} < 0)"


def _touch(a: str, b: str) -> str:
    """Two segments share at least one point."""
    boxes = " AND ".join(
        f"least({p}.{c}0, {p}.{c}1) <= greatest({q}.{c}0, {q}.{c}1)"
        for p, q in ((a, b), (b, a))
        for c in "xy"
    )
    return f"({boxes} AND {_sides(a, b)} <= 0 AND {_sides(b, a)} <= 0)"


def intersects(geom: str, mask: str) -> Column:
    """True when two polygons share any point, a common border included."""
    boxes = (
        f"{geom}.xmin <= {mask}.xmax AND {mask}.xmin <= {geom}.xmax"
        f" AND {geom}.ymin <= {mask}.ymax AND {mask}.ymin <= {geom}.ymax"
    )
    borders = _let(
        "ms",
        _segments(mask),
        f"exists({_segments(geom)}, a -> exists(ms, b -> {_touch('a', 'b')}))",
    )
    nested = " OR ".join(
        _strictly_inside(_edges(outer), f"{inner}.parts[0][0].x", f"{inner}.parts[0][0].y")
        for outer, inner in ((mask, geom), (geom, mask))
    )
    return F.expr(f"({boxes}) AND ({borders} OR {nested})")


def _open(ring: str) -> str:
    return f"{ring}[0] <> element_at({ring}, -1)"


def _short(ring: str) -> str:
    return f"size(array_distinct({ring})) < 3"


def has_open_ring(geom: str) -> Column:
    return F.expr(f"{_is(geom, POLYGON_KINDS)} AND exists({geom}.parts, r -> {_open('r')})")


def has_short_ring(geom: str) -> Column:
    """A ring with fewer than three distinct vertices."""
    return F.expr(f"{_is(geom, POLYGON_KINDS)} AND exists({geom}.parts, r -> {_short('r')})")


@F.arrow_udf(T.BooleanType())
def _long_crosses(parts: pa.Array) -> pa.Array:
    held = arrays.view(parts)
    found = [
        arrays.crosses([held.ring(k) for k in range(held.rows[i], held.rows[i + 1])]) if held.known[i] else None
        for i in range(len(held.known))
    ]
    return pa.array(found, pa.bool_())


def crosses_itself(geom: str) -> Column:
    """Whether any two sides of a polygon cross, of one ring or of two.

    Shapes of few sides compare all pairs in the row; the others go to Arrow batches,
    which sort their sides and compare only those that overlap in x.
    """
    segs = f"transform({_segments(geom)}, (s, i) -> named_struct('x0', s.x0, 'y0', s.y0, 'x1', s.x1, 'y1', s.y1, 'i', i))"
    few = _let("ss", segs, f"exists(ss, a -> exists(ss, b -> b.i > a.i AND {_cross('a', 'b')}))")
    sides = f"size(flatten({geom}.parts))"
    polygon = _is(geom, POLYGON_KINDS)
    many = F.when(F.expr(f"{polygon} AND {sides} > {_FEW_SIDES}"), F.col(f"{geom}.parts"))
    return F.coalesce(_long_crosses(many), F.expr(f"{polygon} AND {sides} <= {_FEW_SIDES} AND {few}"))


@F.arrow_udf(T.BooleanType())
def _hole_leaves(parts: pa.Array, many: pa.Array) -> pa.Array:
    held, found = arrays.view(parts), []
    for i, several in enumerate(many.to_pylist()):
        rings = [held.ring(k) for k in range(held.rows[i], held.rows[i + 1])] if held.known[i] else []
        if several:
            turns = [arrays.twice_area(r) for r in rings]
            shells, holes = ([r for r, t in zip(rings, turns, strict=True) if t * way > 0] for way in (1, -1))
        else:
            shells, holes = rings[:1], rings[1:]
        found.append(arrays.leaves(shells, holes) if holes else None)
    return pa.array(found, pa.bool_())


def has_hole_outside(geom: str) -> Column:
    """A hole that lies outside its shell or leaves it, also through touching vertices.

    The holes of a MultiPolygon are its clockwise rings, held against all its shells.
    """
    holed = F.expr(f"{_is(geom, POLYGON_KINDS)} AND size({geom}.parts) > 1")
    return F.coalesce(_hole_leaves(F.when(holed, F.col(f"{geom}.parts")), F.expr(f"{geom}.kind = 'MultiPolygon'")), F.lit(False))


def repair_rings(geom: str) -> Column:
    """The repairs that cannot change the shape: close, drop repeats, orient."""
    plain = "filter(r, (p, i) -> i = 0 OR p <> get(r, i - 1))"
    closed = f"transform(transform({geom}.parts, r -> {plain}), r -> if({_open('r')}, concat(r, slice(r, 1, 1)), r))"
    return F.expr(
        f"CASE WHEN {geom}.kind = 'Polygon' THEN {_geometry(f'{geom}.kind', _orient(closed))}"
        f" WHEN {geom}.kind = 'MultiPolygon' THEN {_geometry(f'{geom}.kind', closed)}"
        f" ELSE {geom} END"
    )
