"""Spatial joins as equi joins on grid cells.

Each shape picks the grid level whose cell is at least as large as its box, so it
touches at most 2 x 2 cells whatever its size; a state outline and a garden shed
can meet without either being cut into thousands of cells (levels after Koudas
and Sevcik 1997). A pair may share several cells and is kept only in the one
holding the lower-left corner of the boxes' intersection (Dittrich and Seeger
2000), so no ``distinct`` is needed. The exact test follows on the few pairs left.

The area side is measured first. Below ``broadcast_bytes`` it is broadcast and the
other layer is never shuffled, so a crowded area or cell costs nothing. Above it
the join shuffles, and cells crowded on either side are salted over several tasks: the
crowded side is dealt out, the other one copied. Shapes of many edges are cut into strips
on both sides before they meet, so no row and no pair holds more than a strip's edges.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arealis.functions import geometry as g
from arealis.session import scratch_path

CELL = ["_role", "_lvl", "_cx", "_cy"]

# Bytes per edge (six fields of eight with header and offset) and per cell row without
# its key, used to size the area side.
_EDGE_BYTES = 64
_ROW_BYTES = 160


@dataclass(frozen=True)
class JoinSettings:
    """Limits that steer the physical plan; none of them changes a result."""

    broadcast_bytes: int = 256 << 20
    hot_rows: int = 2_000_000
    max_edges: int = 2048
    level_step: int = 2
    refine: int = 2


DEFAULT = JoinSettings()


@dataclass(frozen=True)
class AreaStats:
    """What the planner needs to know about the area side, from one small job."""

    rows: int
    edges: int
    max_edges: int
    levels: tuple[int, ...]
    box: tuple[float, float, float, float]
    split: bool = False
    key_bytes: int = 8

    def size(self) -> int:
        return self.rows * (_ROW_BYTES + self.key_bytes) + self.edges * _EDGE_BYTES


def _level(step: int, shape: str) -> str:
    """Grid level of a box: the exponent of the smallest cell not below its side."""
    side = f"greatest({shape}xmax - {shape}xmin, {shape}ymax - {shape}ymin, 0.001D)"
    return f"CAST(ceil(log2({side}) / {step}) * {step} AS INT)"


def _cell(value: str) -> str:
    return f"CAST(floor(({value}) / pow(2D, _lvl)) AS BIGINT)"


def _explode_cells(df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
    """One row per cell of the box at column ``_lvl``."""
    return df.select(
        "*", F.expr(f"explode(sequence({_cell(x0)}, {_cell(x1)}))").alias("_cx")
    ).select("*", F.expr(f"explode(sequence({_cell(y0)}, {_cell(y1)}))").alias("_cy"))


_AREA_BOX = ("_axmin", "_aymin", "_axmax", "_aymax")


def _measure(rows: DataFrame, step: int) -> AreaStats:
    got = rows.agg(
        F.expr("count(1)"),
        F.expr("coalesce(sum(size(_edges)), 0)"),
        F.expr("coalesce(max(size(_edges)), 0)"),
        F.expr(f"collect_set({_level(step, '_a')})"),
        F.expr("struct(min(_axmin), min(_aymin), max(_axmax), max(_aymax))"),
        F.expr("coalesce(bool_or(_lo > CAST('-Infinity' AS DOUBLE) OR _hi < CAST('Infinity' AS DOUBLE)), false)"),
        F.expr("coalesce(max(octet_length(CAST(_key AS STRING))), 0)"),
    ).first()
    return AreaStats(got[0], got[1], got[2], tuple(sorted(got[3])), tuple(got[4]), got[5], got[6])


def _cut_long(
    rows: DataFrame, limit: int, edges: str = "_edges", lo: str = "_lo", hi: str = "_hi", low: str = "_axmin", high: str = "_axmax"
) -> DataFrame:
    """Cut shapes with many edges into vertical strips, each with about as many edges.

    Every closed form used here is a sum over x, so a strip only needs the edges
    that reach into it and the result is the plain sum over strips. The borders are
    quantiles of the edges' left ends, so clumped vertices get narrow strips; only
    edges that lie above one and the same x can't be told apart by it.
    """
    n = f"CAST(ceil(size({edges}) / {limit}) AS INT)"
    spots = f"transform(sequence(1, {n} - 1), i -> xs[CAST(floor(i * CAST(size(xs) AS DOUBLE) / {n}) AS INT)])"
    cuts = g._let("xs", f"array_sort(transform({edges}, e -> e.xl))", f"array_distinct({spots})")
    none = "slice(array(0D), 1, 0)"
    cut = rows.selectExpr("*", f"if(size({edges}) > {limit}, {cuts}, {none}) AS _cuts").selectExpr(
        "*", "explode(sequence(0, size(_cuts))) AS _k"
    )
    left = "if(_k = 0, CAST('-Infinity' AS DOUBLE), get(_cuts, _k - 1))"
    right = "if(_k = size(_cuts), CAST('Infinity' AS DOUBLE), get(_cuts, _k))"
    cut = cut.withColumns({lo: F.expr(left), hi: F.expr(right)})
    return cut.withColumns(
        {
            edges: F.expr(f"if(size(_cuts) = 0, {edges}, filter({edges}, e -> e.xl <= {hi} AND e.xr >= {lo}))"),
            low: F.expr(f"greatest({low}, {lo})"),
            high: F.expr(f"least({high}, {hi})"),
        }
    ).select(*rows.columns)


@dataclass(frozen=True)
class PreparedAreas:
    """Polygons with their edges worked out and measured, for use in several joins."""

    rows: DataFrame
    stats: AreaStats
    settings: JoinSettings


def prepare(
    areas: DataFrame, key: str, geom: str = "geom", settings: JoinSettings = DEFAULT, keep: bool = True
) -> PreparedAreas:
    """Measure an area layer once; the result can stand for it in every join here.

    With ``keep`` the worked-out edges are written to the shared folder, so that several
    joins read them instead of working them out again.
    """
    rows = areas.where(g.is_kind(geom, g.POLYGON_KINDS)).select(
        F.col(key).alias("_key"),
        g.edges(geom).alias("_edges"),
        *(F.col(f"{geom}.{c[2:]}").alias(c) for c in _AREA_BOX),
        F.lit(float("-inf")).alias("_lo"),
        F.lit(float("inf")).alias("_hi"),
    )
    rows = _cut_long(rows, settings.max_edges)
    if keep:
        path = scratch_path(areas.sparkSession, "areas")
        rows.write.parquet(path)
        rows = areas.sparkSession.read.schema(rows.schema).parquet(path)
    return PreparedAreas(rows, _measure(rows, settings.level_step), settings)


Areas = DataFrame | PreparedAreas


def _prepared(areas: Areas, key: str, settings: JoinSettings) -> PreparedAreas:
    return areas if isinstance(areas, PreparedAreas) else prepare(areas, key, settings=settings, keep=False)


def _fits(cells: DataFrame, copies: int, stats: AreaStats, settings: JoinSettings) -> bool:
    """Whether the area side may be broadcast: by its bound, else by its measured size."""
    if copies * stats.size() <= settings.broadcast_bytes:
        return True
    got = cells.selectExpr("count(1)", "coalesce(sum(size(_edges)), 0)").first()
    return replace(stats, rows=got[0], edges=got[1]).size() <= settings.broadcast_bytes


def _join_cells(
    source: DataFrame, cells: DataFrame, fits: bool, salt_on: list[str], settings: JoinSettings
) -> DataFrame:
    if fits:
        return source.join(F.broadcast(cells), CELL)
    # Each crowded cell holds at least hot_rows rows or edges, so there are at most so
    # many of them: small enough to broadcast whatever the layer's size.
    most = settings.hot_rows

    def crowded(side: DataFrame, weight: str, out: str) -> DataFrame:
        weighed = side.groupBy(*CELL).agg(F.expr(weight).alias("_weight")).where(F.col("_weight") > most)
        return F.broadcast(weighed.selectExpr(*CELL, f"CAST(ceil(_weight / {most}) AS INT) AS {out}"))

    many, heavy = crowded(source, "count(1)", "_many"), crowded(cells, "sum(greatest(size(_edges), 1))", "_heavy")

    # Rows are dealt by their content, so a task run again deals them the same way.
    def dealt(by: list[str], salts: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.expr(f"coalesce({salts}, 1)")).cast("int")

    def copied(salts: str) -> Column:
        return F.explode(F.expr(f"sequence(0, coalesce({salts}, 1) - 1)"))

    left = source.join(many, CELL, "left").join(heavy, CELL, "left")
    left = left.withColumn("_s1", dealt(salt_on, "_many")).withColumn("_s2", copied("_heavy")).drop("_many", "_heavy")
    right = cells.join(many, CELL, "left").join(heavy, CELL, "left")
    own = ["_key", "_axmin", "_aymin", "_lo"] if "_axmin" in cells.columns else ["_key", "_lo"]
    right = right.withColumn("_s1", copied("_many")).withColumn("_s2", dealt(own, "_heavy")).drop("_many", "_heavy")
    return left.join(right, [*CELL, "_s1", "_s2"])


def _source_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def _spreading(df: DataFrame, geom: str) -> list[str]:
    """Columns that tell rows apart, used to spread copies over salts."""
    return [c for c in _source_names(df) if c != geom]


def join_within(
    points: DataFrame,
    areas: Areas,
    key: str,
    geom: str = "geom",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Inner join of points with the areas strictly containing them.

    A point on a border belongs to no area. Cells wholly inside an area carry no
    edges, so most points are accepted without any test.
    """
    ready = _prepared(areas, key, settings)
    rows, stats, settings = ready.rows, ready.stats, ready.settings
    kept = [c for c in _source_names(points) if c != key]
    if not stats.rows:
        return points.select(*kept, F.lit(None).alias(key)).limit(0)

    level = f"{_level(settings.level_step, '_a')} - {settings.refine}"
    cells = _explode_cells(rows.selectExpr("*", f"{level} AS _lvl"), *_AREA_BOX).selectExpr(
        "*", "_cx * pow(2D, _lvl) AS _x0", "_cy * pow(2D, _lvl) AS _y0",
        "(_cx + 1) * pow(2D, _lvl) AS _x1", "(_cy + 1) * pow(2D, _lvl) AS _y1",
    )
    matters = "e.xr >= _x0 AND e.xl <= _x1 AND greatest(e.yl, e.yr) >= _y0"
    reaches = f"{matters} AND least(e.yl, e.yr) <= _y1"
    middle = g._winding("_edges", "((_x0 + _x1) / 2)", "((_y0 + _y1) / 2)")
    # A strip only knows its own edges, so only whole shapes can skip the test.
    part = "(_lo > CAST('-Infinity' AS DOUBLE) OR _hi < CAST('Infinity' AS DOUBLE))"
    cells = (
        cells.selectExpr("*", f"{part} OR exists(_edges, e -> {reaches}) AS _tested")
        .where(f"_tested OR {middle} <> 0")
        .selectExpr(
            "0 AS _role", "_lvl", "_cx", "_cy", "_key", "_tested", "_lo", "_hi",
            f"if(_tested, filter(_edges, e -> {matters}), slice(_edges, 1, 0)) AS _edges",
        )
    )
    per_axis = 2**settings.refine + 1
    fits = _fits(cells, per_axis**2, stats, settings)

    levels = ", ".join(str(v - settings.refine) for v in stats.levels)
    bx0, by0, bx1, by1 = (g._number(b) for b in stats.box)
    x, y = f"{geom}.xmin", f"{geom}.ymin"
    source = (
        points.where(f"{x} BETWEEN {bx0} AND {bx1} AND {y} BETWEEN {by0} AND {by1}")
        .selectExpr(*kept, f"{x} AS _px", f"{y} AS _py", f"explode(array({levels})) AS _lvl")
        .selectExpr("*", "0 AS _role", f"{_cell('_px')} AS _cx", f"{_cell('_py')} AS _cy")
    )
    inside = (
        "_px >= _lo AND _px < _hi AND"
        f" (NOT _tested OR {g._strictly_inside('_edges', '_px', '_py')})"
    )
    salt_on = ["_px", "_py", *_spreading(points, geom)]
    joined = _join_cells(source, cells, fits, salt_on, settings).where(inside)
    return joined.select(*kept, F.col("_key").alias(key))


def _boxed(geom: str = "geom") -> list[Column]:
    return [F.col(f"{geom}.{c}").alias(f"_s{c}") for c in ("xmin", "ymin", "xmax", "ymax")]


def _box_pairs(boxed: DataFrame, ready: PreparedAreas) -> DataFrame:
    """Pairs of source rows and area pieces whose boxes meet, each once.

    Source rows carry their box (``_boxed``) and what is needed of them later, but no
    whole geometry, as they are copied to each cell they touch.
    """
    rows, stats, settings = ready.rows, ready.stats, ready.settings
    step = settings.level_step
    if not stats.rows:
        return boxed.limit(0).join(rows, F.lit(False))
    x0, y0, x1, y1 = (g._number(b) for b in stats.box)
    boxed = boxed.where(f"_sxmin <= {x1} AND _sxmax >= {x0} AND _symin <= {y1} AND _symax >= {y0}")

    # Cells are held to the areas' extent, so no level above it is ever needed.
    lowest = min(stats.levels)
    span = max(stats.box[2] - stats.box[0], stats.box[3] - stats.box[1], 1e-3)
    highest = max(math.ceil(math.log2(span) / step) * step + step, max(stats.levels))
    own = f"least(greatest({_level(step, '_s')}, {lowest}), {highest})"
    # The levels of sources larger than the smallest areas, found within the same job.
    wide = boxed.agg(
        F.expr(f"coalesce(collect_set(if({own} > {lowest}, {own}, NULL)), array())")
    ).scalar()

    # Role 0: the source is no larger than the area; they meet at the area's level.
    # Role 1: the source is larger; the area is lifted to the source's level.
    entry = "named_struct('_role', {}, '_lvl', {})"
    levels = ", ".join(str(v) for v in stats.levels)
    from_source = (
        f"concat(transform(filter(array({levels}), v -> v >= _own), v -> {entry.format(0, 'v')}),"
        f" filter(array({entry.format(1, '_own')}), e -> _own > {lowest}))"
    )
    from_area = (
        f"concat(array({entry.format(0, '_own')}),"
        f" transform(filter(_wide, v -> v > _own), v -> {entry.format(1, 'v')}))"
    )
    left = _explode_cells(
        boxed.selectExpr("*", f"{own} AS _own")
        .selectExpr("*", f"inline({from_source})")
        .drop("_own"),
        f"greatest(_sxmin, {x0})",
        f"greatest(_symin, {y0})",
        f"least(_sxmax, {x1})",
        f"least(_symax, {y1})",
    )
    cells = _explode_cells(
        rows.select("*", F.expr(f"{_level(step, '_a')} AS _own"), wide.alias("_wide"))
        .selectExpr("*", f"inline({from_area})")
        .drop("_own", "_wide"),
        *_AREA_BOX,
    )
    copies = 4 * (1 + (highest - lowest) // step)
    fits = _fits(cells, copies, stats, settings)
    salt_on = ["_sxmin", "_symin", *_source_names(boxed)]
    meet = (
        "_sxmin <= _axmax AND _axmin <= _sxmax AND _symin <= _aymax AND _aymin <= _symax"
        f" AND {_cell('greatest(_sxmin, _axmin)')} = _cx AND {_cell('greatest(_symin, _aymin)')} = _cy"
    )
    return _join_cells(left, cells, fits, salt_on, settings).where(meet).drop(*CELL, "_s1", "_s2")


def area_terms(
    source: DataFrame,
    areas: Areas,
    key: str,
    geom: str = "geom",
    out: str = "term",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Signed parts whose sum over a source row and an area is their overlap area.

    One row per pair of edges sharing some x, so the arithmetic runs in generated
    code. Sums per area need nothing else: partial aggregation leaves one row per
    area and task to shuffle.
    """
    ready = _prepared(areas, key, settings)
    polygons = source.where(g.is_kind(geom, g.POLYGON_KINDS))
    kept = [c for c in _source_names(source) if c not in (geom, key)]
    parts = g.edge_pair("_e", "_h", "_y0", "_lo", "_hi")
    heights = [f"{parts[n].format(a='_a', b='_b')} AS _{n}" for n in ("fa", "fb", "ga", "gb")]
    # Both sides come in strips; a pair of them counts where both lie.
    pieces = polygons.select(
        *kept, F.expr(f"filter({g._edges(geom)}, e -> e.s <> 0)").alias("_oe"), *_boxed(geom),
        F.lit(float("-inf")).alias("_slo"), F.lit(float("inf")).alias("_shi"),
    )
    pieces = _cut_long(pieces, ready.settings.max_edges, "_oe", "_slo", "_shi", "_sxmin", "_sxmax")
    reach = "filter({}, e -> e.xr > {}xmin AND e.xl < {}xmax)"
    rows = (
        _box_pairs(pieces, ready)
        .selectExpr(
            *kept, f"_key AS `{key}`", "greatest(_symin, _aymin) AS _y0", "greatest(_lo, _slo) AS _lo", "least(_hi, _shi) AS _hi",
            f"{reach.format('_edges', '_s', '_s')} AS _edges", "_symin", f"explode({reach.format('_oe', '_a', '_a')}) AS _e",
        )
        .selectExpr("*", "explode(_edges) AS _h")
        .where(
            "_h.s <> 0 AND greatest(_h.yl, _h.yr) >= _symin"
            f" AND {parts['b']} > {parts['a']}"
        )
        .selectExpr(*kept, key, "_e", "_h", "_y0", f"{parts['a']} AS _a", f"{parts['b']} AS _b")
        .selectExpr(*kept, key, "_b - _a AS _w", "_e.s * _h.s AS _s", *heights)
    )
    term = g.area_under_both("_w", "_s", "_fa", "_fb", "_ga", "_gb")
    return rows.selectExpr(*kept, key, f"{term} AS `{out}`")


def overlay_area(
    source: DataFrame,
    areas: Areas,
    key: str,
    id_cols: list[str],
    geom: str = "geom",
    out: str = "piece_area",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Polygon pairs that share some area, with that area.

    ``id_cols`` identify a source row. Pairs that only touch are left out. The
    pieces themselves are never built: their area is a closed form of the edges.
    """
    terms = area_terms(source, areas, key, geom, "_t", settings)
    return _per_pair(terms, key, id_cols, out).where(F.col(out) > g.MIN_PIECE_AREA)


def overlay_layers(
    layers: Mapping[str, DataFrame],
    areas: Areas,
    key: str,
    id_cols: Sequence[str],
    geom: str = "geom",
    out: str = "piece_area",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """``overlay_area`` of several layers at once: their columns, ``layer_name``, ``layer_ids``, key and area.

    Every different shape is overlaid once, however many layers and rows have it; layers drawn on one
    mesh share all of the work. Shapes are told apart by two 64-bit hashes and their box. A
    column of a layer comes back as ``<layer>_<column>``, null in rows of the others.
    ``id_cols`` identify a row within its layer.
    """
    box = ["xmin", "ymin", "xmax", "ymax"]
    shape = ["_h0", "_h1", *(f"_{c}" for c in box)]
    rows = []
    for name, source in layers.items():
        own = source.where(g.is_kind(geom, g.POLYGON_KINDS))
        rows.append(
            own.select(
                F.lit(name).alias("layer_name"),
                F.array(*(F.col(c).cast("string") for c in id_cols)).alias("layer_ids"),
                *(F.xxhash64(F.lit(i), geom).alias(f"_h{i}") for i in range(2)),
                *(F.col(f"{geom}.{c}").alias(f"_{c}") for c in box),
                *(F.col(c).alias(f"{name}_{c}") for c in _source_names(source) if c not in (geom, key, *id_cols)),
                F.col(geom).alias("_geom"),
            )
        )
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    # shapes are small for what their overlay costs, so they are dealt out by number, not by bytes
    tasks = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = every.groupBy(*shape).agg(F.first("_geom").alias("geom")).repartition(tasks, *shape)
    terms = area_terms(shapes.select(F.struct(*shape).alias("shape_key"), "geom"), areas, key, out="_t", settings=settings)
    pieces = terms.groupBy("shape_key", key).agg(F.sum("_t").alias("_t")).select("shape_key.*", key, "_t")
    # a row is known by its ids, so parts under the same ids are one
    met = every.drop("_geom").join(pieces, shape).drop(*shape)
    return _per_pair(met, key, ["layer_name", "layer_ids"], out).where(F.col(out) > g.MIN_PIECE_AREA)


def _per_pair(terms: DataFrame, key: str, id_cols: list[str], out: str) -> DataFrame:
    """Terms summed per source row and area.

    All terms of a pair arise in one task (one per strip of a split area), so partial
    aggregation leaves about one row per pair to shuffle.
    """
    kept = _source_names(terms.drop("_t", key))
    rest = [c for c in kept if c not in id_cols]
    summed = terms.groupBy(*id_cols, key).agg(
        F.sum("_t").alias(out), *(F.first(c).alias(c) for c in rest)
    )
    return summed.select(*kept, key, out)


def length_terms(
    lines: DataFrame,
    areas: Areas,
    key: str,
    geom: str = "geom",
    out: str = "term",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Signed parts whose sum over a line and an area is the line's length inside it."""
    ready = _prepared(areas, key, settings)
    only = lines.where(g.is_kind(geom, g.LINE_KINDS))
    kept = [c for c in _source_names(lines) if c not in (geom, key)]
    near = (
        "_e.xl <= greatest(_g.x0, _g.x1) AND _e.xr >= least(_g.x0, _g.x1)"
        " AND greatest(_e.yl, _e.yr) >= least(_g.y0, _g.y1)"
    )
    # Lines of many segments come in pieces, each with its own box.
    limit = ready.settings.max_edges
    slices = f"transform(sequence(0, CAST(floor((size(gs) - 1) / {limit}) AS INT)), k -> slice(gs, k * {limit} + 1, {limit}))"
    box = [
        f"array_{end}(transform(_gs, s -> {pick}(s.{axis}0, s.{axis}1))) AS _s{axis}{end}"
        for axis in "xy"
        for end, pick in (("min", "least"), ("max", "greatest"))
    ]
    pieces = only.selectExpr(*kept, f"explode({g._let('gs', g._segments(geom), slices)}) AS _gs").selectExpr("*", *box)
    rows = (
        _box_pairs(pieces, ready)
        .selectExpr(*kept, f"_key AS `{key}`", "_lo", "_hi", "_edges", "explode(_gs) AS _g")
        .selectExpr("*", "explode(_edges) AS _e")
        .where(near)
    )
    for step in g.inside_length("_e", "_g", "_lo", "_hi"):
        rows = rows.selectExpr("*", *(f"{body} AS {name}" for name, body in step.items()))
    return rows.selectExpr(*kept, key, f"_inside AS `{out}`")


def overlay_length(
    lines: DataFrame,
    areas: Areas,
    key: str,
    id_cols: list[str],
    geom: str = "geom",
    out: str = "clipped_length",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Line and polygon pairs with the length of the line inside the closed polygon.

    A line along a shared border counts in both areas.
    """
    terms = length_terms(lines, areas, key, geom, "_t", settings)
    return _per_pair(terms, key, id_cols, out).where(F.col(out) > g.MIN_PIECE_LENGTH)


# --- nearest -----------------------------------------------------------------

# Levels of the first bound, from the whole extent down, two exponents apart.
_LEVELS = 14


def _occupied(features: DataFrame, levels: list[int]) -> DataFrame:
    """A vertex in each cell that has any, at the given levels."""
    spots = features.select(F.explode(F.flatten("geom.parts")).alias("_v")).selectExpr("_v.x AS _vx", "_v.y AS _vy")
    cells = spots.selectExpr("*", f"explode(array({', '.join(map(str, levels))})) AS _lvl").selectExpr(
        "_lvl", f"{_cell('_vx')} AS _cx", f"{_cell('_vy')} AS _cy", "_vx", "_vy"
    )
    return cells.groupBy("_lvl", "_cx", "_cy").agg(F.first("_vx").alias("_vx"), F.first("_vy").alias("_vy"))


def _nearer(probes: DataFrame, features: DataFrame, levels: list[int], key: str, path: str) -> DataFrame:
    """Per left row the least distance to a vertex of the probed cells, written once."""
    met = probes.join(_occupied(features, levels), ["_lvl", "_cx", "_cy"])
    found = met.groupBy(key, "_px", "_py").agg(F.expr("min(hypot(_vx - _px, _vy - _py)) AS _r"))
    found.write.parquet(path)
    return probes.sparkSession.read.schema(found.schema).parquet(path)


def _upper_bounds(
    points: DataFrame, key: str, features: DataFrame, box: tuple[float, float, float, float], settings: JoinSettings
) -> DataFrame:
    """A distance per left row within which a feature is certain to lie, a few times the true one.

    First each point looks at the 3 x 3 cells around it at levels from the whole extent
    down, so how features are spread, clumped or scattered far, doesn't matter: the
    smallest level with a neighbour bounds the distance from both sides. Then the circle
    of that bound is looked through once more in cells of a quarter to half its radius.
    All are equi joins on cells; what a point probes doesn't grow with the layer.
    """
    spark = points.sparkSession
    x0, y0, x1, y1 = (g._number(b) for b in box)
    top = math.ceil(math.log2(max(box[2] - box[0], box[3] - box[1], 1e-3))) + 1
    levels = [top - 2 * i for i in range(_LEVELS)]
    around = "explode(sequence({0} - 1, {0} + 1))"
    held = points.selectExpr(key, "_px", "_py", f"least(greatest(_px, {x0}), {x1}) AS _hx", f"least(greatest(_py, {y0}), {y1}) AS _hy")
    probes = (
        held.selectExpr("*", f"explode(array({', '.join(map(str, levels))})) AS _lvl")
        .selectExpr(key, "_px", "_py", "_lvl", "_hy", f"{around.format(_cell('_hx'))} AS _cx")
        .selectExpr(key, "_px", "_py", "_lvl", "_cx", f"{around.format(_cell('_hy'))} AS _cy")
    )
    bounds = _nearer(probes, features, levels, key, scratch_path(spark, "bounds"))
    # the nearest feature's vertex may lie in any cell of the circle, its own bound included
    level = "CAST(floor(log2(_r / 2)) AS INT)"
    found = bounds.where("_r > 0").agg(F.collect_set(F.expr(level))).first()[0]
    if not found:
        return bounds
    cells = (
        bounds.where("_r > 0")
        .selectExpr(key, "_px", "_py", "_r", f"{level} AS _lvl")
        .selectExpr("*", f"explode(sequence({_cell('_px - _r')}, {_cell('_px + _r')})) AS _cx")
        .selectExpr("*", f"explode(sequence({_cell('_py - _r')}, {_cell('_py + _r')})) AS _cy")
    )
    closer = _nearer(cells, features, sorted(found), key, scratch_path(spark, "bounds"))
    both = bounds.unionByName(closer).groupBy(key, "_px", "_py").agg(F.min("_r").alias("_r"))
    path = scratch_path(spark, "bounds")
    both.write.parquet(path)
    return spark.read.schema(both.schema).parquet(path)


def nearest_pairs(
    left: DataFrame, right: DataFrame, key: str, geom: str = "geom", settings: JoinSettings = DEFAULT
) -> DataFrame:
    """Left points with the segments and polygons that ``join_nearest`` measures.

    A point meets what touches the circle of its bound: a few features, unless many lie
    about as far from it as the nearest one.
    """
    points = left.selectExpr(key, f"{geom}.xmin AS _px", f"{geom}.ymin AS _py").where(
        f"_px IS NOT NULL AND {key} IS NOT NULL"
    )
    features = right.where(F.col(geom).isNotNull()).select(F.col(geom).alias("geom"))
    extent = features.selectExpr(
        "min(geom.xmin)", "min(geom.ymin)", "max(geom.xmax)", "max(geom.ymax)"
    ).first()
    if extent[0] is None:
        bounds = points.select(key, "_px", "_py", F.lit(0.0).alias("_r")).limit(0)
    else:
        bounds = _upper_bounds(points, key, features, tuple(extent), settings)
    # A hair wider than the bound, so the feature that set it is found again.
    reach = "(_r * (1 + 1e-9D) + 1e-9D)"
    circles = bounds.selectExpr(
        f"named_struct('key', {key}, 'x', _px, 'y', _py) AS _key",
        "slice(array(named_struct('xl', 0D, 'yl', 0D, 'xr', 0D, 'yr', 0D, 's', 0, 'v', 0)), 1, 0) AS _edges",
        f"_px - {reach} AS _axmin",
        f"_py - {reach} AS _aymin",
        f"_px + {reach} AS _axmax",
        f"_py + {reach} AS _aymax",
        "CAST('-Infinity' AS DOUBLE) AS _lo",
        "CAST('Infinity' AS DOUBLE) AS _hi",
    )
    ready = PreparedAreas(circles, _measure(circles, settings.level_step), settings)
    by_segment = features.select(F.explode(g.segments("geom")).alias("seg")).selectExpr(
        "seg", "CAST(NULL AS array<array<struct<x:double,y:double>>>) AS rings",
        "least(seg.x0, seg.x1) AS _sxmin", "least(seg.y0, seg.y1) AS _symin",
        "greatest(seg.x0, seg.x1) AS _sxmax", "greatest(seg.y0, seg.y1) AS _symax",
    )
    whole = features.where(g.is_kind("geom", g.POLYGON_KINDS)).select(
        F.expr("CAST(NULL AS struct<x0:double,y0:double,x1:double,y1:double>)").alias("seg"),
        F.col("geom.parts").alias("rings"),
        *_boxed(),
    )
    return _box_pairs(by_segment.unionByName(whole), ready)


def join_nearest(
    left: DataFrame,
    right: DataFrame,
    key: str,
    geom: str = "geom",
    out: str = "distance",
    settings: JoinSettings = DEFAULT,
) -> DataFrame:
    """Distance from each left point to the nearest right feature of any kind.

    One row per ``key``; 0 inside a polygon. Cells around each point give it a distance
    that certainly reaches a feature, then only features within that distance are
    measured, segment by segment.
    """
    pairs = nearest_pairs(left, right, key, geom, settings)
    held = "_key.x BETWEEN _sxmin AND _sxmax AND _key.y BETWEEN _symin AND _symax"
    inside = g._strictly_inside(g._edges("named_struct('parts', rings)"), "_key.x", "_key.y")
    apart = F.when(F.col("seg").isNotNull(), g.point_segment_distance("_key.x", "_key.y", "seg")).when(
        F.expr(f"{held} AND {inside}"), F.lit(0.0)
    )
    return pairs.groupBy(F.col("_key.key").alias(key)).agg(F.min(apart).alias(out))
