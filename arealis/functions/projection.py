"""Longitude and latitude to transverse Mercator metres and back.

Krueger n-series (Karney 2011), three terms, on the GRS80 ellipsoid. GDA94 and
WGS84 are treated as one datum; ``datum="GDA2020"`` first takes degrees of that datum,
about 1.8 m away, back to GDA94 by the published seven-parameter transformation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from arealis.functions import geometry as g

# GRS80 ellipsoid and the zone 55 grid (EPSG:28355).
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0
CENTRAL_MERIDIAN = 147.0


@dataclass(frozen=True)
class Grid:
    """One transverse Mercator grid."""

    central_meridian: float = CENTRAL_MERIDIAN
    scale: float = SCALE
    easting: float = FALSE_EASTING
    northing: float = FALSE_NORTHING


ZONE_55 = Grid()

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = 2 * math.sqrt(_N) / (1 + _N)
# Published series coefficients, forward and inverse.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)


def _sum(start: str, terms: list[str], sign: str) -> str:
    return f"({start} {sign} " + f" {sign} ".join(terms) + ")"


def _forward(lon: str, lat: str, grid: Grid) -> str:
    n = g._number
    phi, lam = f"radians({lat})", f"radians({lon} - {n(grid.central_meridian)})"
    t = f"sinh(atanh(sin({phi})) - atanh(sin({phi}) * {n(_ECC)}) * {n(_ECC)})"
    angles = g._let(
        "k",
        f"named_struct('t', {t}, 'l', {lam})",
        "named_struct('xi', atan2(k.t, cos(k.l)), 'eta', atanh(sin(k.l) / sqrt(k.t * k.t + 1)))",
    )
    ks = [(2 * (j + 1), a) for j, a in enumerate(_ALPHA)]
    east = _sum("c.eta", [f"cos(c.xi * {k}) * sinh(c.eta * {k}) * {n(a)}" for k, a in ks], "+")
    north = _sum("c.xi", [f"sin(c.xi * {k}) * cosh(c.eta * {k}) * {n(a)}" for k, a in ks], "+")
    radius = n(grid.scale * _RADIUS)
    spot = g._point(f"{east} * {radius} + {n(grid.easting)}", f"{north} * {radius} + {n(grid.northing)}")
    return g._let("c", angles, spot)


def _inverse(x: str, y: str, grid: Grid) -> str:
    n = g._number
    radius = n(grid.scale * _RADIUS)
    scaled = (
        f"named_struct('xi', ({y} - {n(grid.northing)}) / {radius},"
        f" 'eta', ({x} - {n(grid.easting)}) / {radius})"
    )
    ks = [(2 * (j + 1), v) for j, v in enumerate(_BETA)]
    xi = _sum("c.xi", [f"sin(c.xi * {k}) * cosh(c.eta * {k}) * {n(v)}" for k, v in ks], "-")
    eta = _sum("c.eta", [f"cos(c.xi * {k}) * sinh(c.eta * {k}) * {n(v)}" for k, v in ks], "-")
    undone = g._let("c", scaled, f"named_struct('xi', {xi}, 'eta', {eta})")
    lon = f"degrees(atan2(sinh(u.eta), cos(u.xi))) + {n(grid.central_meridian)}"
    chi = "asin(sin(u.xi) / cosh(u.eta))"
    lat = g._let(
        "v",
        chi,
        "degrees(" + _sum("v", [f"sin(v * {2 * (j + 1)}) * {n(d)}" for j, d in enumerate(_DELTA)], "+") + ")",
    )
    return g._let("u", undone, g._point(lon, lat))


# GDA94 to GDA2020, in metres, arc seconds and parts per million
# (coordinate frame rotation; applied backwards here).
SHIFT = (0.06155, -0.01087, -0.04019)
ROTATION = (-0.0394924, -0.0327221, -0.0328979)
SCALE_PPM = -0.009994

DATUMS = ("GDA94", "WGS84", "GDA2020")


def _to_gda94(lon: str, lat: str) -> str:
    """Degrees of GDA2020 as a point in degrees of GDA94, over Earth-centred metres."""
    n = g._number
    e2 = FLATTENING * (2 - FLATTENING)
    rx, ry, rz = (math.radians(s / 3600) for s in ROTATION)
    tx, ty, tz = SHIFT
    scale = 1 + SCALE_PPM * 1e-6
    nu = f"({n(SEMI_MAJOR)} / sqrt(1 - {n(e2)} * sin(radians({lat})) * sin(radians({lat}))))"
    there = (
        f"named_struct('x', {nu} * cos(radians({lat})) * cos(radians({lon})) - {n(tx)},"
        f" 'y', {nu} * cos(radians({lat})) * sin(radians({lon})) - {n(ty)},"
        f" 'z', {nu} * (1 - {n(e2)}) * sin(radians({lat})) - {n(tz)})"
    )
    # the inverse of a rotation this small is its transpose, to well below a micrometre
    back = (
        f"named_struct('x', (c.x - {n(rz)} * c.y + {n(ry)} * c.z) / {n(scale)},"
        f" 'y', ({n(rz)} * c.x + c.y - {n(rx)} * c.z) / {n(scale)},"
        f" 'z', (-{n(ry)} * c.x + {n(rx)} * c.y + c.z) / {n(scale)})"
    )
    # latitude by three fixed-point steps from the spherical guess, each hundreds of times closer
    p = "sqrt(h.x * h.x + h.y * h.y)"
    phi = f"atan2(h.z, {p} * (1 - {n(e2)}))"
    for _ in range(3):
        phi = g._let("f", phi, f"atan2(h.z + {n(e2)} * {n(SEMI_MAJOR)} / sqrt(1 - {n(e2)} * sin(f) * sin(f)) * sin(f), {p})")
    return g._let("h", g._let("c", there, back), g._point("degrees(atan2(h.y, h.x))", f"degrees({phi})"))


def _shifted(lon: str, lat: str, grid: Grid, datum: str) -> str:
    if datum not in DATUMS:
        raise ValueError(f"datum is one of {', '.join(DATUMS)}")
    if datum != "GDA2020":
        return _forward(lon, lat, grid)
    return g._let("old", _to_gda94(lon, lat), _forward("old.x", "old.y", grid))


def forward(lon: str, lat: str, grid: Grid = ZONE_55, datum: str = "GDA94") -> Column:
    """Degrees to a grid point in metres."""
    return F.expr(_shifted(lon, lat, grid, datum))


def forward_point(lon: str, lat: str, grid: Grid = ZONE_55, datum: str = "GDA94") -> Column:
    """Degrees to a point geometry in metres."""
    made = (
        "CASE WHEN m.x IS NOT NULL AND m.y IS NOT NULL THEN named_struct('kind', 'Point',"
        " 'parts', array(array(m)), 'xmin', m.x, 'ymin', m.y, 'xmax', m.x, 'ymax', m.y) END"
    )
    return F.expr(g._let("m", _shifted(lon, lat, grid, datum), made))


def inverse(x: str, y: str, grid: Grid = ZONE_55) -> Column:
    """Grid metres back to a degrees point (x = longitude, y = latitude)."""
    return F.expr(_inverse(x, y, grid))


def project(geom: str, grid: Grid = ZONE_55, datum: str = "GDA94") -> Column:
    """Every vertex from degrees of the given datum to metres of the grid on GDA94."""
    return g.map_points(geom, _shifted("p.x", "p.y", grid, datum))


def unproject(geom: str, grid: Grid = ZONE_55) -> Column:
    """Every vertex from metres to degrees."""
    return g.map_points(geom, _inverse("p.x", "p.y", grid))
