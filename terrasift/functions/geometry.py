"""Plane geometry and angles as Column expressions, so that they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, digits: int = 6) -> Column:
    """Half-up at ``digits`` decimals by floor, which engines agree on."""
    unit = 10.0**digits
    return F.floor(col(c) * unit + 0.5) / F.lit(unit)


def cell(c: str | Column, size: float, origin: str | float | Column = 0.0) -> Column:
    """The index of the grid cell of a coordinate."""
    base = F.lit(origin) if isinstance(origin, (int, float)) else col(origin)
    return F.floor((col(c) - base) / F.lit(float(size)))


def in_box(x, y, xmin, ymin, xmax, ymax, closed: bool = True) -> Column:
    """Whether a point lies in a box, with or without its boundary."""
    x, y, a, b, c, d = (col(v) for v in (x, y, xmin, ymin, xmax, ymax))
    return (x >= a) & (x <= c) & (y >= b) & (y <= d) if closed else (x > a) & (x < c) & (y > b) & (y < d)


def crosses(x, y, x1, y1, x2, y2) -> Column:
    """Whether the ray from a point to the right crosses an edge: the even-odd rule."""
    x, y, x1, y1, x2, y2 = (col(v) for v in (x, y, x1, y1, x2, y2))
    return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def on_segment(x, y, x1, y1, x2, y2) -> Column:
    """Whether a point lies exactly on a closed segment."""
    x, y, x1, y1, x2, y2 = (col(v) for v in (x, y, x1, y1, x2, y2))
    line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
    return line & in_box(x, y, F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def projection(x, y, x1, y1, x2, y2) -> Column:
    """Where on a segment (0 to 1) the nearest point to a point lies; 0 on a segment without length."""
    x, y, x1, y1, x2, y2 = (col(v) for v in (x, y, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    t = ((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(x, y, x1, y1, x2, y2) -> Column:
    """The distance from a point to a closed segment."""
    t = projection(x, y, x1, y1, x2, y2)
    return distance(x, y, col(x1) + t * (col(x2) - col(x1)), col(y1) + t * (col(y2) - col(y1)))


def shoelace_term(x1, y1, x2, y2) -> Column:
    """An edge's share of twice the signed area of its ring."""
    return col(x1) * col(y2) - col(x2) * col(y1)


def azimuth(x1, y1, x2, y2) -> Column:
    """Degrees from north, clockwise; null for a move along an axis."""
    dx, dy = col(x2) - col(x1), col(y2) - col(y1)
    angle = F.degrees(F.atan(F.abs(dx) / F.abs(dy)))
    return (
        F.when((dx > 0) & (dy > 0), angle)
        .when((dx > 0) & (dy < 0), 180 - angle)
        .when((dx < 0) & (dy < 0), 180 + angle)
        .when((dx < 0) & (dy > 0), 360 - angle)
    )


def dms_to_degrees(text: str | Column) -> Column:
    """Degrees of ``D:M:S H``; south and west are negative, text that doesn't parse is null."""
    parts = F.split(F.regexp_extract(col(text), r"([\d.]+:[\d.]+:[\d.]+)", 1), ":")
    value = sum((F.try_element_at(parts, F.lit(k + 1)).try_cast("double") / 60**k for k in (1, 2)), F.try_element_at(parts, F.lit(1)).try_cast("double"))
    return F.when(F.regexp_extract(col(text), r"([NESW])\s*$", 1).isin("S", "W"), -value).otherwise(value)


def ddmm_to_degrees(text: str | Column) -> Column:
    """Degrees of ``DDMM.mmH`` or ``DDDMM.mmH``; south and west are negative, text that doesn't parse is null."""
    digits = F.regexp_extract(col(text), r"^(\d+)\d\d\.", 1).try_cast("double")
    minutes = F.regexp_extract(col(text), r"(\d\d\.\d+)", 1).try_cast("double")
    value = digits + minutes / 60
    return F.when(F.substring(col(text), -1, 1).isin("S", "W"), -value).otherwise(value)


def signed_heading(heading: str | Column) -> Column:
    """A heading of 0 to 360 degrees as -180 to 180."""
    return F.when(col(heading) > 180, col(heading) - 360).otherwise(col(heading))


def flipped_roll(roll: str | Column) -> Column:
    """The roll of a sensor that is mounted upside down."""
    return F.when(col(roll) < 0, 180 + col(roll)).otherwise(col(roll) - 180)


#: Ellipsoid and projection constants of the public EPSG registry: central meridian, scale, false easting, northing.
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
PROJECTIONS = {2180: (19.0, 0.9993, 500000.0, -5300000.0), 2177: (18.0, 0.999923, 6500000.0, 0.0), 2174: (21.0, 0.9998, 4637000.0, 5467000.0)}


def _series() -> tuple[float, list[float], list[float]]:
    """The rectifying radius and the coefficients of the Krueger series to the fourth order."""
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, back


def to_grid(lat: str | Column, lon: str | Column, srid: int) -> tuple[Column, Column]:
    """Easting and northing of geographic degrees, by transverse Mercator."""
    meridian, k0, fe, fn = PROJECTIONS[srid]
    radius, forward, _ = _series()
    e = math.sqrt(GRS80_F * (2 - GRS80_F))
    phi, lam = F.radians(col(lat)), F.radians(col(lon) - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north = sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(forward)), xi)
    east = sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(forward)), eta)
    return fe + k0 * radius * east, fn + k0 * radius * north


def to_degrees(easting: str | Column, northing: str | Column, srid: int) -> tuple[Column, Column]:
    """Latitude and longitude of a transverse Mercator grid."""
    meridian, k0, fe, fn = PROJECTIONS[srid]
    radius, _, back = _series()
    e2 = GRS80_F * (2 - GRS80_F)
    xi, eta = (col(northing) - fn) / (k0 * radius), (col(easting) - fe) / (k0 * radius)
    xi1 = sum((-b * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, b in enumerate(back)), xi)
    eta1 = sum((-b * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, b in enumerate(back)), eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    # conformal to geodetic latitude by series in e2
    phi = (
        chi
        + (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12) * F.sin(2 * chi)
        + (7 * e2**2 / 48 + 29 * e2**3 / 240) * F.sin(4 * chi)
        + (7 * e2**3 / 120) * F.sin(6 * chi)
    )
    return F.degrees(phi), meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
