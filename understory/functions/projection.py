"""Map projection: geographic coordinates and transverse Mercator zones on the WGS 84 ellipsoid.

Krueger's series in the third flattening, to its fourth power, in column arithmetic: forward and inverse agree far
below a millimetre within a zone and its neighbours. Steps that are used again are columns of their own, so that no
expression is computed twice. Codes are EPSG numbers: 4326 (longitude, latitude in degrees), 326zz and 327zz (zone zz
north and south, metres).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The ellipsoid, the zones' scale and false origin.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
GEOGRAPHIC = 4326

_N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
RADIUS = SCALE * AXIS / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)


def _series(*rows: tuple[float, ...]) -> list[float]:
    """Coefficients from rows of factors of n, n^2, n^3, n^4."""
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in rows]


# The series' published factors.
FORWARD = _series((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
INVERSE = _series((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))
LATITUDE = _series((2, -2 / 3, -2, 116 / 45), (0, 7 / 3, -8 / 5, -227 / 45), (0, 0, 56 / 15, -136 / 35), (0, 0, 0, 4279 / 630))


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _meridian(code: str) -> Column:
    return F.radians((F.col(code) % 100) * 6.0 - 183.0)


def _northing(code: str) -> Column:
    return F.when(F.floor(F.col(code) / 100) == 327, SOUTH).otherwise(0.0)


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later expressions share. A generator of one row holds them together: unlike a projection, it is
    never substituted into the filters and expressions above it, which would then grow with each step."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def project(df: DataFrame, lon: str, lat: str, code: str, x: str = "x", y: str = "y") -> DataFrame:
    """Adds metres ``x``, ``y`` in the zone of each row's ``code``; degrees pass where it is 4326."""
    sine = F.sin(F.radians(lat))
    df = _step(df, {"_pr_t": F.sinh(F.atanh(sine) - F.lit(ECCENTRICITY) * F.atanh(F.lit(ECCENTRICITY) * sine)),
                    "_pr_l": F.radians(lon) - _meridian(code)})
    t, around = F.col("_pr_t"), F.col("_pr_l")
    df = _step(df, {"_pr_u": F.atan2(t, F.cos(around)), "_pr_v": F.atanh(F.sin(around) / F.sqrt(1 + t * t))})
    u, v = F.col("_pr_u"), F.col("_pr_v")
    east = v + _sum([F.lit(c) * F.cos(2 * k * u) * F.sinh(2 * k * v) for k, c in enumerate(FORWARD, 1)])
    north = u + _sum([F.lit(c) * F.sin(2 * k * u) * F.cosh(2 * k * v) for k, c in enumerate(FORWARD, 1)])
    plain = F.col(code) == GEOGRAPHIC
    return _step(df, {
        x: F.when(plain, F.col(lon)).otherwise(EAST + F.lit(RADIUS) * east),
        y: F.when(plain, F.col(lat)).otherwise(_northing(code) + F.lit(RADIUS) * north)}).drop("_pr_t", "_pr_l", "_pr_u", "_pr_v")


def unproject(df: DataFrame, x: str, y: str, code: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds degrees ``lon``, ``lat`` of metres in the zone of each row's ``code``; degrees pass where it is 4326."""
    df = _step(df, {"_pr_p": (F.col(y) - _northing(code)) / F.lit(RADIUS), "_pr_q": (F.col(x) - EAST) / F.lit(RADIUS)})
    p, q = F.col("_pr_p"), F.col("_pr_q")
    df = _step(df, {
        "_pr_u": p - _sum([F.lit(c) * F.sin(2 * k * p) * F.cosh(2 * k * q) for k, c in enumerate(INVERSE, 1)]),
        "_pr_v": q - _sum([F.lit(c) * F.cos(2 * k * p) * F.sinh(2 * k * q) for k, c in enumerate(INVERSE, 1)])})
    df = _step(df, {"_pr_c": F.asin(F.sin("_pr_u") / F.cosh("_pr_v"))})
    c = F.col("_pr_c")
    north = c + _sum([F.lit(f) * F.sin(2 * k * c) for k, f in enumerate(LATITUDE, 1)])
    plain = F.col(code) == GEOGRAPHIC
    return _step(df, {
        lon: F.when(plain, F.col(x)).otherwise(F.degrees(_meridian(code) + F.atan2(F.sinh("_pr_v"), F.cos("_pr_u")))),
        lat: F.when(plain, F.col(y)).otherwise(F.degrees(north))}).drop("_pr_p", "_pr_q", "_pr_u", "_pr_v", "_pr_c")


def reproject(df: DataFrame, x: str, y: str, source: str, target: str, out_x: str, out_y: str) -> DataFrame:
    """Adds ``out_x``, ``out_y``: the point ``x``, ``y`` of the system ``source`` in the system ``target``.

    NULL coordinates or codes give NULL. A zone's formulas hold within some tens of degrees of its meridian.
    """
    df = unproject(df, x, y, source, "_pr_lon", "_pr_lat")
    return project(df, "_pr_lon", "_pr_lat", target, out_x, out_y).drop("_pr_lon", "_pr_lat")
