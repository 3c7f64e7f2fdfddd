"""Scalar column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from understory.functions import fixed

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# ---- missing values -------------------------------------------------------------

def is_finite(c: ColumnLike) -> Column:
    """True for a value that is neither NULL, NaN nor infinite."""
    c = as_col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def finite_or_null(c: ColumnLike) -> Column:
    return F.when(is_finite(c), as_col(c))


def finite_or_zero(c: ColumnLike) -> Column:
    return F.coalesce(finite_or_null(c), F.lit(0.0))


def finite_or_limits(c: ColumnLike, low: float = -100.0, high: float = 100.0) -> Column:
    """NaN and NULL become 0, infinities the given limits."""
    c = as_col(c)
    return (F.when(c.isNull() | F.isnan(c), 0.0)
            .when(c == F.lit(math.inf), high)
            .when(c == F.lit(-math.inf), low)
            .otherwise(c))


def drop_codes(c: ColumnLike, codes: Sequence[float] = fixed.NODATA_CODES) -> Column:
    """NULL for any of the no-data codes and for non-finite values."""
    c = as_col(c)
    return F.when(is_finite(c) & ~c.isin([float(v) for v in codes]), c)


# ---- heights --------------------------------------------------------------------

def between(c: ColumnLike, low: float | None = None, high: float | None = None,
            low_open: bool = True, high_open: bool = False) -> Column:
    """Range predicate; either end may be open or absent."""
    c = as_col(c)
    parts = [is_finite(c)]
    if low is not None:
        parts.append(c > low if low_open else c >= low)
    if high is not None:
        parts.append(c < high if high_open else c <= high)
    return all_of(parts)


def clip(c: ColumnLike, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), as_col(c)))


def height_class(c: ColumnLike, edges: Sequence[float] = fixed.HEIGHT_EDGES) -> Column:
    """Number of edges at or below the value: 0 under the first edge, len(edges) at the top."""
    c = as_col(c)
    return reduce(lambda acc, e: acc + F.when(c >= e, 1).otherwise(0), edges, F.lit(0)).cast("int")


def equal_width_bin(c: ColumnLike, low: ColumnLike, high: ColumnLike, bins: int) -> Column:
    """0-based histogram bin over [low, high]; the last bin is closed on both sides."""
    c, low, high = as_col(c), as_col(low), as_col(high)
    position = F.floor((c - low) * F.lit(float(bins)) / F.when(high > low, high - low))
    return F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")


def agreement(ref: ColumnLike, rh: ColumnLike, limit: float = fixed.AGREEMENT_M) -> dict[str, Column]:
    """Accuracy columns of a footprint against its reference height."""
    ref, rh = as_col(ref), as_col(rh)
    diff = F.abs(ref - rh)
    return {
        "height_difference": diff,
        "height_agreement": diff <= limit,
        "relative_error": diff / (ref + F.lit(1e-6)),
        "bias": rh - ref,
    }


# ---- optical and radar ----------------------------------------------------------

def normalized_difference(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = as_col(a), as_col(b)
    total = a + b
    return F.when(total != 0, (a - b) / F.when(total != 0, total))


def from_db(c: ColumnLike) -> Column:
    return F.pow(F.lit(10.0), as_col(c) / 10.0)


def dn_to_db(c: ColumnLike) -> Column:
    c = as_col(c)
    return F.when(c != 0, F.lit(10.0) * F.log10(c * c) - 83.0)


# Offsets and scales of each kind of band.
NORMALIZERS = {
    "sentinel1": lambda c: (c + 25.0) / 25.0,
    "sentinel2": lambda c: c / 10000.0,
    "srtm_elevation": lambda c: c / 2000.0,
    "srtm_slope": lambda c: c / 50.0,
    "srtm_aspect": lambda c: (c - 180.0) / 180.0,
    "alos2": dn_to_db,
    "canopy_height": lambda c: c / 50.0,
    "ndvi": lambda c: c,
}


def normalize(kind: str, c: ColumnLike) -> Column:
    if kind not in NORMALIZERS:
        raise ValueError(f"unknown band type: {kind}")
    return NORMALIZERS[kind](as_col(c))


def normalize_by_name(name: str, c: ColumnLike | None = None) -> Column:
    """Normalisation by the first rule that the band's name, with or without a month, fits; other bands pass through."""
    c = as_col(name if c is None else c)
    fitting = [rule for rule in fixed.BAND_RULES if re.fullmatch(f"(?:{rule[0]})(?:_M.*)?", name)]
    for _, offset, divisor, low, high in fitting[:1]:
        c = (c + offset) / divisor
        c = c if low is None else clip(c, low, high)
    return finite_or_zero(c)


def qa60_clear(qa: ColumnLike) -> Column:
    """Neither the opaque-cloud (10) nor the cirrus (11) bit is set."""
    return as_col(qa).bitwiseAND(F.lit((1 << 10) | (1 << 11))) == 0


def stretch(c: ColumnLike, low: ColumnLike, high: ColumnLike, contrast: float = 1.0,
            gamma: float = 1.0) -> Column:
    """Display stretch to 0..255, truncated as an unsigned byte would be."""
    c, low, high = as_col(c), as_col(low), as_col(high)
    x = F.when(high != low, (c - low) / F.when(high != low, high - low)).otherwise(0.0)
    x = clip(x, 0.0, 1.0)
    if contrast != 1.0:
        x = clip(F.lit(0.5) + F.lit(contrast) * (x - 0.5), 0.0, 1.0)
    if gamma != 1.0 and gamma > 0:
        x = F.when(x > 0, clip(F.pow(x, F.lit(1.0 / gamma)), 0.0, 1.0)).otherwise(x)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.floor(x * 255.0)).cast("int")


# ---- geography ------------------------------------------------------------------

def utm_epsg(lon: ColumnLike, lat: ColumnLike) -> Column:
    lon, lat = as_col(lon), as_col(lat)
    zone = ((lon + 180.0) / 6.0).cast("int") + 1
    north = F.format_string("EPSG:326%02d", zone)
    south = F.format_string("EPSG:327%02d", zone)
    return (F.when((lat >= -80) & (lat <= 84), F.when(lat >= 0, north).otherwise(south))
            .otherwise("EPSG:3857"))


def metres_per_degree_lon(lat: ColumnLike) -> Column:
    return F.lit(fixed.METRES_PER_DEGREE) * F.cos(F.radians(as_col(lat)))


def cell_row(lat: ColumnLike, top: float, res: float) -> Column:
    return F.floor((F.lit(float(top)) - as_col(lat)) / res).cast("int")


def cell_col(lon: ColumnLike, left: float, res: float) -> Column:
    return F.floor((as_col(lon) - F.lit(float(left))) / res).cast("int")


# ---- file names -----------------------------------------------------------------

def file_name(path: ColumnLike) -> Column:
    return F.element_at(F.split(as_col(path), "/"), -1)


def patch_id_of(path: ColumnLike) -> Column:
    """Four digits after ``patch`` in the file name, else the name without its extension."""
    name = file_name(path)
    digits = F.regexp_extract(name, r"patch(\d{4})", 1)
    return F.when(digits != "", digits).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def region_of(path: ColumnLike) -> Column:
    """First region code contained in the name, else ``unknown``."""
    path = as_col(path)
    chain = F
    for code, _, _ in fixed.REGIONS:
        chain = chain.when(path.contains(fixed.AREA_PREFIX + code), code)
    return chain.otherwise("unknown")


def region_name_of(code: ColumnLike) -> Column:
    code = as_col(code)
    chain = F
    for key, name, _ in fixed.REGIONS:
        chain = chain.when(code == key, name)
    return chain.otherwise("Unknown")


def area_code_of(path: ColumnLike) -> Column:
    found = F.regexp_extract(file_name(path), r"(dchm_[0-9A-Za-z]+)", 1)
    return F.when(found != "", found)


# ---- deterministic sampling -----------------------------------------------------

HASH_RANGE = 1_000_003
# Odd multipliers of the arithmetic hash.
HASH_FACTORS = [7919, 104729, 1299709, 31, 17, 15485863]


def sample_hash(keys: Sequence[ColumnLike], seed: int = 0) -> Column:
    """Arithmetic hash of integer keys in ``[0, HASH_RANGE)``.

    Plain integer arithmetic, so another SQL engine computes the same value.
    """
    total = F.lit(seed * 97 % HASH_RANGE).cast("long")
    for key, factor in zip(keys, HASH_FACTORS):
        total = total + F.pmod(as_col(key).cast("long"), F.lit(HASH_RANGE)) * F.lit(factor)
    return F.pmod(F.pmod(total, F.lit(HASH_RANGE)) * F.lit(48271), F.lit(HASH_RANGE))
