"""Moving windows on pixel grids, over tiles with a margin: a cell travels once, not once for each neighbour."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import ColumnLike, as_col
from understory.operators.alignment import stack_bands
from understory.operators.tiles import CELL, by_tiles, window_statistics


def offsets(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dy, dx) for dy in span for dx in span]


def focal_mean(df: DataFrame, keys: Sequence[str], bands: Sequence[str], radius: int = 3) -> DataFrame:
    """Square mean around every cell, from summed-area tables of tiles."""
    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for b, grid in grids.items():
            n, mean, _ = window_statistics(grid, radius)
            out[f"{b}_filtered"] = np.where(n > 0, mean, np.nan)[r, c]
        return out

    return by_tiles(df, keys, bands, radius, compute, [f"{b}_filtered" for b in bands])


def gamma_map(df: DataFrame, keys: Sequence[str], value: str, kernel: int, enl: float) -> DataFrame:
    """Speckle filter: window mean and own value weighted by the window's variation, from summed-area tables of tiles.

    Cells without a value get none and have no row.
    """
    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        own = grids[value][r, c]
        _, mean, var = (x[r, c] for x in window_statistics(grids[value], kernel // 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            inverse = mean * mean / var
            weight = np.where(var > 0, np.where(np.isinf(inverse), 1.0, inverse / (inverse + enl)), 1.0)
        return {value: mean * weight + own * (1 - weight)}

    return by_tiles(df, keys, [value], kernel // 2, compute, [value], empty=False)


def _terrain(z: np.ndarray, r: np.ndarray, c: np.ndarray, cell_size: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and aspect in degrees from the eight neighbours, NaN where one of them is missing."""
    near = {(dy, dx): z[r + dy, c + dx] for dy, dx in offsets(1)}
    east = ((near[-1, 1] + 2 * near[0, 1] + near[1, 1]) - (near[-1, -1] + 2 * near[0, -1] + near[1, -1])) / (8 * cell_size)
    south = ((near[1, -1] + 2 * near[1, 0] + near[1, 1]) - (near[-1, -1] + 2 * near[-1, 0] + near[-1, 1])) / (8 * cell_size)
    whole = ~np.isnan(sum(near.values()))
    slope = np.degrees(np.arctan(np.sqrt(east * east + south * south)))
    # downslope direction clockwise from north
    aspect = np.where(slope > 0, np.mod(np.degrees(np.arctan2(-east, south)) + 360.0, 360.0), 0.0)
    return np.where(whole, slope, np.nan), np.where(whole, aspect, np.nan)


def slope_aspect(df: DataFrame, keys: Sequence[str], elevation: str, cell_size: float) -> DataFrame:
    """Slope and aspect in degrees from the eight neighbours; only cells that have all of them."""
    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        slope, aspect = _terrain(grids[elevation], r, c, cell_size)
        return {"_z": np.where(np.isnan(slope), np.nan, grids[elevation][r, c]), "slope": slope, "aspect": aspect}

    found = by_tiles(df, keys, [elevation], 1, compute, ["_z", "slope", "aspect"], empty=False)
    return found.withColumnRenamed("_z", elevation)


#: Elevation sources, and those of which only the elevation is taken.
ELEVATION_SOURCES, FLAT_SOURCES = ("GMTED", "SRTM", "AW3D30", "GLO30"), ("AW3D30",)


def elevation_stack(sources: Mapping[str, DataFrame | None], keys: Sequence[str], cell_size: float, elevation: str = "elevation") -> DataFrame:
    """``keys, row, col`` with elevation, slope and aspect of every source (``{source}_elevation`` and so on) side by side.

    Each source has its own cells; a cell has a row if any source does. Slope and aspect need the source's eight
    neighbours, and sources in ``FLAT_SOURCES`` have none. Sources that are absent (None) have no columns.
    """
    unknown = set(sources) - set(ELEVATION_SOURCES)
    if unknown:
        raise ValueError(f"unknown elevation sources: {sorted(unknown)}")
    held = [n for n in ELEVATION_SOURCES if sources.get(n) is not None]
    if not held:
        raise ValueError("no elevation source")
    stacked = stack_bands([(sources[n].where(F.col(elevation).isNotNull()).select(*keys, *CELL, F.col(elevation).cast("double").alias(n)), [n])
                           for n in held], [*keys, *CELL])
    outputs = [f"{n}_{part}" for n in held for part in (("elevation",) if n in FLAT_SOURCES else ("elevation", "slope", "aspect"))]

    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for n in held:
            out[f"{n}_elevation"] = grids[n][r, c]
            if n not in FLAT_SOURCES:
                out[f"{n}_slope"], out[f"{n}_aspect"] = _terrain(grids[n], r, c, cell_size)
        return out

    return by_tiles(stacked, keys, held, 1, compute, outputs)


def terrain_factor(angle: ColumnLike, slope: ColumnLike, aspect: ColumnLike, ascending: Column) -> Column:
    """Radar terrain correction factor from degrees."""
    ti, s, a = (F.radians(as_col(c)) for c in (angle, slope, aspect))
    phi = F.when(ascending, F.lit(0.0)).otherwise(F.pi())
    cos_local = F.cos(ti) * F.cos(s) + F.sin(ti) * F.sin(s) * F.cos(a - phi)
    return F.sin(F.acos(cos_local)) / F.sin(ti)


GLCM_STEPS = [(0, 1), (1, 0), (1, 1), (1, -1)]
#: Cells on a side of a texture tile: all bands of its cells are in memory at once.
TEXTURE_TILE = 64
GLCM_MEASURES = ["asm", "contrast", "corr", "var", "idm", "savg", "ent", "dvar"]


def _texture(levels: np.ndarray, r: np.ndarray, c: np.ndarray, half: int) -> np.ndarray:
    """The measures (rows in the order of ``GLCM_MEASURES``) of the windows around the places; levels are -1 where there is none.

    A window's pairs of one direction lie in fixed slots, the same for all windows: entering and leaving pairs need no
    search. How often a pair comes is the number of slots that hold its like.
    """
    total, ways = np.zeros((len(GLCM_MEASURES), len(r))), np.zeros(len(r))
    for dy, dx in GLCM_STEPS:
        span_y, span_x = range(max(-half, -half - dy), min(half, half - dy) + 1), range(max(-half, -half - dx), min(half, half - dx) + 1)
        slots = [(levels[r + y, c + x], levels[r + y + dy, c + x + dx]) for y in span_y for x in span_x]
        i, j = (np.array(side, np.int64) for side in zip(*slots))
        held = (i >= 0) & (j >= 0)
        code = np.where(held, np.minimum(i, j) * 256 + np.maximum(i, j), -1)
        like = np.zeros(code.shape)
        for one in code:
            like += code == one
        n = 2.0 * held.sum(axis=0)
        some = n > 0
        size = np.maximum(n, 1)
        same = i == j

        def mean(values: np.ndarray) -> np.ndarray:
            return np.where(held, values, 0.0).sum(axis=0) / size

        # Both orders of a pair count: two entries of the matrix, or one entry twice on its diagonal.
        squares = mean(np.where(same, 4.0, 2.0) * like)
        logs = mean(2.0 * np.log(np.where(same, 2.0, 1.0) * np.maximum(like, 1)))
        level = mean(i + j)
        var = mean(i * i + j * j) - level * level
        cov = mean(2.0 * i * j) - level * level
        far = 2.0 * (i - j) ** 2
        contrast = mean(far)
        corr = np.where(var > 1e-12, cov / np.where(var > 1e-12, var, 1.0), 0.0)
        part = np.array([squares / size, contrast, corr, var, mean(2.0 / (1.0 + (i - j) ** 2)), 2.0 * level, np.log(size) - logs,
                         contrast - mean(2.0 * np.abs(i - j)) ** 2])
        total += np.where(some, part, 0.0)
        ways += some
    own = (levels[r, c] >= 0) & (ways > 0)
    return np.where(own, total / np.maximum(ways, 1), np.nan)


def _levels(grid: np.ndarray) -> np.ndarray:
    """Values in [-1, 1] as 0..255, -1 where there is none."""
    return np.where(np.isnan(grid), -1, np.trunc((np.nan_to_num(grid) + 1.0) * 127.5)).astype(np.int64)


def glcm(df: DataFrame, keys: Sequence[str], bands: Sequence[str], window: int = 3) -> DataFrame:
    """(keys, row, col, band, measures): co-occurrence texture in a square window per band.

    Values in [-1, 1] become 0..255; matrices are symmetric, and measures are averaged over the directions that have
    pairs. A band without a value at a cell, or without any pair around it, has no row.
    """
    names = [f"{m}_{k}" for k in range(len(bands)) for m in GLCM_MEASURES]

    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        return dict(zip(names, (row for b in bands for row in _texture(_levels(grids[b]), r, c, window // 2))))

    wide = by_tiles(df, keys, bands, window // 2, compute, names, TEXTURE_TILE)
    rows = F.array(*[F.struct(F.lit(b).alias("band"), *[F.col(f"{m}_{k}").alias(m) for m in GLCM_MEASURES]) for k, b in enumerate(bands)])
    return wide.select(*keys, *CELL, F.inline(rows)).where(F.col(GLCM_MEASURES[0]).isNotNull())


def band_textures(df: DataFrame, keys: Sequence[str], bands: Sequence[str], window: int = 3) -> DataFrame:
    """Mean and median over the bands of each measure of :func:`glcm`, one row per cell; bands never become rows."""
    names = [f"{stat}_{m}" for m in GLCM_MEASURES for stat in ("mean", "median")]

    def compute(grids: dict[str, np.ndarray], r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        found = np.array([_texture(_levels(grids[b]), r, c, window // 2) for b in bands])
        some = ~np.isnan(found).all(axis=0)
        filled = np.where(some, found, 0.0)
        means, medians = (np.where(some, f(filled, axis=0), np.nan) for f in (np.nanmean, np.nanmedian))
        return {f"{stat}_{m}": values[k] for k, m in enumerate(GLCM_MEASURES) for stat, values in (("mean", means), ("median", medians))}

    return by_tiles(df, keys, bands, window // 2, compute, names, TEXTURE_TILE, empty=False)
