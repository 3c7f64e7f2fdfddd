"""Square tiles of pixel grids with a margin, as numpy arrays inside tasks.

A cell travels once, near the edge of a tile also to the tiles beside it, whatever the size of a moving window or the
number of shifts; a group holds one tile and its margin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CELL = ("row", "col")
TILE = 256

#: What a computation gets: arrays of the tile and its margin by band, NaN where there is no value, and the places of the tile's
#: own cells in them. It gives the outputs of these cells; rows of which all outputs are NaN may be left out.
Compute = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray], dict[str, np.ndarray]]


def tile_of(c: Column, tile: int) -> Column:
    return F.floor(c / tile).cast("int")


def tiles_near(position: str, margin: int, tile: int) -> Column:
    """Tiles that hold this position or have it in their margin."""
    return F.sequence(tile_of(F.col(position) - margin, tile), tile_of(F.col(position) + margin, tile))


def spread(df: DataFrame, margin: int, tile: int) -> DataFrame:
    return df.withColumn("_tr", F.explode(tiles_near("row", margin, tile))).withColumn("_tc", F.explode(tiles_near("col", margin, tile)))


def field(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(np.float64)


def by_tiles(df: DataFrame, keys: Sequence[str], bands: Sequence[str], margin: int, compute: Compute, outputs: Sequence[str],
             tile: int | None = None, empty: bool = True) -> DataFrame:
    """``keys, row, col, outputs`` for every cell; without ``empty`` not for cells of which all outputs are missing.

    NULL and NaN are the same: no value. Of repeated cells one counts as a neighbour, and each gets a row. Tiles without cells
    of their own give nothing.
    """
    tile = tile or TILE
    cells = spread(df.select(*keys, *CELL, *[F.col(b).cast("double").alias(b) for b in bands]), margin, tile)
    kinds = dict(cells.dtypes)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in CELL)
        top, left = key[-2].as_py() * tile, key[-1].as_py() * tile
        own = (row >= top) & (row < top + tile) & (col >= left) & (col < left + tile)
        r, c = row - row.min() + margin, col - col.min() + margin
        shape = (int(r.max()) + margin + 1, int(c.max()) + margin + 1)
        grids = {}
        for b in bands if own.any() else []:
            grids[b] = np.full(shape, np.nan)
            grids[b][r, c] = field(t, b)
        found = compute(grids, r[own], c[own]) if own.any() else {n: np.zeros(0) for n in outputs}
        mine = t.filter(pa.array(own)).select([*keys, *CELL])
        gone = np.logical_and.reduce([np.isnan(found[n]) for n in outputs]) if not empty else np.zeros(len(mine), bool)
        for n in outputs:
            mine = mine.append_column(n, pa.array(found[n], mask=np.isnan(found[n])))
        return mine.filter(pa.array(~gone))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *CELL)) + "".join(f", `{n}` double" for n in outputs)
    return cells.groupBy(*keys, "_tr", "_tc").applyInArrow(run, schema)


def box_sums(values: np.ndarray, radius: int) -> np.ndarray:
    """Sums over the square around each place, from a summed-area table: four reads a place, whatever the radius."""
    table = np.zeros((values.shape[0] + 2 * radius + 1, values.shape[1] + 2 * radius + 1))
    table[radius + 1:radius + 1 + values.shape[0], radius + 1:radius + 1 + values.shape[1]] = values
    table = table.cumsum(axis=0).cumsum(axis=1)
    side = 2 * radius + 1
    return table[side:, side:] - table[:-side, side:] - table[side:, :-side] + table[:-side, :-side]


def window_statistics(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population variance of the values around each place; values are taken from their mean, so squares stay small."""
    held = ~np.isnan(values)
    centre = values[held].mean() if held.any() else 0.0
    part = np.where(held, values - centre, 0.0)
    n = np.rint(box_sums(held.astype(float), radius))
    mean = box_sums(part, radius) / np.maximum(n, 1)
    var = np.maximum(box_sums(part * part, radius) / np.maximum(n, 1) - mean * mean, 0.0)
    return n, mean + centre, var
