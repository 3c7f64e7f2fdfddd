"""Grids in different map projections brought onto one: points sampled across systems, and inverse warps.

A grid is a row ``code, left, top, res, rows, cols``: its EPSG code, upper left corner, cell size and shape.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.projection import reproject
from understory.operators.grids import dealt_out

#: Cells on a side of a tile.
TILE = 64
#: Points on each side of a box that is carried into another system, its corners among them.
EDGE = 22


def cell_centres(cells: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Centres of cells (``row``, ``col``) of the grid whose columns they carry."""
    return cells.withColumns({x: F.col("left") + (F.col("col") + 0.5) * F.col("res"), y: F.col("top") - (F.col("row") + 0.5) * F.col("res")})


def cells_at(points: DataFrame, grids: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", code: str = "code") -> DataFrame:
    """Points of any system with the ``row``, ``col`` they fall into on their grid (``keys``); points off the grid go."""
    named = grids.select(*keys, F.col("code").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("left", "top", "res", "rows", "cols")])
    moved = reproject(points.join(named, list(keys)), x, y, code, "_to", "_x", "_y")
    placed = moved.withColumns({"row": F.floor((F.col("_top") - F.col("_y")) / F.col("_res")).cast("int"),
                                "col": F.floor((F.col("_x") - F.col("_left")) / F.col("_res")).cast("int")})
    inside = placed.where((F.col("row") >= 0) & (F.col("row") < F.col("_rows")) & (F.col("col") >= 0) & (F.col("col") < F.col("_cols")))
    return inside.drop("_to", "_left", "_top", "_res", "_rows", "_cols", "_x", "_y")


def carried_boxes(grids: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Boxes ``x0, y0, x1, y1`` in the system ``target`` around grids of another: edges are followed point by point."""
    share = F.col("_i") / F.lit(EDGE - 1.0)
    width, height = F.col("cols") * F.col("res"), F.col("rows") * F.col("res")
    sides = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in (
        (F.col("left") + width * share, F.col("top")), (F.col("left") + width * share, F.col("top") - height),
        (F.col("left"), F.col("top") - height * share), (F.col("left") + width, F.col("top") - height * share))])
    points = grids.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(EDGE - 1)))).withColumn("_s", F.explode(sides))
    moved = reproject(points.select(*keys, "code", target, F.col("_s.x").alias("_ex"), F.col("_s.y").alias("_ey")),
                      "_ex", "_ey", "code", target, "_x", "_y")
    return moved.groupBy(*keys, target).agg(F.min("_x").alias("x0"), F.min("_y").alias("y0"), F.max("_x").alias("x1"), F.max("_y").alias("y1"))


def common_grids(grids: DataFrame, others: DataFrame, keys: Sequence[str], on: Sequence[str], res: float, least: int = 10) -> DataFrame:
    """Where grids overlap another one of their group (``on``), the overlap as a grid of about ``res`` in the other's system.

    ``keys`` tell a grid of the first side and hold ``on``. Rows are ``keys, code, west, north, dx, dy, height, width``: the
    box is the overlap exactly, so cells are stretched to fill it. Grids without an overlap, or with fewer than
    ``least`` cells on a side of it, have none.
    """
    other = others.select(*on, F.col("code").alias("_to"), F.col("left").alias("_l"), F.col("top").alias("_t"),
                          (F.col("left") + F.col("cols") * F.col("res")).alias("_r"), (F.col("top") - F.col("rows") * F.col("res")).alias("_b"))
    boxes = carried_boxes(grids.join(other, list(on)), [*keys, "_l", "_t", "_r", "_b"], "_to")
    shared = boxes.select(*keys, F.col("_to").alias("code"), F.greatest("x0", "_l").alias("west"), F.least("x1", "_r").alias("_east"),
                          F.greatest("y0", "_b").alias("_south"), F.least("y1", "_t").alias("north"))
    east, north = F.col("_east") - F.col("west"), F.col("north") - F.col("_south")
    sized = shared.where((east > 0) & (north > 0)).withColumns(
        {"width": F.floor(east / res).cast("int"), "height": F.floor(north / res).cast("int")})
    return sized.where((F.col("width") >= least) & (F.col("height") >= least)).select(
        *keys, "code", "west", "north", (east / F.col("width")).alias("dx"), (north / F.col("height")).alias("dy"), "height", "width")


def lattice(grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every cell ``t_row, t_col`` of common grids with its centre ``x, y``, rows of cells first, dealt out before their cells."""
    lines = grids.withColumn("t_row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    cells = dealt_out(lines, *keys, "t_row").withColumn("t_col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return cells.select(*keys, "code", "t_row", "t_col", (F.col("west") + (F.col("t_col") + 0.5) * F.col("dx")).alias("x"),
                        (F.col("north") - (F.col("t_row") + 0.5) * F.col("dy")).alias("y"))


def _tile(c: Column) -> Column:
    return F.floor(c / TILE).cast("int")


def packed(cells: DataFrame, keys: Sequence[str], value: str, margin: int = 1) -> DataFrame:
    """Square tiles ``_tr, _tc`` of each grid as rows, with ``margin`` cells of the next tiles below and on the right.

    ``_cells`` holds (``TILE`` + margin) squared values, NaN where there is no cell. A cell travels once, near the upper and
    left edges of a tile up to four times; a group holds one tile.
    """
    side = TILE + margin

    def near(c: str) -> Column:
        return F.array_distinct(F.array(_tile(F.col(c)), _tile(F.col(c) - margin)))

    held = (cells.where(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).cast("double").alias("_v"))
            .withColumn("_tr", F.explode(near("row"))).withColumn("_tc", F.explode(near("col"))))
    kinds = dict(held.dtypes)

    def run(key: tuple, tile: pa.Table) -> pa.Table:
        grid = np.full((side, side), np.nan)
        row, col, v = (tile.column(c).to_numpy() for c in ("row", "col", "_v"))
        grid[row - key[-2].as_py() * TILE, col - key[-1].as_py() * TILE] = v
        own = {n: pa.array([k.as_py()], k.type) for n, k in zip((*keys, "_tr", "_tc"), key)}
        return pa.table({**own, "_cells": pa.ListArray.from_arrays(pa.array([0, side * side], pa.int32()), pa.array(grid.ravel()))})

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", _tr int, _tc int, _cells array<double>"
    return held.groupBy(*keys, "_tr", "_tc").applyInArrow(run, schema)


def gather(cells: DataFrame, targets: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str) -> DataFrame:
    """Bilinear values at fractional positions (``fy``, ``fx`` in cell-centre units); missing cells give their weight to the others.

    Targets meet the tile of the cell above and left of them, one row whatever their number, so a tile that many
    targets ask for may be split among tasks like any skewed join. Targets without any cell have no row.
    """
    y, x = F.floor("fy"), F.floor("fx")
    asked = targets.select(*keys, *ids, "fy", "fx").withColumns({"_tr": _tile(y), "_tc": _tile(x)})
    joined = asked.join(packed(cells, keys, value), [*keys, "_tr", "_tc"])
    at = (y - F.col("_tr") * TILE) * (TILE + 1) + x - F.col("_tc") * TILE
    corners = {f"_v{dy}{dx}": F.nanvl(F.get("_cells", (at + dy * (TILE + 1) + dx).cast("int")), F.lit(None).cast("double"))
               for dy in (0, 1) for dx in (0, 1)}
    read = joined.select(*keys, *ids, (F.col("fy") - y).alias("_wy"), (F.col("fx") - x).alias("_wx"), *[c.alias(n) for n, c in corners.items()])
    weights = {n: F.when(F.col(n).isNull(), 0.0).otherwise(
        (F.col("_wy") if n[2] == "1" else 1 - F.col("_wy")) * (F.col("_wx") if n[3] == "1" else 1 - F.col("_wx"))) for n in corners}
    total = sum((F.coalesce(n, F.lit(0.0)) * w for n, w in weights.items()), F.lit(0.0))
    weight = sum(weights.values(), F.lit(0.0))
    return read.withColumns({"_total": total, "_weight": weight}).where(F.col("_weight") > 0).select(
        *keys, *ids, (F.col("_total") / F.col("_weight")).alias(value))


def warp(targets: DataFrame, cells: DataFrame, grids: DataFrame, keys: Sequence[str], ids: Sequence[str], value: str) -> DataFrame:
    """Target centres (``x``, ``y`` in their system ``code``) with the bilinear value of their source grid (``keys``).

    Each target is carried back into the source's system; only targets inside the source grid get a row.
    """
    named = grids.select(*keys, F.col("code").alias("_to"), *[F.col(c).alias(f"_{c}") for c in ("left", "top", "res", "rows", "cols")])
    moved = reproject(targets.join(named, list(keys)), "x", "y", "code", "_to", "_x", "_y")
    placed = moved.withColumns({"fy": (F.col("_top") - F.col("_y")) / F.col("_res") - 0.5, "fx": (F.col("_x") - F.col("_left")) / F.col("_res") - 0.5})
    inside = (F.col("fy") >= -0.5) & (F.col("fy") < F.col("_rows") - 0.5) & (F.col("fx") >= -0.5) & (F.col("fx") < F.col("_cols") - 0.5)
    return gather(cells, placed.where(inside), keys, ids, value)


def warped_pairs(cells: DataFrame, grids: DataFrame, ref_cells: DataFrame, ref_grids: DataFrame, grid: str, region: str,
                 value: str, ref_value: str, res: float = 100.0, least: int = 10) -> DataFrame:
    """``region, grid, t_row, t_col`` with both values on the common grid, where both have one.

    Grids of ``cells`` (``grid``) and of ``ref_cells`` (one for each ``region``) may lie in different projections; the common
    grid lies in the reference's.
    """
    ids = [region, grid, "t_row", "t_col"]
    targets = lattice(common_grids(grids, ref_grids, [region, grid], [region], res, least), [region, grid])
    mine = warp(targets, cells, grids, [region, grid], ["t_row", "t_col"], value)
    other = warp(targets, ref_cells, ref_grids, [region], [grid, "t_row", "t_col"], ref_value)
    return mine.join(other, ids).select(*ids, value, ref_value)
