"""Resampling between grids as keyed aggregations and equi joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from understory.operators.tiles import CELL, TILE
from understory.session import parts, written

# Cells that a task holds while it averages them into blocks.
TASK_CELLS = 600_000


def average_to_grid(fine: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean of the fine values in each target cell; partial sums are combined before the shuffle."""
    return fine.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias(value))


def coarse_cell(c: str, factor: int | Column) -> Column:
    return F.floor(F.col(c) / factor).cast("int")


def decimate(cells: DataFrame, value: str, keys: Sequence[str], limit: int = 10_000_000,
             target: int = 5_000_000) -> DataFrame:
    """Grids above ``limit`` cells are averaged into blocks that leave about ``target`` cells.

    The block size of each grid comes from its own cell count; that count is one row per grid. The counts are written, for
    their sum says in how many parts the blocks are averaged.
    """
    sizes = written(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "grid-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    factor = F.when(F.col("_n") > limit, F.ceil(F.sqrt(F.col("_n") / target))).otherwise(1).cast("int")
    sized = cells.join(sizes.select(*keys, factor.alias("_f")), list(keys))
    blocks = sized.select(*keys, coarse_cell("row", F.col("_f")).alias("row"), coarse_cell("col", F.col("_f")).alias("col"), value, "_f")
    block = [*keys, "row", "col"]
    return blocks.repartition(parts(cells.sparkSession, total, TASK_CELLS), *block).groupBy(*block).agg(
        F.avg(value).alias(value), F.first("_f").alias("factor"))


def align(pred: DataFrame, ref: DataFrame, keys: Sequence[str], pred_value: str, ref_value: str,
          factor: int, mask: DataFrame | None = None) -> DataFrame:
    """Both grids averaged onto cells of ``factor`` x ``factor``; only common cells are kept.

    With a mask (keys, row, col, mask) values outside mask > 0 become NULL.
    """
    def coarse(df: DataFrame, value: str) -> DataFrame:
        cells = df.select(*keys, coarse_cell("row", factor).alias("row"),
                          coarse_cell("col", factor).alias("col"), value)
        return average_to_grid(cells, [*keys, "row", "col"], value)

    cell = [*keys, "row", "col"]
    out = coarse(pred, pred_value).join(coarse(ref, ref_value), cell)
    if mask is not None:
        m = mask.groupBy(*keys, coarse_cell("row", factor).alias("row"), coarse_cell("col", factor).alias("col")).agg(
            F.avg("mask").alias("_m"))
        out = out.join(m, cell, "left")
        keep = F.col("_m") > 0
        out = out.withColumns({v: F.when(keep, F.col(v)) for v in (pred_value, ref_value)}).drop("_m")
    return out


def bilinear(cells: DataFrame, targets: DataFrame, value: str, keys: Sequence[str],
             id_cols: Sequence[str], few: bool = False) -> DataFrame:
    """Interpolated value at fractional positions (fy, fx) given in cell-centre units.

    Each square between four cell centres is one row with its corners' values, so a target meets one row by an equi join;
    missing cells give their weight to the others, repeated cells count each. ``few`` says that the grid has few cells
    whatever the number of targets, so its squares go to every task.
    """
    corners = [(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    places = F.array(*[F.struct((F.col("row") - dy).cast("int").alias("_y"), (F.col("col") - dx).cast("int").alias("_x"),
                                F.lit(i).alias("_i")) for i, (dy, dx) in enumerate(corners)])
    held = cells.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.explode(places).alias("_c"))
    squares = held.select(*keys, "_v", "_c.*").groupBy(*keys, "_y", "_x").agg(*[
        c for i in range(len(corners)) for c in (
            F.sum(F.when(F.col("_i") == i, F.col("_v"))).alias(f"_s{i}"), F.count_if(F.col("_i") == i).alias(f"_n{i}"))])
    y0, x0 = F.floor("fy"), F.floor("fx")
    asked = targets.select(*keys, *id_cols, y0.cast("int").alias("_y"), x0.cast("int").alias("_x"),
                           (F.col("fy") - y0).alias("_wy"), (F.col("fx") - x0).alias("_wx"))
    met = asked.join(F.broadcast(squares) if few else squares, [*keys, "_y", "_x"])
    share = [(F.col("_wy") if dy else 1 - F.col("_wy")) * (F.col("_wx") if dx else 1 - F.col("_wx")) for dy, dx in corners]
    parts = [(F.when((w > 0) & (F.col(f"_n{i}") > 0), F.col(f"_s{i}") * w).otherwise(0.0),
              F.when(w > 0, F.col(f"_n{i}") * w).otherwise(0.0)) for i, w in enumerate(share)]
    found = met.select(*keys, *id_cols, sum((p for p, _ in parts[1:]), parts[0][0]).alias("_p"),
                       sum((w for _, w in parts[1:]), parts[0][1]).alias("_w")).where(F.col("_w") > 0)
    return found.groupBy(*keys, *id_cols).agg((F.sum("_p") / F.sum("_w")).alias(value))


def _position(size: int, target: int, index: int) -> float:
    """Source position of a target index when end cells are matched to end cells."""
    return index * ((size - 1) / (target - 1)) if target > 1 else 0.0


def _linear_reads(size: int, target: int) -> list[list[tuple[int, float]]]:
    """For each source index the target indices that read it, with their weights."""
    reads: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    for t in range(target):
        at = _position(size, target, t)
        low = math.floor(at)
        for i, w in ((low, 1 - (at - low)), (low + 1, at - low)):
            if w > 0 and i < size:
                reads[i].append((t, w))
    return reads


def _corners(at: list[float], first: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places, counted from ``first``, before and after each position and their weights; places outside hold nothing."""
    low = np.floor(at)
    after = np.asarray(at) - low
    return [(np.clip(low.astype(int) + d - first, 0, size - 1), w) for d, w in ((0, 1 - after), (1, after))]


def _nearest_reads(size: int, target: int) -> list[list[int]]:
    """For each source index the target indices that read it."""
    reads: list[list[int]] = [[] for _ in range(size)]
    for t in range(target):
        reads[math.floor(_position(size, target, t) + 0.5)].append(t)
    return reads


def resize_linear(cells: DataFrame, values: str | Sequence[str], keys: Sequence[str], size: int, target: int) -> DataFrame:
    """Linear resize of square grids. Cells are handed to the tiles of the target grid that read them, so neither a target
    grid nor a pair of target and cell is made outside a task; a tile without a value has no row, nor has a target cell
    for which one of the values has no neighbour. Repeated cells count each.
    """
    values = [values] if isinstance(values, str) else list(values)
    reads = _linear_reads(size, target)
    side = min(TILE, target)
    tiles = F.array(*[F.array(*[F.lit(k) for k in sorted({t // side for t, _ in one})]).cast("array<int>") for one in reads])
    inside = cells.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
    spread = (inside.select(*keys, "row", "col", *[F.col(v).cast("double").alias(v) for v in values])
              .withColumn("_tr", F.explode(F.get(tiles, F.col("row")))).withColumn("_tc", F.explode(F.get(tiles, F.col("col")))))
    kinds = dict(spread.dtypes)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in CELL)
        return _tile_rows(key, row, col, t, values, keys, size, target, side)

    return spread.groupBy(*keys, "_tr", "_tc").applyInArrow(run, _tile_schema(keys, values, kinds))


def _tile_schema(keys: Sequence[str], values: Sequence[str], kinds: dict[str, str]) -> str:
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "t_row int", "t_col int", *(f"`{v}` double" for v in values)])


def _tile_rows(key: tuple, row: np.ndarray, col: np.ndarray, t: pa.Table, values: Sequence[str], keys: Sequence[str], size: int,
               target: int, side: int) -> pa.Table:
    """The resized cells of the tile at the end of ``key`` from the cells that it reads."""
    top, left = key[-2].as_py() * side, key[-1].as_py() * side
    ys, xs = ([_position(size, target, i) for i in range(low, min(low + side, target))] for low in (top, left))
    # the source rows and columns that the tile reads, with a margin of one
    r0, c0 = int(row.min()) - 1, int(col.min()) - 1
    shape = (int(row.max()) - r0 + 2, int(col.max()) - c0 + 2)
    corners = [(wy[:, None] * wx[None, :], np.ix_(y, x)) for y, wy in _corners(ys, r0, shape[0]) for x, wx in _corners(xs, c0, shape[1])]
    held, found = np.ones((len(ys), len(xs)), bool), {}
    for v in values:
        x = t.column(v).to_numpy(zero_copy_only=False).astype(np.float64)
        some = np.asarray(t.column(v).is_valid())
        total, n = np.zeros(shape), np.zeros(shape)
        np.add.at(total, (row[some] - r0, col[some] - c0), x[some])
        np.add.at(n, (row[some] - r0, col[some] - c0), 1.0)
        weight = sum(w * n[place] for w, place in corners)
        held &= weight > 0
        found[v] = sum(np.where(w > 0, total[place] * w, 0.0) for w, place in corners) / np.where(weight > 0, weight, 1.0)
    r, c = np.nonzero(held)
    one = {k: pa.repeat(key[i], len(r)) for i, k in enumerate(keys)}
    return pa.table({**one, "t_row": pa.array(r + top, pa.int32()), "t_col": pa.array(c + left, pa.int32()),
                     **{v: pa.array(found[v][r, c]) for v in values}})


def resize_crops(cells: DataFrame, values: Sequence[str], keys: Sequence[str], crop: int, target: int,
                 offsets: Sequence[tuple[Column, Column]]) -> DataFrame:
    """``resize_linear`` of several crops of ``crop`` cells a side, numbered from 1 in ``crop_no``; ``offsets`` are expressions of the keys.

    A cell travels once to a tile that reads it for any of the crops. Offsets are told again after the cells have moved.
    """
    values, keys = list(values), list(keys)
    reads = _linear_reads(crop, target)
    side = min(TILE, target)
    of_source = [sorted({t // side for t, _ in one}) for one in reads]
    tiles = F.array(*[F.array(*[F.lit(k) for k in one]).cast("array<int>") for one in of_source])

    def at(position: str, offset: Column) -> Column:
        place = (F.col(position) - offset).cast("int")
        return F.coalesce(F.when(place >= 0, F.get(tiles, place)), F.array().cast("array<int>"))

    def met(row: Column, col: Column) -> Column:
        return F.flatten(F.transform(row, lambda r: F.transform(col, lambda c: F.struct(r.alias("_tr"), c.alias("_tc")))))

    where = F.array_distinct(F.flatten(F.array(*[met(at("row", o[0]), at("col", o[1])) for o in offsets])))
    spread = cells.select(*keys, "row", "col", *[F.col(v).cast("double").alias(v) for v in values], F.explode(where).alias("_t"))
    moved = spread.select(*keys, "_t._tr", "_t._tc", "row", "col", *values).repartition(*keys, "_tr", "_tc")
    moved = moved.withColumn("_o", F.array(*[o.cast("int") for pair in offsets for o in pair]))
    kinds, crops = dict(moved.dtypes), len(offsets)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        o = t.column("_o")[0].as_py()
        made = []
        for i in range(crops):
            near = np.ones(t.num_rows, bool)
            places = []
            for c, move, tile in zip(CELL, o[2 * i:2 * i + 2], key[-2:]):
                place = t.column(c).to_numpy().astype(np.int64) - move
                read = np.array([tile.as_py() in one for one in of_source])
                near &= (place >= 0) & (place < crop)
                near &= read[np.clip(place, 0, crop - 1)]
                places.append(place)
            if near.any():
                part = _tile_rows(key, places[0][near], places[1][near], t.filter(pa.array(near)), values, keys, crop, target, side)
                made.append(part.append_column("crop_no", pa.repeat(pa.scalar(i + 1, pa.int32()), part.num_rows)))
        return pa.concat_tables(made)

    return moved.groupBy(*keys, "_tr", "_tc").applyInArrow(run, _tile_schema(keys, values, kinds) + ", crop_no int")


def resize_nearest(cells: DataFrame, value: str, keys: Sequence[str], size: int, target: int) -> DataFrame:
    """Nearest resize of square grids: each cell becomes the target cells that read it, without a join."""
    reads = F.array(*[F.array(*[F.lit(t) for t in one]).cast("array<int>") for one in _nearest_reads(size, target)])
    inside = cells.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
    return (inside.withColumn("t_row", F.explode(F.get(reads, F.col("row"))))
            .withColumn("t_col", F.explode(F.get(reads, F.col("col")))).select(*keys, "t_row", "t_col", value))
