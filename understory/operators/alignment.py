"""Joins between points, cells and grids. Points meet cells by equality of cell keys."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import HASH_RANGE, between, cell_col, cell_row, drop_codes, sample_hash
from understory.operators.metrics import sigma_filter_pair
from understory.operators.order import number_by_hash
from understory.operators.tiles import CELL, TILE, field, spread
from understory.operators.training import gate


def to_cells(points: DataFrame, left: float, top: float, res: float, lon: str = "longitude",
             lat: str = "latitude", row: str = "row", col: str = "col") -> DataFrame:
    return points.withColumns({row: cell_row(lat, top, res), col: cell_col(lon, left, res)})


def sample_points(points: DataFrame, cells: DataFrame, keys: Sequence[str], value: str = "value",
                  out: str | None = None) -> DataFrame:
    """Every point with the value of its cell; outside the grid or on no-data it is NULL."""
    out = out or value
    lookup = cells.select(*keys, drop_codes(value).alias(out))
    return points.join(lookup, list(keys), "left")


def reference_summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(value).alias("valid"),
                  F.count_if(F.col(value).isNull()).alias("no_data"),
                  F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def sample_regions(points: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All cell bands at each point; points on masked cells are lost."""
    return points.join(cells, list(keys))


def sample_grid(points: DataFrame, value: str, n: int, hash_keys: Sequence[str], tie: Sequence[str],
                seed: int = 42) -> DataFrame:
    """Seeded uniform sample of n rows that hold a value: a fixed-size top-k by hash."""
    held = points.where(F.col(value).isNotNull()).withColumn("_h", sample_hash(hash_keys, seed))
    return held.orderBy("_h", *tie).limit(n).drop("_h")


def first_match(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def attach_first(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str,
                 order: Sequence[str]) -> DataFrame:
    """Left join on the key with the first matching row of the right side."""
    return left.join(first_match(right, keys, value, order), list(keys), "left")


def stack_bands(sources: Sequence[tuple[DataFrame, Sequence[str]]], keys: Sequence[str]) -> DataFrame:
    """Bands of several sources side by side on the pixel grid, like a chain of full outer
    joins but with one shuffle: sources are put under each other and grouped once."""
    names = [b for _, bands in sources for b in bands]
    stacked = None
    for df, bands in sources:
        part = df.select(*keys, *bands)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return stacked.groupBy(*keys).agg(*[F.max(b).alias(b) for b in names])


def points_to_cells(points: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    return first_match(points.where(F.col(value).isNotNull()), keys, value, order)


def mask_points_in_bounds(points: DataFrame, mask: DataFrame, keys: Sequence[str], left: float,
                          bottom: float, right: float, top: float, res: float) -> DataFrame:
    """Points inside the mask's box whose cell is set."""
    inside = points.where(F.col("longitude").between(left, right) & F.col("latitude").between(bottom, top))
    on = mask.where(F.col("mask") == 1).select(*keys)
    return to_cells(inside, left, top, res).join(on, list(keys), "left_semi")


def labelled_patches(patches: DataFrame, targets: DataFrame, px: DataFrame, key: str = "patch_num") -> DataFrame:
    """Patches with a target entry and at least one forest pixel."""
    forest = px.where(F.col("forest_mask") > 0).select(key).distinct()
    return (patches.join(targets.select(key).distinct(), key, "left_semi")
            .join(forest, key, "left_semi"))


def with_region(df: DataFrame, regions: DataFrame, key: str = "region") -> DataFrame:
    """Region name and bias factor; unknown codes keep factor 1. The lookup is a fixed small table."""
    return (df.join(F.broadcast(regions), key, "left")
            .withColumn("factor", F.coalesce("factor", F.lit(1.0)))
            .withColumn("region_name", F.coalesce("region_name", F.lit("Unknown"))))


def prediction_pairs(px: DataFrame, regions: DataFrame, pred: str, ref: str, patch: str = "patch_num",
                     correct: bool = True, min_rows: int = 50, cap: int | None = None,
                     hash_col: str = "hkey", tie: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cleaned (region, patch, ref, pred) pairs pooled over patches.

    ``correct`` divides by the region's bias factor; ``cap`` (off by default) keeps a
    seeded sample of at most that many pairs per patch.
    """
    rows = with_region(px, regions)
    if correct:
        rows = rows.withColumn(pred, F.col(pred) / F.col("factor"))
    kept = sigma_filter_pair(rows, ref, pred, ["region", patch], min_rows)
    if cap is not None:
        kept = number_by_hash(kept, ["region", patch], hash_col, tie, limit=cap).drop("row_no")
    return kept


def ensemble_pairs(px: DataFrame, first: str, second: str, ref: str, minimum: int = 10,
                   patch: str = "patch_num") -> DataFrame:
    valid = px.where(between(ref, 0, 100) & F.col(first).isNotNull() & F.col(second).isNotNull())
    return gate(valid, patch, minimum)


# ---- shift-aware matching ---------------------------------------------------------

def square_shifts(radius: int) -> list[tuple[int, int]]:
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span]


def disc_shifts(radius: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dx, dy in square_shifts(radius) if dx * dx + dy * dy <= radius * radius]


def shift_sums(px: DataFrame, target: str, pred: str, shifts: Sequence[tuple[int, int]], size: int, wrap: bool = False,
               bound: float | None = None, keep: Column | None = None, patch: str = "patch_num") -> DataFrame:
    """``patch, dx, dy``: targets moved by each shift against the predictions they reach, as count and sums.

    A sparse cross-correlation inside tiles with a margin of the longest shift: a cell travels once, near a tile's edge
    also to the next tiles, and only a tile's own targets look around. With ``wrap`` the patch of ``size`` cells on a side
    is closed to a ring both ways; otherwise what leaves it is lost. ``bound`` limits difference and loss; ``keep``
    tells the targets that count, by default those in (0, 100).
    """
    reach = max(max(abs(dx), abs(dy)) for dx, dy in shifts)
    counts = between(target, 0, 100, high_open=True) if keep is None else keep
    cells = px.select(patch, "row", "col", F.when(counts, F.col(target).cast("double")).alias("_t"), F.col(pred).cast("double").alias("_p"))
    cells = cells.where(F.col("_t").isNotNull() | F.col("_p").isNotNull())
    if wrap:
        for c in CELL:
            ring = F.array_compact(F.array(F.struct(F.col(c).alias("at"), F.col("_t").alias("t")), *[
                F.when(edge, F.struct((F.col(c) + move).cast("int").alias("at"), F.lit(None).cast("double").alias("t")))
                for edge, move in ((F.col(c) < reach, size), (F.col(c) >= size - reach, -size))]))
            cells = cells.withColumn("_c", F.explode(ring)).withColumns({c: F.col("_c.at"), "_t": F.col("_c.t")}).drop("_c")
    else:
        cells = cells.where(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))
    cells = spread(cells, reach, TILE)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        row, col = (t.column(c).to_numpy().astype(np.int64) for c in CELL)
        wanted, found = field(t, "_t"), field(t, "_p")
        top, left = key[-2].as_py() * TILE, key[-1].as_py() * TILE
        own = ~np.isnan(wanted) & (row >= top) & (row < top + TILE) & (col >= left) & (col < left + TILE)
        r, c = row - row.min() + reach, col - col.min() + reach
        grid = np.full((int(r.max()) + reach + 1, int(c.max()) + reach + 1), np.nan)
        held = ~np.isnan(found)
        grid[r[held], c[held]] = found[held]
        r, c, wanted = r[own], c[own], wanted[own]
        rows = []
        for dx, dy in shifts if len(wanted) else []:
            met = grid[r + dy, c + dx]
            good = ~np.isnan(met)
            if good.any():
                d = np.abs(met[good] - wanted[good])
                d = d if bound is None else np.minimum(d, bound)
                loss = np.where(d < 1, 0.5 * d * d, d - 0.5)
                loss = loss if bound is None else np.minimum(loss, bound)
                rows.append((dx, dy, int(good.sum()), wanted[good].sum(), met[good].sum(), loss.sum()))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows) if rows else [[]] * 6, SHIFT_TYPES)]
        return pa.table([pa.repeat(key[0], len(rows)), *columns], names=[patch, *SHIFT_COLUMNS])

    kind = dict(px.dtypes)[patch]
    part = cells.groupBy(patch, "_tr", "_tc").applyInArrow(run, f"`{patch}` {kind}, dx int, dy int, n long, target_sum double, pred_sum double, loss_sum double")
    return part.groupBy(patch, "dx", "dy").agg(*[F.sum(c).alias(c) for c in SHIFT_COLUMNS[2:]])


SHIFT_COLUMNS = ["dx", "dy", "n", "target_sum", "pred_sum", "loss_sum"]
SHIFT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]


def shift_losses(sums: DataFrame, patch: str = "patch_num") -> DataFrame:
    """Mean Huber loss per (patch, shift)."""
    return sums.select(patch, "dx", "dy", (F.col("loss_sum") / F.col("n")).alias("loss"), F.col("n").alias("n_pairs"))


def best_shift_loss(px: DataFrame, losses: DataFrame, fallback: float = 10.0, patch: str = "patch_num") -> DataFrame:
    """Smallest loss per patch and its shift; patches without any pair take the fallback."""
    best = losses.groupBy(patch).agg(
        F.min("loss").alias("loss"),
        F.min_by(F.struct("dx", "dy"), F.struct(F.round("loss", 9), "dx", "dy")).alias("s"))
    return (px.select(patch).distinct().join(best, patch, "left")
            .select(patch, F.coalesce("loss", F.lit(fallback)).alias("loss"), "s.dx", "s.dy"))


def rolled_prediction_loss(px: DataFrame, target: str, pred: str, radius: int, size: int,
                           patch: str = "patch_num") -> DataFrame:
    """Predictions roll around the patch edge while targets stay: mean of patch means per
    shift, smallest shift, 0 without targets. Rolling predictions by (dx, dy) equals
    moving targets by (-dx, -dy), so the sparse side is the one that is multiplied."""
    back = [(-dx, -dy) for dx, dy in square_shifts(radius)]
    per = shift_losses(shift_sums(px, target, pred, back, size, wrap=True, keep=between(target, 0), patch=patch), patch)
    return (per.groupBy("dx", "dy").agg(F.avg("loss").alias("loss"))
            .agg(F.coalesce(F.min("loss"), F.lit(0.0)).alias("loss")))


def hash_bucket(keys: Sequence[str], buckets: int, seed: int = 0) -> Column:
    return F.floor(sample_hash(keys, seed) * buckets / HASH_RANGE).cast("int")
