"""Patch catalogue: bounds, summaries, consistency and neighbourhood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import between
from understory.functions.projection import unproject

BOX = ("min_x", "min_y", "max_x", "max_y")


def bounds(patches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return patches.groupBy(*keys).agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"),
                                      F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))


def summary_rows(patches: DataFrame, path: Column) -> DataFrame:
    """The 15 columns of a patch catalogue; the centre is told in degrees from the patch's own system (``crs`` as EPSG:n)."""
    centred = patches.withColumns({
        "file_path": path, "_x": (F.col("min_x") + F.col("max_x")) / 2, "_y": (F.col("min_y") + F.col("max_y")) / 2,
        "_code": F.regexp_extract("crs", r"(\d+)$", 1).try_cast("int")})
    size = {n: ((F.col(f"max_{a}") - F.col(f"min_{a}")) / F.col("pixel_size")).cast("int").alias(n) for n, a in (("width", "x"), ("height", "y"))}
    return unproject(centred, "_x", "_y", "_code", "center_lon", "center_lat").select(
        "patch_id", "file_path", F.col("temporal").alias("temporal_mode"), "band_count", (F.col("max_x") - F.col("min_x")).alias("patch_size_m"),
        F.col("pixel_size").alias("pixel_size_m"), size["width"], size["height"], "center_lon", "center_lat", *BOX, "crs")


def output_grid(patches: DataFrame, keys: Sequence[str] = (), pixel: str = "pixel_size") -> DataFrame:
    out = patches.groupBy(*keys).agg(
        *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))], F.min(pixel).alias(pixel))
    return out.withColumns({
        "width": ((F.col("max_x") - F.col("min_x")) / F.col(pixel)).cast("int"),
        "height": ((F.col("max_y") - F.col("min_y")) / F.col(pixel)).cast("int")})


def consistency(patches: DataFrame, order: str = "patch_num") -> DataFrame:
    """Whether all patches agree with the first on CRS, resolution, mode and band count."""
    row = patches.agg(
        F.min_by(F.struct("crs", "pixel_size", "temporal", "band_count"), order).alias("f"),
        F.count_distinct("crs").alias("n_crs"), F.min("pixel_size").alias("p0"), F.max("pixel_size").alias("p1"),
        F.count_distinct("temporal").alias("n_mode"), F.count_distinct("band_count").alias("n_bands"))
    near = (F.abs(F.col("p1") - F.col("f.pixel_size")) < 1) & (F.abs(F.col("p0") - F.col("f.pixel_size")) < 1)
    return row.select((F.col("n_crs") == 1).alias("same_crs"), near.alias("same_resolution"),
                      (F.col("n_mode") == 1).alias("same_mode"), (F.col("n_bands") == 1).alias("same_bands"))


def summary(patches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return patches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("temporal").alias("temporal"),
        F.count_if(~F.col("temporal")).alias("non_temporal"),
        *[f(c).alias(c) for c, f in zip(BOX, (F.min, F.min, F.max, F.max))]).withColumn(
        "area_km2", (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")) / 1e6)


def validation(px: DataFrame, target: str, patch: str = "patch_num") -> DataFrame:
    """Per patch (and overall, with a NULL patch): valid and total cells, coverage, target range."""
    v = F.when(between(target, 0), F.col(target))
    zero = F.lit(0.0)
    return px.rollup(patch).agg(
        F.count(v).alias("n_valid"), F.count(F.lit(1)).alias("n_total"),
        (F.count(v) / F.count(F.lit(1)) * 100.0).alias("coverage"),
        F.coalesce(F.min(v), zero).alias("target_min"), F.coalesce(F.max(v), zero).alias("target_max"))


def validation_totals(px: DataFrame, target: str, patch: str = "patch_num") -> DataFrame:
    per = px.groupBy(patch).agg(F.count_if(between(target, 0)).alias("_v"))
    return per.agg(F.count(F.lit(1)).alias("total_patches"), F.sum("_v").alias("total_valid"),
                   F.avg("_v").alias("average_per_patch"))


def catalogue(px: DataFrame, left: float, top: float, size: float, cells: int = 64) -> DataFrame:
    """Catalogue rows built from the pixels of each patch: extent, centre, size and counts."""
    rows = px.groupBy("patch_num", "patch_id").agg(
        F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"),
        F.count(F.lit(1)).alias("n_pixels"))
    x = F.lit(left) + F.col("patch_num") * F.lit(size * cells)
    return rows.select(
        "patch_num", "patch_id", "n_pixels",
        (x + F.col("c0") * size).alias("min_x"), (x + (F.col("c1") + 1) * size).alias("max_x"),
        (F.lit(top) - (F.col("r1") + 1) * size).alias("min_y"), (F.lit(top) - F.col("r0") * size).alias("max_y"),
    ).withColumns({"centre_x": (F.col("min_x") + F.col("max_x")) / 2, "centre_y": (F.col("min_y") + F.col("max_y")) / 2,
                   "side": F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))})


def overlapping_boxes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tile: float,
                      buffer: float = 0.0, touching: bool = False) -> DataFrame:
    """Pairs of boxes that overlap, with the common box.

    Both sides are put into square tiles and joined on the tile; a pair is kept only in
    the tile that holds the lower-left corner of its common box, so no pair appears twice
    and no distinct is needed. Pick ``tile`` near the typical box side, so that a box
    lies in a few tiles and a tile holds only boxes that really are near each other.
    """
    def tiled(df: DataFrame, key: str, name: str, grow: float) -> DataFrame:
        box = df.select(F.col(key).alias(name), *[
            (F.col(c) + F.lit(-grow if c.startswith("min") else grow)).alias(f"{name}_{c}") for c in BOX])
        span = [F.sequence(F.floor(F.col(f"{name}_min_{a}") / tile).cast("long"),
                           F.floor(F.col(f"{name}_max_{a}") / tile).cast("long")) for a in ("x", "y")]
        return (box.withColumn("_tx", F.explode(span[0])).withColumn("_ty", F.explode(span[1])))

    pairs = tiled(left, left_id, "a", buffer).join(tiled(right, right_id, "b", 0.0), ["_tx", "_ty"])
    x0, y0 = F.greatest("a_min_x", "b_min_x"), F.greatest("a_min_y", "b_min_y")
    x1, y1 = F.least("a_max_x", "b_max_x"), F.least("a_max_y", "b_max_y")
    hit = (x0 <= x1) & (y0 <= y1) if touching else (x0 < x1) & (y0 < y1)
    home = (F.floor(x0 / tile) == F.col("_tx")) & (F.floor(y0 / tile) == F.col("_ty"))
    return pairs.where(hit & home).select(
        F.col("a").alias("left_id"), F.col("b").alias("right_id"), x0.alias("min_x"), y0.alias("min_y"),
        x1.alias("max_x"), y1.alias("max_y"))


def neighbours(patches: DataFrame, buffer: float, tile: float, key: str = "patch_num") -> DataFrame:
    """Other patches whose box overlaps or touches the box grown by ``buffer``."""
    pairs = overlapping_boxes(patches, patches, key, key, tile, buffer, touching=True)
    return pairs.where(F.col("left_id") != F.col("right_id")).select("left_id", "right_id")
