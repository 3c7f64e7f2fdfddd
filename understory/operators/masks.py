"""Observation masks and forest masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from understory.functions.exprs import normalized_difference, qa60_clear
from understory.operators.order import exact_median, exact_medians
from understory.session import parts, written

# Observations that a task counts by class.
TASK_ROWS = 1_200_000

MASK_KINDS = ("DW", "FNF", "NDVI", "WC", "CHM", "ALL", "none")


def drop_cloudy(obs: DataFrame, limit: float = 65.0, probability: str = "probability") -> DataFrame:
    return obs.where(F.col(probability) < limit)


def drop_edges(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("B8A").isNotNull() & F.col("B9").isNotNull())


def clear_reflectance(obs: DataFrame, bands: Sequence[str], max_cloud: float = 20.0) -> DataFrame:
    """Scenes under the cloud limit, clear by QA bits, scaled to reflectance."""
    clear = obs.where((F.col("cloudy_pct") < max_cloud) & qa60_clear("qa60"))
    return clear.withColumns({b: F.col(b) / 10000.0 for b in bands})


def _pixels(obs: DataFrame, key: str) -> DataFrame:
    return obs.select(key).distinct()


def dynamic_world_mask(obs: DataFrame, key: str = "px", label: str = "dw_label") -> DataFrame:
    """1 unless the median label is 0 or at least 2; pixels without data stay 1."""
    med = exact_median(obs, [key], label, "_m")
    other = (F.col("_m") == 0) | (F.col("_m") >= 2)
    return _pixels(obs, key).join(med, key, "left").select(
        key, F.when(other, 0).otherwise(1).alias("dw"))


def forest_type_mask(obs: DataFrame, key: str = "px", dense: str = "fnf4", plain: str = "fnf") -> DataFrame:
    """Median class 1 or 2 of the dense product; where that product has no scene at all, class 1
    of the plain one; 1 where neither has data.

    Classes are few, so the observations are dealt by pixel in even parts once and counted by class; all that follows
    reads the counts.
    """
    rows = obs.select(key, F.col(dense).alias("_m4"), F.col(plain).alias("_m1"))
    dealt = rows.repartition(parts(obs.sparkSession, rows.count(), TASK_ROWS), key)
    counts = written(dealt.groupBy(key, "_m4", "_m1").agg(F.count(F.lit(1)).alias("_n")), "class-counts")
    medians = exact_medians(counts, [key], ["_m4", "_m1"], weight="_n")
    has = counts.agg(F.struct((F.count("_m4") > 0).alias("d"), (F.count("_m1") > 0).alias("p")).alias("x")).scalar()
    forest = (F.when(has["d"], F.col("_m4").isin(1.0, 2.0))
              .when(has["p"], F.col("_m1") == 1.0).otherwise(F.lit(True)))
    return medians.select(key, F.when(forest, 1).otherwise(0).alias("fnf_mask"))


def ndvi_mask(obs: DataFrame, key: str = "px", threshold: float = 0.3, cloud: float = 70.0) -> DataFrame:
    clear = drop_cloudy(drop_edges(obs), cloud).withColumn("_ndvi", normalized_difference("B8", "B4"))
    med = exact_median(clear, [key], "_ndvi", "_m")
    return _pixels(obs, key).join(med, key, "left").select(
        key, F.when(F.col("_m") >= threshold, 1).otherwise(0).alias("ndvi_mask"))


def cover_masks(obs: DataFrame, key: str = "px") -> DataFrame:
    """Tree class of the land cover map and height of at least one metre, newest observation wins."""
    newest = F.struct("ts", "obs_id")
    cell = obs.groupBy(key).agg(F.max_by("wc", newest).alias("_wc"), F.max_by("chm", newest).alias("_h"))
    return cell.select(key, F.when(F.col("_wc") == 10, 1).otherwise(0).alias("wc_mask"),
                       F.when(F.col("_h") >= 1, 1).otherwise(0).alias("chm_mask"))


def combined_mask(obs: DataFrame, kind: str, key: str = "px", ndvi_threshold: float = 0.3,
                  wc_uses_ndvi: bool = False) -> DataFrame:
    """(key, mask). In ``WC`` mode the NDVI part counts as 1 unless asked for."""
    if kind not in MASK_KINDS:
        raise ValueError(f"unknown mask type: {kind}")
    base = _pixels(obs, key)
    if kind == "none":
        return base.withColumn("mask", F.lit(1))
    if kind == "DW":
        return dynamic_world_mask(obs, key).withColumnRenamed("dw", "mask")
    if kind == "FNF":
        return forest_type_mask(obs, key).withColumnRenamed("fnf_mask", "mask")
    if kind == "NDVI":
        return ndvi_mask(obs, key, ndvi_threshold).withColumnRenamed("ndvi_mask", "mask")
    cover = cover_masks(obs, key)
    if kind == "CHM":
        return cover.select(key, F.col("chm_mask").alias("mask"))
    if kind == "WC":
        both = F.col("wc_mask") * F.col("chm_mask")
        if not wc_uses_ndvi:
            return cover.select(key, both.alias("mask"))
        return cover.join(ndvi_mask(obs, key, ndvi_threshold), key).select(
            key, (both * F.col("ndvi_mask")).alias("mask"))
    return _all_masks(obs, key, ndvi_threshold)


def _all_masks(obs: DataFrame, key: str, ndvi_threshold: float, cloud: float = 70.0) -> DataFrame:
    """Forest by any product, times height. One grouping gives all medians; an observation that is
    cloudy or without edge bands only lacks its NDVI."""
    clear = F.col("B8A").isNotNull() & F.col("B9").isNotNull() & (F.col("probability") < cloud)
    rows = obs.select(key, F.col("dw_label").alias("_dw"), F.col("fnf4").alias("_m4"), F.col("fnf").alias("_m1"),
                      F.when(clear, normalized_difference("B8", "B4")).alias("_ndvi"))
    medians = exact_medians(rows, [key], ["_dw", "_m4", "_m1", "_ndvi"])
    has = obs.agg(F.struct((F.count("fnf4") > 0).alias("d"), (F.count("fnf") > 0).alias("p")).alias("x")).scalar()
    other = (F.col("_dw") == 0) | (F.col("_dw") >= 2)
    typed = (F.when(F.col("_has.d"), F.col("_m4").isin(1.0, 2.0))
             .when(F.col("_has.p"), F.col("_m1") == 1.0).otherwise(F.lit(True)))
    forest = F.greatest(F.when(other, 0).otherwise(1), F.when(typed, 1).otherwise(0), F.col("wc_mask"),
                        F.when(F.col("_ndvi") >= ndvi_threshold, 1).otherwise(0))
    return (cover_masks(obs, key).join(medians, key, "left").withColumn("_has", has)
            .select(key, (forest * F.col("chm_mask")).alias("mask")))


def mask_points(points: DataFrame, mask: DataFrame, key: Sequence[str], value: str = "rh") -> DataFrame:
    """Every point is kept; the value becomes 0 outside forest."""
    joined = points.join(mask, list(key), "left")
    return joined.withColumn(value, F.when(F.col("mask") == 1, F.col(value)).otherwise(F.lit(0.0))).drop("mask")


def mask_pixels(px: DataFrame, mask: DataFrame, key: Sequence[str]) -> DataFrame:
    """Pixels outside forest are dropped."""
    return px.join(mask.where(F.col("mask") == 1).select(*key), list(key), "left_semi")


def mask_bands(px: DataFrame, bands: Sequence[str], mask: str = "forest_mask") -> DataFrame:
    """Band values outside forest become NULL."""
    return px.withColumns({b: F.when(F.col(mask) > 0, F.col(b)) for b in bands})
