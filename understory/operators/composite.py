"""Per-pixel composites over time and mosaics of overlapping predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import is_finite
from understory.operators.order import exact_median, exact_medians

MONTHS = list(range(1, 13))


def in_period(obs: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Half-open date range on the raw column, so it reaches the scan."""
    return obs.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def median_composite(obs: DataFrame, bands: Sequence[str], key: str = "px") -> DataFrame:
    return exact_medians(obs, [key], bands)


def monthly_values(obs: DataFrame, bands: Sequence[str], key: str = "px", how: str = "median") -> DataFrame:
    """Long (key, month, bands)."""
    if how == "median":
        return exact_medians(obs, [key, "month"], bands)
    if how == "mean":
        return obs.groupBy(key, "month").agg(*[F.avg(b).alias(b) for b in bands])
    raise ValueError(f"unknown composite: {how}")


def month_columns(monthly: DataFrame, bands: Sequence[str], key: str = "px",
                  default: float | None = None) -> DataFrame:
    """Wide columns ``{band}_M{mm}``; months without a value may take a default."""
    def value(b: str, m: int) -> Column:
        v = F.max(F.when(F.col("month") == m, F.col(b)))
        return (v if default is None else F.coalesce(v, F.lit(default))).alias(f"{b}_M{m:02d}")

    return monthly.groupBy(key).agg(*[value(b, m) for b in bands for m in MONTHS])


def monthly_availability(monthly: DataFrame, bands: Sequence[str], zero_missing: Sequence[str] = (),
                         key: str = "px") -> DataFrame:
    """Every (pixel, month, channel) with an availability flag and the value or 0.

    The twelve-month spine is exploded from the pixel's own row, so no table is crossed.
    """
    by_month = monthly.groupBy(key).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col(b).isNotNull(), F.struct("month", b)))).alias(b)
        for b in bands])  # at most twelve entries per pixel and band
    cells = by_month.select(key, F.explode(F.array(*[
        F.struct(F.lit(b).alias("channel"), F.col(b).alias("_m"), F.lit(b in zero_missing).alias("_z"))
        for b in bands])).alias("_c")).select(key, "_c.*")
    spine = cells.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    v = F.try_element_at("_m", F.col("month"))
    ok = v.isNotNull() & (~F.col("_z") | (v != 0))
    return spine.select(key, "month", "channel", F.when(ok, 1).otherwise(0).alias("available"),
                        F.when(ok, v).otherwise(F.lit(0.0)).alias("value"))


def multi_year_median(obs: DataFrame, bands: Sequence[str], years: int = 3, key: str = "px") -> DataFrame:
    """Median over yearly medians of the last complete years."""
    last = obs.agg(F.max("year")).scalar()
    recent = obs.where((F.col("year") < last) & (F.col("year") >= last - years))
    yearly = exact_medians(recent, [key, "year"], bands)
    # at most ``years`` rows per pixel are left, so the plain aggregate is safe here
    return yearly.groupBy(key).agg(*[F.percentile(b, 0.5).alias(b) for b in bands])


def latest_mosaic(obs: DataFrame, value: str, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    seen = obs.where(F.col(value).isNotNull())
    return seen.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def mosaic(preds: DataFrame, value: str, order: Sequence[str], keys: Sequence[str],
           nodata: float = 0.0, patch: str = "patch_num") -> DataFrame:
    """Overlapping predictions per cell under all five strategies.

    Values equal to the no-data code or 0 or non-finite do not count; cells without a
    valid value hold the code. All aggregates merge map-side, so a cell covered by very
    many patches sends one partial row per task.
    """
    ok = is_finite(value) & (F.col(value) != nodata) & (F.col(value) != 0)
    v = F.when(ok, F.col(value))
    at = F.when(ok, F.struct(*order))
    code = F.lit(nodata)
    return preds.groupBy(*keys).agg(
        F.coalesce(F.min_by(v, at), code).alias("first"), F.coalesce(F.max_by(v, at), code).alias("last"),
        F.coalesce(F.min(v), code).alias("min"), F.coalesce(F.max(v), code).alias("max"),
        F.coalesce(F.avg(v), code).alias("average"), F.count(v).alias("n_valid"))


def merge_with_nulls(preds: DataFrame, value: str, order: Sequence[str], keys: Sequence[str],
                     strategy: str = "average") -> DataFrame:
    """One strategy with NULL for uncovered cells: average, maximum or first valid."""
    v = F.when(is_finite(value), F.col(value))
    if strategy == "average":
        merged = F.avg(v)
    elif strategy == "maximum":
        merged = F.max(v)
    else:
        merged = F.min_by(v, F.when(v.isNotNull(), F.struct(*order)))
    return preds.groupBy(*keys).agg(merged.alias(value))


def merge_overwriting(preds: DataFrame, value: str, order: Sequence[str], keys: Sequence[str],
                      extruded: Column) -> DataFrame:
    """Later patches overwrite earlier ones; patches that pass the edge are left out."""
    kept = preds.where(~extruded)
    return kept.groupBy(*keys).agg(
        F.coalesce(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))), F.lit(0.0)).alias(value))


def median_by_month(obs: DataFrame, band: str, key: str = "px") -> DataFrame:
    return exact_median(obs, [key, "month"], band, band)
