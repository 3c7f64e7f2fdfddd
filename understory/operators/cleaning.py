"""Footprint and height-table cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from understory.functions import fixed
from understory.functions.exprs import agreement, between, finite_or_null
from understory.operators.order import exact_medians, join_groups


def quality_footprints(df: DataFrame) -> DataFrame:
    """Footprint shots fit for use; plain comparisons that reach the scan."""
    return df.where((F.col("rh") > 0) & (F.col("quality_flag") == 1) & (F.col("degrade_flag") == 0)
                    & (F.col("sensitivity") > 0.95) & (F.col("beam") > 4)
                    & (F.col("solar_elevation") <= 0) & (F.col("num_detectedmodes") > 0))


def quality_footprints_terrain(df: DataFrame) -> DataFrame:
    """As ``quality_footprints`` but for gridded shots: ground within 50 m above the terrain model."""
    return quality_footprints(df).where(F.col("elev_lowestmode") - F.col("srtm") < 50)


def clean_heights(df: DataFrame, ref: str = "reference_height",
                  others: Sequence[str] = fixed.HEIGHT_COLUMNS[1:]) -> DataFrame:
    """Reference in (0, 100] and within 3 sample deviations; other heights outside [0, 100] -> NULL."""
    valid = df.where(between(ref, 0, 100))
    spread = valid.agg(F.struct(F.avg(ref).alias("m"), F.stddev_samp(ref).alias("s")).alias("x")).scalar()
    kept = valid.where(F.abs(F.col(ref) - spread["m"]) < F.lit(3.0) * spread["s"])
    present = [c for c in others if c in df.columns]
    return kept.withColumns({c: F.when(F.col(c).between(0, 100), F.col(c)) for c in present})


def clean_texture(df: DataFrame, textures: Sequence[str], ref: str = "reference_height",
                  rh: str = "rh", limit: float = fixed.AGREEMENT_M) -> DataFrame:
    """Valid height pairs with accuracy columns; outliers of the difference are dropped and
    outliers of each texture become NULL (3 sample deviations, when over 10 values)."""
    valid = df.where(between(ref, 0, 100) & between(rh, 0, 100)).withColumns(agreement(ref, rh, limit))
    d = "height_difference"
    spread = valid.agg(F.struct(F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).alias("x")).scalar()
    kept = valid.where(F.abs(F.col(d) - spread["m"]) < F.lit(3.0) * spread["s"])
    present = [t for t in textures if t in df.columns]
    if not present:
        return kept
    kept = kept.withColumns({t: finite_or_null(t) for t in present})
    stats = kept.agg(F.struct(*[
        F.struct(F.count(t).alias("n"), F.avg(t).alias("m"), F.stddev_samp(t).alias("s")).alias(t)
        for t in present]).alias("x")).scalar()
    near = {t: (F.col(f"_stats.{t}.n") <= 10) | (F.abs(F.col(t) - F.col(f"_stats.{t}.m")) < F.lit(3.0) * F.col(f"_stats.{t}.s"))
            for t in present}
    return kept.withColumn("_stats", stats).withColumns({t: F.when(near[t], F.col(t)) for t in present}).drop("_stats")


def fill_group_median(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Non-finite values take the group's median of finite ones, 0 where there is none."""
    cleaned = df.withColumns({c: finite_or_null(c) for c in columns})
    med = exact_medians(cleaned, keys, columns)
    names = {c: f"_med_{c}" for c in columns}
    med = med.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    if keys:
        joined = join_groups(cleaned, med, keys, "left")
    else:
        row = med.select(F.struct(*names.values()).alias("x")).scalar()
        joined = cleaned.withColumn("_medians", row)
        return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_medians.{n}"), F.lit(0.0)) for c, n in names.items()}).drop("_medians")
    return (joined.withColumns({c: F.coalesce(F.col(c), F.col(n), F.lit(0.0)) for c, n in names.items()})
            .drop(*names.values()))
