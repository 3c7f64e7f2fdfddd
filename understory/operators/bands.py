"""Band roles by name. The schema is the band list, so these resolve on ``df.columns``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions import fixed
from understory.functions.exprs import as_col, finite_or_zero

GRID_KEYS = ["patch_num", "patch_id", "region", "row", "col", "hkey", "vec_id", "label"]
MONTH_SUFFIX = r"_M(0[1-9]|1[0-2])"


def bands_of(df: DataFrame, keys: Sequence[str] = GRID_KEYS) -> list[str]:
    return [c for c in df.columns if c not in keys]


def band_names(names: Sequence[str], mode: str) -> list[str]:
    """Names of one selection mode: embedding, auxiliary, original or all."""
    if mode == "embedding":
        found = [n for n in names if re.fullmatch(r"A\d\d", n)]
        return sorted(found, key=lambda n: int(n[1:]))
    if mode == "auxiliary":
        return [n for n in fixed.AUXILIARY_BANDS if n in names]
    if mode == "original":
        other = set(fixed.AUXILIARY_BANDS) | set(fixed.TARGET_BANDS)
        return [n for n in names if n not in other and not re.fullmatch(r"A\d\d", n)]
    if mode == "all":
        return [n for n in names if n not in fixed.TARGET_BANDS]
    raise ValueError(f"unknown band selection: {mode}")


def select_bands(df: DataFrame, mode: str, keep: Sequence[str] = ("patch_num", "row", "col")) -> DataFrame:
    chosen = band_names(bands_of(df), mode)
    if not chosen:
        raise ValueError(f"no band matches selection {mode}")
    return df.select(*keep, *chosen)


def target_band(names: Sequence[str], mode: str) -> str:
    """Target column, chosen by presence of columns."""
    if mode == "gedi_only":
        candidates = ["rh"]
    elif mode == "reference":
        candidates = fixed.REFERENCE_FALLBACK
    else:
        raise ValueError(f"unknown supervision mode: {mode}")
    for name in candidates:
        if name in names:
            return name
    raise ValueError(f"no target band for supervision mode {mode}")


def extract_bands(df: DataFrame, selection: str, supervision: str,
                  keep: Sequence[str] = ("patch_num", "row", "col")) -> DataFrame:
    """Features of a selection plus ``target``."""
    target = target_band(df.columns, supervision)
    features = [n for n in band_names(bands_of(df), selection) if n != target]
    if not features:
        raise ValueError("no feature bands left")
    return df.select(*keep, *features, F.col(target).alias("target"))


def embedding_features(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    present = [b for b in fixed.EMBEDDING_BANDS if b in df.columns]
    if not present:
        raise ValueError("no embedding band found")
    return df.select(*keep, *[finite_or_zero(b).alias(b) for b in present])


def positional_names(count: int, temporal: bool = False) -> list[str]:
    """Band names by position for a stack without descriptions."""
    if temporal and count == fixed.TEMPORAL_BAND_COUNT:
        months = range(1, 13)
        names = [f"{b}_M{m:02d}" for b in ("S1_VV", "S1_VH") for m in months]
        names += [f"S2_{b}_M{m:02d}" for m in months for b in [*fixed.S2_REFLECTANCE, "NDVI"]]
        names += [f"{b}_M{m:02d}" for b in ("ALOS2_HH", "ALOS2_HV") for m in months]
        return names + [f"other_{i}" for i in range(count - len(names))]
    if temporal:
        return [f"band_{i}" for i in range(count)]
    return [fixed.STATIC_BANDS[i] if i < len(fixed.STATIC_BANDS) else f"band_{i}" for i in range(count)]


def named_by_position(df: DataFrame, array: str, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long (keep, band, value) of an array column with one name per position."""
    return (df.select(*keep, F.posexplode(array).alias("_p", "value"))
            .select(*keep, F.get(F.array(*[F.lit(n) for n in names]), F.col("_p")).alias("band"), "value"))


def target_position(names: Sequence[str]) -> int:
    """Position of the first band whose name contains ``rh``; the last band when none does."""
    for i, name in enumerate(names):
        if "rh" in name.lower():
            return i
    return len(names) - 1


def drop_target(df: DataFrame, bands: Sequence[str]) -> DataFrame:
    return df.drop(bands[target_position(bands)])


def is_temporal(name: Column | str) -> Column:
    return as_col(name).rlike(MONTH_SUFFIX)


def is_temporal_file(path: Column | str) -> Column:
    path = as_col(path)
    return F.lower(path).contains("temporal") | path.contains("_M01")


def split_temporal(names: Sequence[str]) -> tuple[list[str], list[str]]:
    """Temporal and other band names; target and mask belong to neither."""
    usable = [n for n in names if n not in ("rh", "forest_mask")]
    monthly = [n for n in usable if re.search(MONTH_SUFFIX, n)]
    return monthly, [n for n in usable if n not in monthly]


def patch_has_target(px: DataFrame, target: str, patch: str = "patch_num") -> DataFrame:
    return px.groupBy(patch).agg((F.count(target) > 0).alias("compatible"))


def high_variance(df: DataFrame, bands: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """(band, variance) of bands whose population variance exceeds the threshold."""
    row = df.agg(*[F.var_pop(b).alias(b) for b in bands])
    long = row.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("variance"))
                                          for b in bands])).alias("e")).select("e.*")
    return long.where(F.col("variance") > threshold)
