"""Training tables: valid targets, per-patch gates, filled features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import all_of, between, finite_or_zero, is_finite

# Validity rules as (name, low, low open, high, high open).
HEIGHT_RULES = [
    ("gedi_open", 0.0, True, 100.0, True),
    ("closed_top", 0.0, True, 100.0, False),
    ("inclusive", 0.0, False, 50.0, False),
    ("production", 0.1, True, 100.0, False),
    ("positive", 0.0, True, None, False),
    ("evaluation", 0.0, False, 35.0, False),
    ("ensemble_pred", -50.0, True, 100.0, False),
]


def height_rule(name: str, value: str) -> Column:
    for rule, low, low_open, high, high_open in HEIGHT_RULES:
        if rule == name:
            return between(value, low, high, low_open, high_open)
    raise ValueError(f"unknown height rule: {name}")


def rule_counts(df: DataFrame, value: str) -> DataFrame:
    """Rows accepted by every rule, in one pass."""
    row = df.agg(*[F.count_if(height_rule(name, value)).alias(name) for name, *_ in HEIGHT_RULES])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(name).alias("n_valid")) for name, *_ in HEIGHT_RULES
    ])).alias("e")).select("e.*")


def prediction_pairs_in_range(df: DataFrame, pred: str, ref: str, top: float = 35.0,
                              nodata: float = -32767.0) -> DataFrame:
    """Both sides in [0, top] and the reference not the no-data code."""
    return df.where(between(pred, 0, top, low_open=False) & between(ref, 0, top, low_open=False)
                    & (F.col(ref) != nodata))


def valid_share(px: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    ok = between(target, 0)
    return px.groupBy(*keys).agg(F.count_if(ok).alias("n_valid"), F.count(F.lit(1)).alias("n_total"),
                                 (F.count_if(ok) / F.count(F.lit(1)) * 100.0).alias("valid_percent"))


def sparse_pixels(px: DataFrame, target: str) -> DataFrame:
    return px.where(between(target, 0))


def gate(valid: DataFrame, patch: str, minimum: int) -> DataFrame:
    """Rows of patches that hold at least ``minimum`` rows."""
    sizes = valid.groupBy(patch).agg(F.count(F.lit(1)).alias("n_samples"))
    return valid.join(sizes.where(F.col("n_samples") >= minimum), patch)


def skipped_patches(px: DataFrame, valid: DataFrame, patch: str, minimum: int) -> DataFrame:
    """All patches that fail the gate with their number of valid rows."""
    sizes = valid.groupBy(patch).agg(F.count(F.lit(1)).alias("n"))
    return (px.select(patch).distinct().join(sizes, patch, "left")
            .select(patch, F.coalesce("n", F.lit(0)).alias("n_valid"))
            .where(F.col("n_valid") < minimum))


def training_table(px: DataFrame, target: str, features: Sequence[str], minimum: int = 10,
                   patch: str = "patch_num", keep: Sequence[str] = ("row", "col")) -> DataFrame:
    """Rows with a target in (0, 100) from patches with enough of them; features made finite.

    ``all_zero`` marks rows without any non-zero feature; they are kept.
    """
    valid = px.where(between(target, 0, 100, high_open=True))
    kept = gate(valid, patch, minimum)
    filled = kept.select(patch, *keep, *[finite_or_zero(f).alias(f) for f in features],
                         F.col(target).alias("target"))
    return filled.withColumn("all_zero", all_of([F.col(f) == 0 for f in features]))


def count_valid(px: DataFrame, target: str, patch: str = "patch_num") -> DataFrame:
    return px.groupBy(patch).agg(F.count_if(between(target, 0, 100, high_open=True)).alias("n_valid"))


def training_info(df: DataFrame, bands: Sequence[str], target: str = "rh") -> DataFrame:
    """One row: size, sorted band names and target range; zeros for an empty table."""
    zero = F.lit(0.0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.min(target), zero).alias("min_target"),
                  F.coalesce(F.max(target), zero).alias("max_target")).withColumn(
        "bands", F.array_join(F.array_sort(F.array(*[F.lit(b) for b in bands])), ","))


def has_values(df: DataFrame, value: str, nodata: float, keys: Sequence[str] = ()) -> DataFrame:
    """False for groups in which every value equals the no-data code."""
    return df.groupBy(*keys).agg((~F.bool_and(F.col(value).eqNullSafe(F.lit(nodata)))).alias("has_values"))


def pair_summary(df: DataFrame, pred: str, ref: str) -> DataFrame:
    """Range, mean and deviation of both sides and whether they are usable."""
    cols = []
    for name, c in (("pred", pred), ("ref", ref)):
        v = F.when(is_finite(c), F.col(c))
        cols += [F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max"),
                 F.avg(v).alias(f"{name}_mean"), F.stddev_pop(v).alias(f"{name}_std")]
    out = df.agg(*cols)
    ok = (F.col("pred_std") > 0) & (F.col("ref_std") > 0) & (F.col("pred_max") >= 0.01) & (F.col("ref_max") >= 0.01)
    return out.withColumn("usable", ok)


def require_usable(summary: DataFrame) -> DataFrame:
    """Fail the job when a side has no variance or is too low."""
    wrong = F.raise_error(F.lit("no variance or heights too low")).cast("boolean")
    return summary.withColumn("usable", F.when(F.col("usable"), True).otherwise(wrong))
