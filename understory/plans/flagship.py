"""The flagship analysis: footprints to accuracy of height products by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from understory.operators.cleaning import clean_heights, quality_footprints
from understory.operators.metrics import regional_metrics, regional_summary


def regional_accuracy(footprints: DataFrame) -> DataFrame:
    return regional_metrics(clean_heights(quality_footprints(footprints)))


def flagship(footprints: DataFrame) -> DataFrame:
    summary = regional_summary(regional_accuracy(footprints))
    return summary.select("product", *[
        F.round(c, 3).alias(c) for c in summary.columns if c not in ("product", "total_samples")],
        "total_samples").orderBy("product")
