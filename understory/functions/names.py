"""Names and lookup of patch sizes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from understory.functions import fixed
from understory.functions.exprs import as_col, file_name


def folded(array: str, width: int = 80) -> Column:
    """Names joined by commas into lines; a name starts a new line when the running length,
    counting two characters per name for its separator, would pass the width."""
    empty = F.lit("")

    def step(text: Column, name: Column) -> Column:
        line = F.element_at(F.split(text, "\n"), -1)
        full = F.length(line) + 2 + F.length(name) + 2 > width
        return F.when(text == "", name).when(full, F.concat(text, F.lit("\n"), name)).otherwise(F.concat(text, F.lit(", "), name))

    return F.aggregate(array, empty, step)


def export_name(path: str, mask: str, threshold: float, bands: int, year: Column, buffer: Column, scale: int,
                window: int, texture: str) -> Column:
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    mask_name = f"{mask}{round(threshold * 100)}" if mask == "NDVI" else mask
    return F.concat(F.lit("gedi_embedding_"), stem, F.lit(f"_{mask_name}_b{bands}_"), as_col(year).cast("string"), F.lit("_"),
                    as_col(buffer).cast("string"), F.lit(f"m_scale{scale}m_w{window}_{texture}"))


def resolution(scale: Column) -> tuple[Column, Column]:
    """Patch side in metres and pixels of a scale; an unsupported scale fails the job."""
    size, pixels = F, F
    for key, (metres, count) in fixed.RESOLUTIONS.items():
        size, pixels = size.when(scale == key, metres), pixels.when(scale == key, count)
    wrong = F.raise_error(F.concat(F.lit("unsupported scale: "), scale.cast("string"))).cast("int")
    return size.otherwise(wrong), pixels.otherwise(wrong)
