"""Spatial and noise augmentation as index arithmetic on (row, col)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.exprs import height_class
from understory.operators.resample import resize_crops
from understory.session import written


def _turn(row: Column, col: Column, turns: Column, size: int) -> tuple[Column, Column]:
    """Position after quarter turns counter-clockwise on a square grid."""
    last = F.lit(size - 1)
    new_row = F.when(turns == 1, last - col).when(turns == 2, last - row).when(turns == 3, col).otherwise(row)
    new_col = F.when(turns == 1, row).when(turns == 2, last - col).when(turns == 3, last - row).otherwise(col)
    return new_row, new_col


def spatial(df: DataFrame, size: int, ids: Sequence[int] = tuple(range(12))) -> DataFrame:
    """Copies of every cell: id 0 is the original, the others a flip (columns, rows, both)
    followed by 0 to 3 quarter turns. Features and target move together."""
    a = F.col("augment_id")
    flip = F.when(a == 0, 0).otherwise((a - 1) % 3 + 1)
    turns = F.when(a == 0, 0).otherwise(F.floor((a - 1) / 3))
    copies = df.withColumn("augment_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    last = F.lit(size - 1)
    row = F.when(flip.isin(2, 3), last - F.col("row")).otherwise(F.col("row"))
    col = F.when(flip.isin(1, 3), last - F.col("col")).otherwise(F.col("col"))
    new_row, new_col = _turn(row, col, turns, size)
    return copies.withColumns({"row": new_row.cast("int"), "col": new_col.cast("int")})


def legacy(df: DataFrame, values: Sequence[str], keys: Sequence[str], size: int, crops: int = 4,
           share: float = 0.9, seed: int = 42, min_crop_size: int = 224) -> DataFrame:
    """Original, three quarter turns and two flips; from ``min_crop_size`` cells a side also
    seeded 90 % crops resized back."""
    if size >= min_crop_size:
        df = written(df.select(*keys, "row", "col", *values), "augment-cells")  # copies and crops read it
    kinds = ["original", "turn_1", "turn_2", "turn_3", "flip_h", "flip_v"]
    copies = df.select(*keys, "row", "col", *values, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"))
    turns = F.when(F.col("kind").startswith("turn"), F.substring("kind", 6, 1).try_cast("int")).otherwise(0)
    row, col = _turn(F.col("row"), F.col("col"), turns, size)
    last = F.lit(size - 1)
    out = copies.withColumns({
        "row": F.when(F.col("kind") == "flip_v", last - F.col("row")).otherwise(row).cast("int"),
        "col": F.when(F.col("kind") == "flip_h", last - F.col("col")).otherwise(col).cast("int")})
    if size < min_crop_size:
        return out
    side = int(size * share)
    off = [tuple(F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed + 2 * i + j)), F.lit(size - side + 1)) for j in (0, 1))
           for i in range(crops)]
    made = resize_crops(df, values, keys, side, size, off).withColumnsRenamed({"t_row": "row", "t_col": "col"})
    return out.unionByName(made.withColumn("kind", F.concat(F.lit("crop_"), F.col("crop_no"))).drop("crop_no"))


def noise_copies(df: DataFrame, features: Sequence[str], value: str, copies: int = 2, deviation: float = 0.05,
                 rare_share: float = 0.1, first_rare_class: int = 5, seed: int = 42) -> DataFrame:
    """Rows of rare tall classes get noisy copies (copy 0 is the row itself)."""
    rows = df.withColumn("class_no", height_class(value))
    counts = rows.groupBy("class_no").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c")).scalar()
    rare = counts.select("class_no", ((F.col("class_no") >= first_rare_class)
                                      & (F.col("_c") < total * rare_share)).alias("_rare"))
    marked = rows.join(F.broadcast(rare), "class_no")  # at most nine classes
    out = marked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_rare"), copies).otherwise(0))))
    return out.withColumns({f: F.when(F.col("copy") == 0, F.col(f)).otherwise(
        F.col(f) + F.randn(seed + i) * deviation) for i, f in enumerate(features)}).drop("_rare")


def over_months(df: DataFrame, months: int = 12) -> DataFrame:
    """A static patch repeated over the months."""
    return df.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))


def months_from_bands(df: DataFrame, array: str, keep: Sequence[str], months: int = 12) -> DataFrame:
    """Flat band arrays as (channel, month, value); a last channel with fewer months is filled up with NULL."""
    missing = F.array_repeat(F.lit(None), F.pmod(-F.size(array), F.lit(months)))
    return (df.select(*keep, F.posexplode(F.concat(array, missing)).alias("_p", "value"))
            .select(*keep, F.floor(F.col("_p") / months).cast("int").alias("channel"),
                    (F.col("_p") % months + 1).alias("month"), "value"))


def padded(array: str, channels: int) -> Column:
    """Exactly ``channels`` entries: cut or filled with zeros."""
    a = F.col(array)
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(channels) - F.size(a)))
    return F.slice(F.concat(a.cast("array<double>"), zeros), 1, channels)


