"""Patch grids generated from bounds, and numbering of their cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions import fixed
from understory.functions.exprs import metres_per_degree_lon
from understory.operators.order import null_safe_keys, running_counts, value_counts


def _steps(extent: Column, stride: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(extent / stride)).cast("long")


#: Cells of a lattice that are made together.
BLOCK = 4096


def dealt_out(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt out before they are multiplied. The number is given, for few bytes here would be put into one task again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def stride_grid(boxes: DataFrame, size: float | Column, stride: float | Column) -> DataFrame:
    """Lattice of boxes covering each row's bounds. ``cell_no`` counts in generation order, x outside and y inside.

    A row becomes one row for each block of its cells; blocks are dealt out before they become cells, so that a
    single large box is made by all tasks.
    """
    size, stride = (F.lit(v) if isinstance(v, (int, float)) else v for v in (size, stride))
    nx = _steps(F.col("max_x") - F.col("min_x"), stride)
    ny = _steps(F.col("max_y") - F.col("min_y"), stride)
    counted = boxes.withColumns({"_nx": nx, "_ny": ny}).withColumn("_n", F.col("_nx") * F.col("_ny"))
    blocks = counted.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / BLOCK)))).withColumn("_b", F.col("_b") * BLOCK)
    cells = (dealt_out(blocks, "_b", "min_x", "min_y", "max_x", "max_y")
             .withColumn("cell_no", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + BLOCK, F.col("_n")) - 1)))
             .withColumns({"i": F.floor(F.col("cell_no") / F.col("_ny")), "j": F.col("cell_no") % F.col("_ny")}))
    x, y = F.col("min_x") + F.col("i") * stride, F.col("min_y") + F.col("j") * stride
    return cells.withColumns({"_x": x, "_y": y, "bound_x": F.col("max_x"), "bound_y": F.col("max_y")}).withColumns(
        {"min_x": F.col("_x"), "min_y": F.col("_y"), "max_x": F.col("_x") + size, "max_y": F.col("_y") + size}
    ).drop("_x", "_y", "_nx", "_ny", "_n", "_b")


def patch_grid(boxes: DataFrame, scale: int = 10, overlap: float = 0.1, size: int | None = None) -> DataFrame:
    """Metre grid with fractional overlap; boxes that pass the edge are marked and trimmed."""
    if scale not in fixed.RESOLUTIONS:
        raise ValueError(f"unsupported scale: {scale}")
    size = fixed.RESOLUTIONS[scale][0] if size is None else size
    cells = stride_grid(boxes, float(size), float(int(size * (1 - overlap))))
    over = (F.col("max_x") > F.col("bound_x")) | (F.col("max_y") > F.col("bound_y"))
    trimmed = lambda a: F.least(F.lit(float(size)), F.col(f"bound_{a}") - F.col(f"min_{a}"))
    return cells.withColumns({
        "is_extruded": over,
        "width": F.when(over, trimmed("x")).otherwise(float(size)),
        "height": F.when(over, trimmed("y")).otherwise(float(size))})


def pixel_aligned_grid(boxes: DataFrame, pixels: int = 256, scale: int = 10, overlap_pixels: int = 10) -> DataFrame:
    """Degree boxes of exact pixel size: stride in metres around half-stride centres, scaled
    back to degrees at the box's centre latitude. Bounds are min_x.. in degrees."""
    size, stride = float(pixels * scale), float(pixels * scale - overlap_pixels * scale)
    lon_m = metres_per_degree_lon((F.col("min_y") + F.col("max_y")) / 2)
    lat_m = F.lit(fixed.METRES_PER_DEGREE)
    metric = boxes.withColumn("_lon_m", lon_m).withColumns({
        "min_x": F.col("min_x") * F.col("_lon_m"), "max_x": F.col("max_x") * F.col("_lon_m"),
        "min_y": F.col("min_y") * lat_m, "max_y": F.col("max_y") * lat_m})
    cells = stride_grid(metric, size, stride)
    cx, cy = F.col("min_x") + 0.5 * stride, F.col("min_y") + 0.5 * stride
    out = cells.withColumns({"centre_x": cx, "centre_y": cy})
    lon, lat = F.col("centre_x") / F.col("_lon_m"), F.col("centre_y") / lat_m
    half_x, half_y = F.lit(size / 2) / F.col("_lon_m"), F.lit(size / 2) / lat_m
    return out.withColumns({"lon_min": lon - half_x, "lon_max": lon + half_x,
                            "lat_min": lat - half_y, "lat_max": lat + half_y}).drop("_lon_m")


def trimmed_grid(boxes: DataFrame, size: float, overlap_pixels: int = 10) -> DataFrame:
    """Edge-trimmed metre grid; the overlap assumes 10 m pixels."""
    cells = stride_grid(boxes, float(size), float(size - overlap_pixels * 10))
    return cells.withColumns({"max_x": F.least("max_x", "bound_x"), "max_y": F.least("max_y", "bound_y")})


def numbered(df: DataFrame, order: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """0-based position of each row in the order of a unique number, without one global sort."""
    rows, group = null_safe_keys(df, keys)
    place = running_counts(value_counts(rows.select(*group, F.col(order).alias("_o")), group, "_o"), group, "_o").select(
        *group, F.col("_o").alias(order), F.col("n_before").cast("long").alias(out))
    return rows.join(place, [*group, order]).drop("_all")


def pixel_window(x: str, y: str, width: str, height: str, scale: int = 10) -> list[Column]:
    return [(F.col(c) / scale).cast("int").alias(n)
            for c, n in ((x, "col_off"), (y, "row_off"), (width, "width_px"), (height, "height_px"))]
