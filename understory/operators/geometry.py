"""Polygons with rings as tables of edges, and which rectangles they meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

EDGE = ("x1", "y1", "x2", "y2")


def edges(polygons: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """``keys, x1, y1, x2, y2`` of every ring (arrays of x, y), closed where it is not; holes are rings like any other."""
    ring = polygons.select(*keys, F.explode(rings).alias("_r")).where(F.size("_r") > 1)
    follow = F.concat(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, 1))
    sides = ring.select(*keys, F.explode(F.arrays_zip(F.col("_r").alias("a"), follow.alias("b"))).alias("_e"))
    out = sides.select(*keys, *[F.get(f"_e.{p}", k).alias(n) for n, (p, k) in zip(EDGE, (("a", 0), ("a", 1), ("b", 0), ("b", 1)))])
    return out.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _tiles(low: Column, high: Column, tile: float) -> Column:
    return F.sequence(F.floor(low / tile), F.floor(high / tile))


def in_bands(sides: DataFrame, tile: float) -> DataFrame:
    """Edges once for each band ``_ty`` of tiles that they pass through."""
    return sides.withColumn("_ty", F.explode(_tiles(F.least("y1", "y2"), F.greatest("y1", "y2"), tile)))


def in_tiles(sides: DataFrame, tile: float) -> DataFrame:
    """Edges once for each tile ``_tx, _ty`` that they pass through, told band by band."""
    dy = F.col("y2") - F.col("y1")

    def x_at(y: Column) -> Column:
        share = F.least(F.greatest((y - F.col("y1")) / dy, F.lit(0.0)), F.lit(1.0))
        return F.col("x1") + (F.col("x2") - F.col("x1")) * share

    low, high = x_at(F.col("_ty") * tile), x_at((F.col("_ty") + 1) * tile)
    flat = dy == 0
    banded = in_bands(sides, tile).withColumns({"_a": F.when(flat, F.col("x1")).otherwise(low), "_b": F.when(flat, F.col("x2")).otherwise(high)})
    # Half a thousandth of a tile keeps edges that run along a tile's side in both tiles, whatever the rounding.
    margin = tile / 2000
    return banded.withColumn("_tx", F.explode(_tiles(F.least("_a", "_b") - margin, F.greatest("_a", "_b") + margin, tile))).drop("_a", "_b")


def edge_meets_box() -> Column:
    """Whether an edge and a closed box share a point: neither an axis nor the edge's own line parts them."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    side = [(F.col(x) - F.col("x1")) * dy - (F.col(y) - F.col("y1")) * dx for x in ("min_x", "max_x") for y in ("min_y", "max_y")]
    return ((F.least("x1", "x2") <= F.col("max_x")) & (F.greatest("x1", "x2") >= F.col("min_x"))
            & (F.least("y1", "y2") <= F.col("max_y")) & (F.greatest("y1", "y2") >= F.col("min_y"))
            & (F.least(*side) <= 0) & (F.greatest(*side) >= 0))


def edge_right_of_corner() -> Column:
    """Whether a ray to the right from the box's lower left corner crosses the edge."""
    y = F.col("min_y")
    at = F.col("x1") + (F.col("x2") - F.col("x1")) * ((y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    return ((F.col("y1") > y) != (F.col("y2") > y)) & (F.col("min_x") < at)


def boxes_on_polygons(boxes: DataFrame, sides: DataFrame, box_id: str, keys: Sequence[str], tile: float) -> DataFrame:
    """``box_id, keys``: boxes (``min_x, min_y, max_x, max_y``) that share a point with a polygon given by its edges.

    A box meets an edge in a common tile, or lies whole in the polygon or whole outside of it: then the number of
    edges to the right of its corner is odd or even (a hole's edges count too). ``tile`` should be about a box's size.
    """
    held = boxes.select(box_id, "min_x", "min_y", "max_x", "max_y")
    tiled = (held.withColumn("_tx", F.explode(_tiles(F.col("min_x"), F.col("max_x"), tile)))
             .withColumn("_ty", F.explode(_tiles(F.col("min_y"), F.col("max_y"), tile))))
    met = tiled.join(in_tiles(sides, tile), ["_tx", "_ty"]).where(edge_meets_box()).select(box_id, *keys).distinct()
    rowed = held.withColumn("_ty", F.floor(F.col("min_y") / tile))
    odd = (rowed.join(in_bands(sides, tile), "_ty").where(edge_right_of_corner()).groupBy(box_id, *keys)
           .agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(box_id, *keys))
    return met.union(odd).distinct()
