"""Scans of scenes, granules, point tables and areas of interest."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from understory.functions.exprs import region_name_of, region_of, file_name
from understory.operators.alignment import mask_points_in_bounds


def scan_scenes(scenes: DataFrame, start: str, end: str, px_low: int, px_high: int,
                mode: str = "IW", resolution: int = 10, pols: Sequence[str] = ("VV", "VH")) -> DataFrame:
    """Half-open dates, area, equal metadata and contained polarisations, all on raw columns."""
    keep = (F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    keep &= F.col("px").between(px_low, px_high) & (F.col("instrument_mode") == mode)
    keep &= F.col("resolution_meters") == resolution
    for p in pols:
        keep &= F.array_contains("pols", p)
    return scenes.where(keep)


def first_granules(granules: DataFrame, start: str, end: str, box: tuple[float, float, float, float], k: int | None = None) -> DataFrame:
    """The granules strictly inside the period whose bounds meet the box: all of them, or on request the first k."""
    x0, y0, x1, y1 = box
    hit = ((F.col("time_start") > F.lit(start).cast("timestamp_ntz")) & (F.col("time_end") < F.lit(end).cast("timestamp_ntz"))
           & (F.col("min_lon") <= x1) & (F.col("max_lon") >= x0) & (F.col("min_lat") <= y1) & (F.col("max_lat") >= y0))
    found = granules.where(hit)
    return found if k is None else found.orderBy("time_start", "granule_key").limit(k)


def granule_footprints(footprints: DataFrame, chosen: DataFrame, key: str = "granule_key") -> DataFrame:
    """Footprints of the chosen granules."""
    return footprints.join(chosen.select(key), key, "left_semi")


def read_point_tables(spark: SparkSession, folder: str, globs: Sequence[str], schema: str,
                      heights: Sequence[str], minimum: int = 2) -> DataFrame:
    """CSV files matching any pattern, with region and file name, missing columns as NULL.

    The schema is given, never inferred, and columns are bound by their names in each file's own header: files with one
    header are read together, in its order. A file whose header has none of the schema's columns fails the scan. Rows of a
    file count only when at least ``minimum`` of the height columns hold a value in it.
    """
    df = _by_header(spark, folder, globs, StructType.fromDDL(schema))
    df = df.withColumn("source_file", file_name(F.col("_path"))).drop("_path")
    region = region_of("source_file")
    df = df.withColumns({"region_code": region, "region_name": region_name_of(region)})
    held = df.groupBy("source_file").agg(*[F.count(h).alias(h) for h in heights])
    enough = held.where(sum((F.col(h) > 0).cast("int") for h in heights) >= minimum).select("source_file")
    return df.join(enough, "source_file", "left_semi")


def read_by_header(spark: SparkSession, folder: str, schema: str, globs: Sequence[str] = ("*.csv",)) -> DataFrame:
    """CSV files with their columns bound by the names in each file's header: order and further columns do not matter."""
    return _by_header(spark, folder, globs, StructType.fromDDL(schema)).drop("_path")


def _by_header(spark: SparkSession, folder: str, globs: Sequence[str], schema: StructType) -> DataFrame:
    """All CSV files below a folder that match a pattern; the driver sees one header and path for each file, never a row."""
    found = {"pathGlobFilter": "*.csv", "recursiveFileLookup": "true"}
    wanted = F.lit(False)
    for g in globs:
        wanted = wanted | file_name(F.col("path")).rlike(_glob_pattern(g))
    # Only the paths are asked for, so no content is read here; characters with a meaning in patterns stand for themselves.
    listed = spark.read.format("binaryFile").options(**found).load(folder).where(wanted).select("path")
    paths = [re.sub(r"([\\\[\]{}*?])", r"\\\1", row["path"]) for row in listed.toLocalIterator()]
    with ThreadPoolExecutor(8) as pool:
        headers = list(pool.map(lambda p: _header(spark, p), paths))
    files: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(paths, headers):
        if header is None:  # no line at all
            continue
        if not set(header) & set(schema.names):
            raise ValueError(f"no column of {schema.names} in the header of {path}: {header}")
        files.setdefault(header, []).append(path)
    out = spark.createDataFrame([], schema).withColumn("_path", F.lit(""))
    for header, paths in sorted(files.items()):
        # The first column of a name counts.
        kinds = StructType([schema[n] if n in schema.names and n not in header[:i] else StructField(f"_other_{i}", StringType())
                            for i, n in enumerate(header)])
        part = spark.read.schema(kinds).option("header", "true").csv(paths).select(
            *[n for n in schema.names if n in header], F.col("_metadata.file_path").alias("_path"))
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _header(spark: SparkSession, path: str) -> tuple[str, ...] | None:
    """The names in a file's first line that is not blank, whatever they are; no more of the file is read."""
    line = spark.read.text(path).where(F.trim("value") != "").first()
    return None if line is None else tuple(n.strip() for n in next(csv.reader([line["value"].removeprefix("\ufeff")])))


def _glob_pattern(glob: str) -> str:
    return "^" + glob.replace(".", r"\.").replace("*", ".*") + "$"


def training_points(points: DataFrame, target: str, features: Sequence[str] | None = None, mask: DataFrame | None = None,
                    keys: Sequence[str] = ("row", "col"), box: tuple[float, float, float, float] | None = None,
                    res: float | None = None, drop: Sequence[str] = ("longitude", "latitude")) -> DataFrame:
    """Feature columns and ``target``; with a mask only points on set cells of its box."""
    if features is None:
        features = [c for c in points.columns if c not in (target, *drop)]
    missing = [f for f in features if f not in points.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    rows = points
    if mask is not None:
        left, bottom, right, top = box
        rows = mask_points_in_bounds(points, mask, keys, left, bottom, right, top, res)
    return rows.select(*features, F.col(target).alias("target"))


def prediction_stack(stack: DataFrame, names: Sequence[str], keys: Sequence[str], mask: DataFrame | None = None) -> DataFrame:
    missing = [n for n in names if n not in stack.columns]
    if missing:
        raise ValueError(f"missing bands: {missing}")
    out = stack.select(*keys, *names)
    if mask is not None:
        out = out.join(mask.where(F.col("mask") == 1).select(*keys), list(keys), "left_semi")
    return out


def patch_data(px: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], size: int | None = None) -> DataFrame:
    """Bands and target of a patch: whole, or on request cropped to its first ``size`` cells a side."""
    rows = px if size is None else px.where((F.col("row") < size) & (F.col("col") < size))
    return rows.select(*keys, *features, F.col(target).alias("target"))


def read_aoi(spark: SparkSession, path: str) -> DataFrame:
    """Bounding box of a GeoJSON area: first feature of a collection, a polygon, or the first
    polygon of a multi-polygon. Anything else, or an empty collection, fails the job."""
    coords3 = "array<array<array<double>>>"
    raw = spark.read.text(path, wholetext=True)
    kind = F.get_json_object("value", "$.type")
    geometry = (F.when(kind == "FeatureCollection", F.get_json_object("value", "$.features[0].geometry"))
                .when(kind == "Feature", F.get_json_object("value", "$.geometry")).otherwise(F.col("value")))
    g = raw.select(geometry.alias("g")).select(
        F.get_json_object("g", "$.type").alias("t"), F.get_json_object("g", "$.coordinates").alias("c"),
        F.get_json_object("g", "$.coordinates[0]").alias("c0"))
    failed = F.raise_error(F.concat(F.lit("unsupported area: "), F.coalesce("t", F.lit("empty")))).cast(coords3)
    rings = (F.when(F.col("t") == "Polygon", F.from_json("c", coords3))
             .when(F.col("t") == "MultiPolygon", F.from_json("c0", coords3)).otherwise(failed))
    ring = F.get(rings, 0)
    lon, lat = F.transform(ring, lambda p: F.get(p, 0)), F.transform(ring, lambda p: F.get(p, 1))
    return g.select(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"),
                    F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"), F.size(ring).alias("n_points"))


def box_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """GeoJSON text of a closed rectangle."""
    ring = F.array(*[F.array(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
