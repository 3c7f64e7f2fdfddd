"""Sinks. Each writes with Spark's own writers and returns the path it wrote."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from understory.session import new_path, shared_dir
from understory.sources.listing import listing

# Height quantiles by preference.
HEIGHT_PREFERENCE = ["rh100", "rh98", "rh95", "rh90", "rh"]


def exported_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Coordinates and the first height quantile present; incomplete points are dropped."""
    present = [c for c in HEIGHT_PREFERENCE if c in df.columns]
    return (df.select(lon, lat, F.coalesce(*present).alias("rh")).dropna())


def write_points_csv(df: DataFrame, label: str = "points") -> str:
    path = new_path(df.sparkSession, label)
    df.write.option("header", "true").csv(path)
    return path


def geojson_lines(df: DataFrame, lon: str, lat: str, properties: Sequence[str]) -> DataFrame:
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"),
        F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, lon: str, lat: str, properties: Sequence[str], label: str = "geojson") -> str:
    path = new_path(df.sparkSession, label)
    geojson_lines(df, lon, lat, properties).write.text(path)
    return path


def write_training_csv(df: DataFrame, bands: Sequence[str]) -> str:
    """A folder of CSV whose name carries the number of bands and of rows; rows are counted while they are written."""
    seen = Observation()
    path = write_points_csv(df.observe(seen, F.count(F.lit(1)).alias("n")), f"training-b{len(bands)}")
    parent, name = path.rsplit("/", 1)
    named = f"{parent}/{name.replace('-b', f'-n{seen.get['n']}-b', 1)}"
    place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path
    source = place(path)
    if not source.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).rename(source, place(named)):
        raise OSError(f"cannot rename {path} to {named}")
    return named


def filled_grid(grid: DataFrame, preds: DataFrame, keys: Sequence[str], value: str = "pred") -> DataFrame:
    """Predictions scattered over the full grid, 0 where there is none."""
    return grid.select(*keys).join(preds.select(*keys, value), list(keys), "left").withColumn(
        value, F.coalesce(value, F.lit(0.0)))


def write_patches(df: DataFrame, patch: str = "patch_id", label: str = "patches") -> str:
    """One folder per patch. Rebalancing by patch lets adaptive execution merge small patches
    into one task and cut a patch that holds most rows over several."""
    path = new_path(df.sparkSession, label)
    df.hint("rebalance", patch).write.partitionBy(patch).parquet(path)
    return path


def write_json(df: DataFrame, label: str = "metrics") -> str:
    path = new_path(df.sparkSession, label)
    df.write.json(path)
    return path


def data_version(spark: SparkSession, paths: Sequence[str]) -> str:
    """A name for the present state of files or folders, from names, times and sizes; contents are not read."""
    if not paths:
        return ""
    files = listing(spark, list(paths))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{row['h']}"


def materialized(spark: SparkSession, name: str, params: dict, build: Callable[[], DataFrame], inputs: Sequence[str] = ()) -> DataFrame:
    """Table cached under a path made from its parameters and the state of its ``inputs``; built only when no finished copy exists."""
    version = data_version(spark, inputs)
    key = hashlib.sha256(json.dumps([params, version], sort_keys=True).encode()).hexdigest()[:16]
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{key}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")
