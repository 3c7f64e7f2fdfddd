"""File listings: choosing, counting and classifying files by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from understory.functions.exprs import file_name, sample_hash
from understory.operators.bands import is_temporal_file

# Model markers in file names, first match wins.
MODEL_MARKERS = [("rf_", "rf"), ("mlp_", "mlp"), ("2dunet_", "2d_unet"), ("3dunet_", "3d_unet")]


def listing(spark: SparkSession, folder: str | list[str], glob: str = "*") -> DataFrame:
    """Path, size and time of files; contents are never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(folder).select("path", "modificationTime", "length"))


def first_files(files: DataFrame, keys: Sequence[str], k: int, path: str = "path") -> DataFrame:
    """First k paths of each group in name order; the rank limit prunes before the shuffle."""
    order = W.partitionBy(*keys).orderBy(path)
    return files.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")


def by_priority(files: DataFrame, key: str, patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Files matching the first pattern that has any hit, per key."""
    rank = F
    for i, p in enumerate(patterns):
        rank = rank.when(F.col(path).like(p), i)
    hits = files.withColumn("_p", rank.otherwise(None)).where(F.col("_p").isNotNull())
    best = hits.groupBy(key).agg(F.min("_p").alias("_best"))
    return (hits.join(best, key).where(F.col("_p") == F.col("_best")).drop("_p", "_best").distinct())


def pick_one(files: DataFrame, key: str, path: str = "path", number: str = "doc_id", seed: int = 42) -> DataFrame:
    """One file per key, chosen by seeded hash; a single aggregate, no sort."""
    h = sample_hash([number], seed)
    return files.groupBy(key).agg(F.min_by(path, F.struct(h, path)).alias(path))


def latest(files: DataFrame, pattern: str, path: str = "path", time: str = "modificationTime") -> DataFrame:
    return files.where(file_name(path).startswith(pattern)).agg(F.max_by(path, F.struct(time, path)).alias(path))


def model_type(path: Column | str) -> Column:
    name = file_name(path)
    out = F
    for marker, kind in MODEL_MARKERS:
        out = out.when(name.contains(marker), kind)
    return out.otherwise("unknown")


def run_inventory(files: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """Per run: model types seen, whether any patch is temporal, number of files of each kind."""
    kind = model_type(path)
    first = F.coalesce(*[F.max(F.when(kind == k, k)) for _, k in MODEL_MARKERS], F.lit("unknown"))
    return files.groupBy(run).agg(
        first.alias("model_type"), F.bool_or(is_temporal_file(path)).alias("temporal"),
        F.count(F.lit(1)).alias("n_files"), F.count_if(F.col(path).contains("prediction")).alias("n_predictions"),
        F.count_if(F.col(path).endswith(".csv")).alias("n_tables"))


