"""Streaming queries; each result equals its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r
from understory.sources.standin import Tables
from understory.streaming import jobs as J

DELAY = "3650 days"  # the tables are not in time order; a live feed would use days


def streamed(t: Tables) -> Tables:
    """The same views over a stream of the line table."""
    live = Tables(t.spark, t.folder)
    live.lineitem = J.file_stream(t.spark, f"{t.folder}/lineitem.parquet", t.lineitem.schema)
    return live


@query("stream_incremental_patches", "SELECT DISTINCT patch_num FROM footprints WHERE patch_num NOT IN (SELECT patch_num FROM pixels WHERE rh > 40)")
def stream_incremental_patches(t):
    arriving = streamed(t).footprints.select("patch_num", F.col("ts").cast("timestamp").alias("ts"))
    done = t.pixels.where(F.col("rh") > 40)
    found = J.new_items(arriving, done, "patch_num", "ts", DELAY)
    return t.spark.read.schema("patch_num long, late boolean").parquet(found).where("NOT late").select("patch_num")


@query("stream_monthly_mean", f"""SELECT px, year, month, {r('avg("VV")')} AS mean, count("VV") AS n FROM observations GROUP BY px, year, month""")
def stream_monthly_mean(t):
    arriving = streamed(t).observations.select("px", F.col("ts").cast("timestamp").alias("ts"), "VV")
    return rounded(J.monthly_mean(t.spark, J.daily_sums(arriving, "px", "ts", "VV", DELAY), "px"))
