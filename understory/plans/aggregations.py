"""Queries for composites, mosaics and patch catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.operators import composite as Q, patches as P
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r

CELL3 = ["region", "row", "col"]


@query("composite_median", f"""SELECT px, {r('quantile_cont("VV", 0.5)')} AS "VV", {r('quantile_cont("VH", 0.5)')} AS "VH" FROM observations
 WHERE ts >= DATE '1997-01-01' AND ts < DATE '1999-01-01' GROUP BY px""")
def composite_median(t):
    return rounded(Q.median_composite(Q.in_period(t.observations, "1997-01-01", "1999-01-01"), ["VV", "VH"]))


def month_sql(agg: str, bands, default: str | None = None, digits: int = 6) -> str:
    cells = ", ".join(
        r(f'{"coalesce(" if default else ""}max(CASE WHEN month = {m} THEN "{b}" END){f", {default})" if default else ""}', digits) + f' AS "{b}_M{m:02d}"'
        for b in bands for m in Q.MONTHS)
    aggs = ", ".join(f'{agg.format(b=b)} AS "{b}"' for b in bands)
    return f"WITH m AS (SELECT px, month, {aggs} FROM observations GROUP BY px, month) SELECT px, {cells} FROM m GROUP BY px"


@query("composite_monthly", month_sql('quantile_cont("{b}", 0.5)', ["VV", "VH"]))
def composite_monthly(t):
    return rounded(Q.month_columns(Q.monthly_values(t.observations, ["VV", "VH"]), ["VV", "VH"]))


@query("composite_monthly_mean", month_sql('avg("{b}")', ["B4", "B8"], digits=7))
def composite_monthly_mean(t):
    return rounded(Q.month_columns(Q.monthly_values(t.observations, ["B4", "B8"], how="mean"), ["B4", "B8"]), 7)


@query("composite_month_default", month_sql('avg("{b}")', ["HH", "HV"], "0"))
def composite_month_default(t):
    return rounded(Q.month_columns(Q.monthly_values(t.observations, ["HH", "HV"], how="mean"), ["HH", "HV"], default=0.0))


@query("monthly_availability", f"""WITH m AS (SELECT px, month, avg("VV") AS "VV", avg("HV") AS "HV" FROM observations GROUP BY px, month),
 l AS (SELECT px, month, 'VV' AS channel, "VV" AS v FROM m UNION ALL SELECT px, month, 'HV', CASE WHEN "HV" <> 0 THEN "HV" END FROM m),
 s AS (SELECT px, c.channel, mm.month FROM (SELECT DISTINCT px FROM m), (VALUES ('VV'), ('HV')) c(channel), (SELECT CAST(range AS INT) AS month FROM range(1, 13)) mm)
 SELECT s.px, s.month, s.channel, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS available, {r('coalesce(v, 0)')} AS value
 FROM s LEFT JOIN l ON s.px = l.px AND s.month = l.month AND s.channel = l.channel""")
def monthly_availability(t):
    monthly = Q.monthly_values(t.observations, ["VV", "HV"], how="mean")
    return rounded(Q.monthly_availability(monthly, ["VV", "HV"], ["HV"]))


@query("multi_year_median", f"""WITH y AS (SELECT px, year, quantile_cont("HH", 0.5) AS hh FROM observations
  WHERE year < (SELECT max(year) FROM observations) AND year >= (SELECT max(year) FROM observations) - 3 GROUP BY px, year)
 SELECT px, {r('quantile_cont(hh, 0.5)')} AS "HH" FROM y GROUP BY px""")
def multi_year_median(t):
    return rounded(Q.multi_year_median(t.observations, ["HH"]))


@query("mosaic_latest", f"""SELECT px, {r('arg_max("B8A", (ts, obs_id))')} AS "B8A" FROM observations WHERE "B8A" IS NOT NULL GROUP BY px""")
def mosaic_latest(t):
    return rounded(Q.latest_mosaic(t.observations, "B8A", ["ts", "obs_id"], ["px"]))


ORDER = ["patch_num", "patch_order"]


@query("merge_mosaic", f"""WITH v AS (SELECT region, row, col, patch_num, patch_order, CASE WHEN pred <> 0 THEN pred END AS v FROM predictions)
 SELECT region, row, col, {r('coalesce(arg_min(v, (patch_num, patch_order)) FILTER (WHERE v IS NOT NULL), 0)', 9)} AS first,
 {r('coalesce(arg_max(v, (patch_num, patch_order)) FILTER (WHERE v IS NOT NULL), 0)', 9)} AS last, {r('coalesce(min(v), 0)', 9)} AS min,
 {r('coalesce(max(v), 0)', 9)} AS max, {r('coalesce(avg(v), 0)', 9)} AS average, count(v) AS n_valid FROM v GROUP BY region, row, col""")
def merge_mosaic(t):
    return rounded(Q.mosaic(t.predictions, "pred", ORDER, CELL3), 9)


@query("merge_arrays", f"SELECT region, row, col, {r('avg(pred)', 9)} AS pred FROM predictions GROUP BY region, row, col")
def merge_arrays(t):
    return rounded(Q.merge_with_nulls(t.predictions, "pred", ORDER, CELL3, "average"), 9)


@query("merge_files_basic", f"""SELECT region, row, col, {r('arg_min(pred, (patch_num, patch_order)) FILTER (WHERE pred IS NOT NULL)')} AS pred FROM predictions GROUP BY region, row, col""")
def merge_files_basic(t):
    return rounded(Q.merge_with_nulls(t.predictions, "pred", ORDER, CELL3, "first"))


@query("merge_overwrite", f"""SELECT region, row, col, {r('coalesce(arg_max(pred, (patch_num, patch_order)) FILTER (WHERE pred IS NOT NULL), 0)')} AS pred FROM predictions
 WHERE patch_num % 10 <> 9 GROUP BY region, row, col""")
def merge_overwrite(t):
    return rounded(Q.merge_overwriting(t.predictions, "pred", ORDER, CELL3, F.col("patch_num") % 10 == 9))


@query("output_grid", """SELECT region, min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y, min(pixel_size) AS pixel_size,
 CAST(floor((max(max_x) - min(min_x)) / min(pixel_size)) AS INT) AS width, CAST(floor((max(max_y) - min(min_y)) / min(pixel_size)) AS INT) AS height FROM patches GROUP BY region""")
def output_grid(t):
    return P.output_grid(t.patches, ["region"])


@query("patch_consistency", """SELECT count(DISTINCT crs) = 1 AS same_crs, abs(max(pixel_size) - arg_min(pixel_size, patch_num)) < 1 AND
 abs(min(pixel_size) - arg_min(pixel_size, patch_num)) < 1 AS same_resolution, count(DISTINCT temporal) = 1 AS same_mode, count(DISTINCT band_count) = 1 AS same_bands FROM patches""")
def patch_consistency(t):
    return P.consistency(t.patches)


@query("patch_summary", f"""SELECT region, count(*) AS total, count(*) FILTER (WHERE temporal) AS temporal, count(*) FILTER (WHERE NOT temporal) AS non_temporal,
 min(min_x) AS min_x, min(min_y) AS min_y, max(max_x) AS max_x, max(max_y) AS max_y,
 {r('(max(max_x) - min(min_x)) * (max(max_y) - min(min_y)) / 1e6')} AS area_km2 FROM patches GROUP BY region""")
def patch_summary(t):
    return rounded(P.summary(t.patches, ["region"]))


@query("validate_patches", f"""SELECT patch_num, count(*) FILTER (WHERE rh > 0) AS n_valid, count(*) AS n_total, {r('count(*) FILTER (WHERE rh > 0) * 100.0 / count(*)')} AS coverage,
 {r('coalesce(min(rh) FILTER (WHERE rh > 0), 0)')} AS target_min, {r('coalesce(max(rh) FILTER (WHERE rh > 0), 0)')} AS target_max FROM pixels GROUP BY ROLLUP (patch_num)""")
def validate_patches(t):
    return rounded(P.validation(t.pixels, "rh"))


@query("validate_patches_totals", f"""SELECT count(*) AS total_patches, CAST(sum(v) AS BIGINT) AS total_valid, {r('avg(v)')} AS average_per_patch
 FROM (SELECT count(*) FILTER (WHERE rh > 0) AS v FROM pixels GROUP BY patch_num)""")
def validate_patches_totals(t):
    return rounded(P.validation_totals(t.pixels, "rh"))


@query("gedi_stats", f"""SELECT region, {r('min(rh)')} AS min_rh, {r('max(rh)')} AS max_rh, {r('avg(rh)')} AS mean_rh, {r('stddev_pop(rh)')} AS std_rh, count(rh) AS n FROM footprints GROUP BY region""")
def gedi_stats(t):
    return rounded(t.footprints.groupBy("region").agg(
        F.min("rh").alias("min_rh"), F.max("rh").alias("max_rh"), F.avg("rh").alias("mean_rh"),
        F.stddev_pop("rh").alias("std_rh"), F.count("rh").alias("n")))
