"""Queries for scalar functions: normalisation, indices, names, dates and patch grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import dates as D, exprs as X, fixed, names as NM
from understory.operators import alignment as A, grids as GR, patches as P
from understory.operators.metrics import stacked
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r

CELL = ["patch_num", "row", "col"]


@query("normalize_bands", f"""SELECT patch_num, row, col, {r('("S1_VV" + 25) / 25', 9)} AS "S1_VV", {r('"B8" / 10000', 9)} AS "B8", {r('"DEM" / 2000', 9)} AS "DEM", {r('slope / 50', 9)} AS slope,
 {r('(aspect - 180) / 180', 9)} AS aspect, {r('10 * log10("ALOS2_HH" * "ALOS2_HH") - 83', 9)} AS "ALOS2_HH", {r('ch_lang2022 / 50', 9)} AS ch_lang2022 FROM pixels""")
def normalize_bands(t):
    # Band type of each band.
    kinds = {"S1_VV": "sentinel1", "B8": "sentinel2", "DEM": "srtm_elevation", "slope": "srtm_slope",
             "aspect": "srtm_aspect", "ALOS2_HH": "alos2", "ch_lang2022": "canopy_height"}
    return rounded(t.pixels.select(*CELL, *[X.normalize(k, b).alias(b) for b, k in kinds.items()]), 9)


@query("normalize_by_name", f"""SELECT patch_num, row, col, {r('("S1_VH" + 25) / 25')} AS "S1_VH_M03", {r('greatest(0, least(1, "B8" / 10000))')} AS "B8",
 {r('greatest(-1, least(1, ("B8" - "B4") / nullif("B8" + "B4", 0)))')} AS "NDVI", {r('"ALOS2_HV"')} AS "ALOS2_HV", {r('coalesce(ch_tolan2024, 0)')} AS ch_tolan2024 FROM pixels""")
def normalize_by_name(t):
    px = t.pixels.withColumn("NDVI", X.normalized_difference("B8", "B4")).withColumnRenamed("S1_VH", "S1_VH_M03")
    return rounded(px.select(*CELL, *[X.normalize_by_name(b).alias(b) for b in ("S1_VH_M03", "B8", "NDVI", "ALOS2_HV", "ch_tolan2024")]))


@query("normalize_monthly", f"""WITH m AS (SELECT px, month, avg("VV") AS "S1_VV", avg("VH") AS "S1_VH", avg("B4") AS "S2_B4", avg("B8") AS "S2_B8", avg("HH") AS "ALOS2_HH" FROM observations GROUP BY px, month),
 s AS (SELECT px, CAST(range AS INT) AS month, unnest(['S1_VV', 'S1_VH', 'S2_B4', 'S2_B8', 'ALOS2_HH']) AS channel FROM (SELECT DISTINCT px FROM m), range(1, 13))
 SELECT s.px, s.month, channel, {r('''coalesce(CASE channel WHEN 'S1_VV' THEN ("S1_VV" + 25) / 25 WHEN 'S1_VH' THEN ("S1_VH" + 25) / 25 WHEN 'S2_B4' THEN "S2_B4" / 10000
  WHEN 'S2_B8' THEN "S2_B8" / 10000 ELSE 10 * log10("ALOS2_HH" * "ALOS2_HH") - 83 END, 0) + 1e-10''', 8)} AS value FROM s LEFT JOIN m ON m.px = s.px AND m.month = s.month""")
def normalize_monthly(t):
    from understory.operators.composite import monthly_availability
    renamed = t.observations.withColumnsRenamed({"VV": "S1_VV", "VH": "S1_VH", "B4": "S2_B4", "B8": "S2_B8", "HH": "ALOS2_HH"})
    kinds = {"S1_VV": "sentinel1", "S1_VH": "sentinel1", "S2_B4": "sentinel2", "S2_B8": "sentinel2", "ALOS2_HH": "alos2"}
    monthly = renamed.groupBy("px", "month").agg(*[X.normalize(k, F.avg(b)).alias(b) for b, k in kinds.items()])
    # the small offset keeps exact halves from rounding differently in two engines
    return rounded(monthly_availability(monthly, list(kinds)).select("px", "month", "channel", (F.col("value") + 1e-10).alias("value")), 8)


@query("ndvi", f"""SELECT obs_id, {r('("B8" - "B4") / nullif("B8" + "B4", 0)')} AS ndvi FROM observations""")
def ndvi(t):
    return rounded(t.observations.select("obs_id", X.normalized_difference("B8", "B4").alias("ndvi")))


@query("sar_linear_ratio", f"""WITH l AS (SELECT obs_id, pow(10, "VV" / 10) AS hh, pow(10, "VH" / 10) AS hv FROM observations)
 SELECT obs_id, {r('hh', 9)} AS hh, {r('hv', 9)} AS hv, {r('hh / hv')} AS ratio, {r('(hh - hv) / nullif(hh + hv, 0)')} AS ndri FROM l""")
def sar_linear_ratio(t):
    lin = t.observations.select("obs_id", X.from_db("VV").alias("hh"), X.from_db("VH").alias("hv"))
    return lin.select("obs_id", F.round("hh", 9).alias("hh"), F.round("hv", 9).alias("hv"),
                      F.round(F.try_divide("hh", "hv"), 6).alias("ratio"), F.round(X.normalized_difference("hh", "hv"), 6).alias("ndri"))


@query("cm_to_m", f"SELECT obs_id, {r('chm / 100')} AS height FROM observations")
def cm_to_m(t):
    return rounded(t.observations.select("obs_id", (F.col("chm") / 100.0).alias("height")))


@query("accuracy_columns", f"""SELECT fid, {r('abs(reference_height - rh)')} AS height_difference, abs(reference_height - rh) <= 5 AS height_agreement,
 {r('abs(reference_height - rh) / (reference_height + 1e-6)')} AS relative_error, {r('rh - reference_height')} AS bias FROM footprints""")
def accuracy_columns(t):
    return rounded(t.footprints.select("fid", *[c.alias(n) for n, c in X.agreement("reference_height", "rh").items()]))


STRETCH_SQL = "(CASE WHEN x > 0 THEN greatest(0, least(1, pow(x, 1.0::DOUBLE / 0.85::DOUBLE))) ELSE x END)"


@query("rgb_stretch", f"""WITH s AS (SELECT min("B4") AS lo, max("B4") * 0.85::DOUBLE AS hi FROM pixels WHERE "B4" > 0),
 a AS (SELECT patch_num, row, col, greatest(0, least(1, ("B4" - lo) / (hi - lo))) AS x0 FROM pixels, s),
 c AS (SELECT patch_num, row, col, greatest(0, least(1, 0.5::DOUBLE + 1.15::DOUBLE * (x0 - 0.5::DOUBLE))) AS x FROM a)
 SELECT patch_num, row, col, CAST(floor({STRETCH_SQL} * 255.0::DOUBLE) AS INT) AS red FROM c""")
def rgb_stretch(t):
    b = F.when(F.col("B4") > 0, F.col("B4"))
    span = t.pixels.agg(F.struct(F.min(b).alias("lo"), (F.max(b) * 0.85).alias("hi")).alias("x")).scalar()
    return t.pixels.select(*CELL, X.stretch("B4", span["lo"], span["hi"], 1.15, 0.85).alias("red"))


@query("rgb_stretch_reflectance", f"""SELECT patch_num, row, col, {r('(greatest(0.02::DOUBLE, least(0.3::DOUBLE, "B8" / 10000)) - 0.02::DOUBLE) / (0.3::DOUBLE - 0.02::DOUBLE)')} AS nir FROM pixels""")
def rgb_stretch_reflectance(t):
    return rounded(t.pixels.select(*CELL, ((X.clip(F.col("B8") / 10000.0, 0.02, 0.3) - 0.02) / (F.lit(0.3) - F.lit(0.02))).alias("nir")))


@query("bias_correct", f"SELECT fid, region_name, {r('rh / factor')} AS rh FROM footprints JOIN regions USING (region)")
def bias_correct(t):
    fp = A.with_region(t.footprints.select("fid", "region", "rh"), t.regions)
    return rounded(fp.select("fid", "region_name", (F.col("rh") / F.col("factor")).alias("rh")))


NAME = "list_extract(string_split(path, '/'), -1)"


@query("parse_patch_id", f"""SELECT path, CASE WHEN regexp_extract({NAME}, 'patch(\\d{{4}})', 1) <> '' THEN regexp_extract({NAME}, 'patch(\\d{{4}})', 1)
 ELSE regexp_replace({NAME}, '\\.[^.]*$', '') END AS patch_id FROM files""")
def parse_patch_id(t):
    return t.files.select("path", X.patch_id_of("path").alias("patch_id"))


REGION_SQL = "CASE WHEN contains(path, 'dchm_04hf3') THEN '04hf3' WHEN contains(path, 'dchm_05LE4') THEN '05LE4' WHEN contains(path, 'dchm_09gd4') THEN '09gd4' ELSE 'unknown' END"


@query("parse_region", f"""SELECT path, {REGION_SQL} AS region, CASE {REGION_SQL} WHEN '04hf3' THEN 'Kochi' WHEN '05LE4' THEN 'Hyogo' WHEN '09gd4' THEN 'Tochigi' ELSE 'Unknown' END AS region_name,
 nullif(regexp_extract({NAME}, '(dchm_[0-9A-Za-z]+)', 1), '') AS area_code FROM files""")
def parse_region(t):
    region = X.region_of("path")
    return t.files.select("path", region.alias("region"), X.region_name_of(region).alias("region_name"), X.area_code_of("path").alias("area_code"))


@query("format_names", """WITH w AS (SELECT run, list_sort(list(DISTINCT lang || '_' || (doc_id % 5))) AS names FROM files GROUP BY run)
 SELECT run, list_reduce(list_prepend('', names), lambda acc, x: CASE WHEN acc = '' THEN x WHEN length(list_extract(string_split(acc, chr(10)), -1)) + 2 + length(x) + 2 > 32 THEN acc || chr(10) || x ELSE acc || ', ' || x END) AS text FROM w""")
def format_names(t):
    # languages times five kinds bound the names of a run
    names = t.files.groupBy("run").agg(F.array_sort(F.collect_set(F.concat_ws("_", "lang", F.col("doc_id") % 5))).alias("names"))
    return names.select("run", NM.folded("names", 32).alias("text"))


@query("export_name", """SELECT path, 'gedi_embedding_' || regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[^.]*$', '') || '_NDVI30_b64_' || (2000 + doc_id % 25) || '_' || (size % 1000) || 'm_scale10m_w3_savg' AS export_name FROM files""")
def export_name(t):
    year, buffer = 2000 + F.col("doc_id") % 25, F.col("size") % 1000
    return t.files.select("path", NM.export_name("path", "NDVI", 0.3, 64, year, buffer, 10, 3, "savg").alias("export_name"))


@query("month_ranges", """WITH y AS (SELECT DISTINCT year FROM observations) SELECT year, CAST(range AS INT) AS month, make_date(year, CAST(range AS INT), 1) AS start_date,
 CAST(make_date(year, CAST(range AS INT), 1) + INTERVAL 1 MONTH AS DATE) AS end_date FROM y, range(1, 13)""")
def month_ranges(t):
    return D.month_ranges(t.observations.select("year").distinct(), "year")


@query("gedi_period", """SELECT fid, DATE '2019-01-01' + CAST(0 AS INT) AS period_start, DATE '2022-12-31' AS period_end, ts >= TIMESTAMP '2019-01-01' AND ts < TIMESTAMP '2022-12-31' AS inside FROM footprints""")
def gedi_period(t):
    start, end = D.gedi_period("01-01", "12-31")
    return t.footprints.select("fid", start.alias("period_start"), end.alias("period_end"), ((F.col("ts") >= start) & (F.col("ts") < end)).alias("inside"))


UTM = "CAST(trunc((longitude + 180.0::DOUBLE) / 6.0::DOUBLE) AS INT) + 1"


@query("utm_zone", f"""SELECT fid, CASE WHEN lat < -80 OR lat > 84 THEN 'EPSG:3857' WHEN lat >= 0 THEN 'EPSG:326' || lpad(CAST({UTM} AS VARCHAR), 2, '0') ELSE 'EPSG:327' || lpad(CAST({UTM} AS VARCHAR), 2, '0') END AS epsg
 FROM (SELECT fid, longitude, (latitude - 34.5::DOUBLE) * 180.0::DOUBLE AS lat FROM footprints)""")
def utm_zone(t):
    return t.footprints.select("fid", X.utm_epsg("longitude", (F.col("latitude") - 34.5) * 180.0).alias("epsg"))


@query("deg_to_m", f"SELECT fid, {r('longitude * (111320.0::DOUBLE * cos(radians(latitude)))', 4)} AS x_m, {r('latitude * 111320.0::DOUBLE', 4)} AS y_m FROM footprints")
def deg_to_m(t):
    return rounded(t.footprints.select("fid", (F.col("longitude") * X.metres_per_degree_lon("latitude")).alias("x_m"),
                                       (F.col("latitude") * fixed.METRES_PER_DEGREE).alias("y_m")), 4)


@query("resolution_config", """SELECT fid, scale, 2560 AS patch_m, CASE scale WHEN 10 THEN 256 WHEN 20 THEN 128 ELSE 85 END AS patch_px FROM (SELECT fid, CAST(num_detectedmodes * 10 AS INT) AS scale FROM footprints)""")
def resolution_config(t):
    scale = (F.col("num_detectedmodes") * 10).cast("int")
    size, pixels = NM.resolution(F.col("scale"))
    return t.footprints.select("fid", scale.alias("scale")).select("fid", "scale", size.alias("patch_m"), pixels.alias("patch_px"))


BOUNDS = "b AS (SELECT region, min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM patches GROUP BY region)"


def lattice(stride: str) -> str:
    return (f"g AS (SELECT b.*, i, j, x0 + i * {stride}::DOUBLE AS gx, y0 + j * {stride}::DOUBLE AS gy FROM b, (SELECT range AS i FROM range(200)), (SELECT range AS j FROM range(200)) "
            f"WHERE i < greatest(1, ceil((x1 - x0) / {stride}::DOUBLE)) AND j < greatest(1, ceil((y1 - y0) / {stride}::DOUBLE)))")


@query("patch_grid", f"""WITH {BOUNDS}, {lattice('576')} SELECT region, i, j, gx AS min_x, gy AS min_y, gx + 640 > x1 OR gy + 640 > y1 AS is_extruded,
 CASE WHEN gx + 640 > x1 OR gy + 640 > y1 THEN least(640.0::DOUBLE, x1 - gx) ELSE 640.0::DOUBLE END AS width,
 CASE WHEN gx + 640 > x1 OR gy + 640 > y1 THEN least(640.0::DOUBLE, y1 - gy) ELSE 640.0::DOUBLE END AS height FROM g""")
def patch_grid(t):
    return GR.patch_grid(P.bounds(t.patches, ["region"]), 10, 0.1, 640).select("region", "i", "j", "min_x", "min_y", "is_extruded", "width", "height")


@query("pixel_aligned_grid", f"""WITH b AS (SELECT region, min(longitude) AS l0, max(longitude) AS l1, min(latitude) AS a0, max(latitude) AS a1 FROM footprints GROUP BY region),
 m AS (SELECT *, 111320.0::DOUBLE * cos(radians((a0 + a1) / 2)) AS k FROM b), e AS (SELECT *, l0 * k AS x0, l1 * k AS x1, a0 * 111320.0::DOUBLE AS y0, a1 * 111320.0::DOUBLE AS y1 FROM m),
 g AS (SELECT e.*, i, j FROM e, (SELECT range AS i FROM range(200)), (SELECT range AS j FROM range(200)) WHERE i < greatest(1, ceil((x1 - x0) / 2460)) AND j < greatest(1, ceil((y1 - y0) / 2460)))
 SELECT region, i, j, {r('(x0 + (i + 0.5::DOUBLE) * 2460.0::DOUBLE) / k - 1280 / k')} AS lon_min, {r('(x0 + (i + 0.5::DOUBLE) * 2460.0::DOUBLE) / k + 1280 / k')} AS lon_max,
 {r('(y0 + (j + 0.5::DOUBLE) * 2460.0::DOUBLE) / 111320.0::DOUBLE - 1280 / 111320.0::DOUBLE')} AS lat_min, {r('(y0 + (j + 0.5::DOUBLE) * 2460.0::DOUBLE) / 111320.0::DOUBLE + 1280 / 111320.0::DOUBLE')} AS lat_max FROM g""")
def pixel_aligned_grid(t):
    boxes = t.footprints.groupBy("region").agg(F.min("longitude").alias("min_x"), F.max("longitude").alias("max_x"),
                                               F.min("latitude").alias("min_y"), F.max("latitude").alias("max_y"))
    return rounded(GR.pixel_aligned_grid(boxes).select("region", "i", "j", "lon_min", "lon_max", "lat_min", "lat_max"))


@query("fallback_grid", f"""WITH {BOUNDS}, {lattice('540')} SELECT region, i, j, gx AS min_x, gy AS min_y, least(gx + 640, x1) AS max_x, least(gy + 640, y1) AS max_y FROM g""")
def fallback_grid(t):
    return GR.trimmed_grid(P.bounds(t.patches, ["region"]), 640.0).select("region", "i", "j", "min_x", "min_y", "max_x", "max_y")


@query("patch_window", """SELECT patch_num, CAST(trunc(min_x / 10) AS INT) AS col_off, CAST(trunc(min_y / 10) AS INT) AS row_off, CAST(trunc((max_x - min_x) / 10) AS INT) AS width_px, CAST(trunc((max_y - min_y) / 10) AS INT) AS height_px FROM patches""")
def patch_window(t):
    px = t.patches.withColumns({"w": F.col("max_x") - F.col("min_x"), "h": F.col("max_y") - F.col("min_y")})
    return px.select("patch_num", *GR.pixel_window("min_x", "min_y", "w", "h"))


@query("export_area_ha", f"""SELECT region, CAST(round((max(longitude) - min(longitude)) * (111320.0::DOUBLE * cos(radians((min(latitude) + max(latitude)) / 2))) * ((max(latitude) - min(latitude)) * 111320.0::DOUBLE) / 10000) AS BIGINT) AS area_ha FROM footprints GROUP BY region""")
def export_area_ha(t):
    box = t.footprints.groupBy("region").agg(F.min("longitude").alias("x0"), F.max("longitude").alias("x1"),
                                             F.min("latitude").alias("y0"), F.max("latitude").alias("y1"))
    lon_m = X.metres_per_degree_lon((F.col("y0") + F.col("y1")) / 2)
    area = (F.col("x1") - F.col("x0")) * lon_m * ((F.col("y1") - F.col("y0")) * fixed.METRES_PER_DEGREE) / 10000.0
    return box.select("region", F.round(area).cast("long").alias("area_ha"))


@query("scale_prediction", f"SELECT patch_num, row, col, {r('pred * 1.3::DOUBLE', 9)} AS pred FROM pixels")
def scale_prediction(t):
    return rounded(t.pixels.select(*CELL, (F.col("pred") * 1.3).alias("pred")), 9)


@query("display_height_filter", f"""WITH v AS (SELECT patch_num, row, col, CASE WHEN reference_height > 0 AND reference_height <= 100 AND pred >= 0 AND pred <= 100 THEN reference_height END AS ref,
  CASE WHEN reference_height > 0 AND reference_height <= 100 AND pred >= 0 AND pred <= 100 THEN pred END AS pred FROM pixels)
 SELECT patch_num, row, col, {r('ref')} AS ref, {r('pred')} AS pred FROM (SELECT *, count(ref) OVER (PARTITION BY patch_num) AS n FROM v) WHERE n >= 100""")
def display_height_filter(t):
    ok = X.between("reference_height", 0, 100) & X.between("pred", 0, 100, low_open=False)
    shown = t.pixels.select(*CELL, F.when(ok, F.col("reference_height")).alias("ref"), F.when(ok, F.col("pred")).alias("pred"))
    enough = shown.groupBy("patch_num").agg(F.count("ref").alias("n")).where(F.col("n") >= 100).select("patch_num")
    return rounded(shown.join(enough, "patch_num", "left_semi"))


@query("unpivot_products", f"SELECT product, count(*) AS n, {r('avg(v)')} AS mean FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS product, {c} AS v FROM footprints WHERE {c} IS NOT NULL" for c in fixed.PRODUCT_COLUMNS) + ") GROUP BY product")
def unpivot_products(t):
    return rounded(stacked(t.footprints, [], fixed.PRODUCT_COLUMNS, "product", "v").groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean")))
