"""Queries for scans, listings and sinks. Sinks are read back, so what was written is checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import fixed
from understory.operators import patches as P, training as T
from understory.plans.joins import LOCATED
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r
from understory.plans.warps import unproject_sql
from understory.sources import listing as L, scans as S, sinks as K

CELL = ["patch_num", "row", "col"]
RES = 1 / 64


@query("scan_scenes", """SELECT event_id, scene_id, px, value FROM scenes WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND px BETWEEN 10 AND 120
 AND instrument_mode = 'IW' AND resolution_meters = 10 AND list_contains(pols, 'VV') AND list_contains(pols, 'VH')""")
def scan_scenes(t):
    return S.scan_scenes(t.scenes, "2024-01-05", "2024-01-20", 10, 120).select("event_id", "scene_id", "px", "value")


@query("scan_granules", f"""WITH g AS (SELECT granule_key FROM granules WHERE time_start > TIMESTAMP '1996-01-01' AND time_end < TIMESTAMP '2001-06-01' AND min_lon <= 134.8 AND max_lon >= 134.2
   AND min_lat <= 34.9 AND max_lat >= 34.1)
 SELECT fid, granule_key, {r('rh')} AS rh FROM footprints WHERE granule_key IN (SELECT granule_key FROM g)""")
def scan_granules(t):
    chosen = S.first_granules(t.granules, "1996-01-01", "2001-06-01", (134.2, 34.1, 134.8, 34.9))
    return rounded(S.granule_footprints(t.footprints.select("fid", "granule_key", "rh"), chosen).select("fid", "granule_key", "rh"))


@query("catalog_patches", f"""WITH c AS (SELECT patch_num, patch_id, count(*) AS n_pixels, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM pixels GROUP BY ALL),
 b AS (SELECT patch_num, patch_id, n_pixels, 134.0::DOUBLE + patch_num * 640.0::DOUBLE + c0 * 10.0::DOUBLE AS min_x, 134.0::DOUBLE + patch_num * 640.0::DOUBLE + (c1 + 1) * 10.0::DOUBLE AS max_x,
   35.0::DOUBLE - (r1 + 1) * 10.0::DOUBLE AS min_y, 35.0::DOUBLE - r0 * 10.0::DOUBLE AS max_y FROM c)
 SELECT *, (min_x + max_x) / 2 AS centre_x, (min_y + max_y) / 2 AS centre_y, greatest(max_x - min_x, max_y - min_y) AS side FROM b""")
def catalog_patches(t):
    return P.catalogue(t.pixels, 134.0, 35.0, 10.0)


POINT_SCHEMA = "fid string, region string, rh double, reference_height double, ch_lang2022 double"


@query("scan_footprint_csvs", f"""SELECT fid, region AS region_code, CASE region WHEN '04hf3' THEN 'Kochi' WHEN '05LE4' THEN 'Hyogo' ELSE 'Tochigi' END AS region_name, {r('rh')} AS rh, {r('reference_height')} AS reference_height FROM footprints""")
def scan_footprint_csvs(t):
    cols = ["fid", "region", "rh", "reference_height", "ch_lang2022"]
    folder = K.write_points_csv(t.footprints.select(*cols), "gedi_dchm_points_reference")
    df = S.read_point_tables(t.spark, folder, ["*.csv"], POINT_SCHEMA, ["rh", "reference_height", "ch_lang2022"])
    named = df.withColumn("region_code", F.col("region"))
    from understory.functions.exprs import region_name_of
    return rounded(named.select("fid", "region_code", region_name_of("region").alias("region_name"), "rh", "reference_height"))


@query("scan_training_csv", f"""WITH {LOCATED} SELECT fid, {r('rh')} AS target FROM pts WHERE longitude BETWEEN 134 AND 135 AND latitude BETWEEN 34 AND 35
 AND (row, col) IN (SELECT (row, col) FROM reference_cells WHERE region = '05LE4' AND mask = 1)""")
def scan_training_csv(t):
    folder = K.write_points_csv(t.footprints.select("latitude", "beam", "fid", "longitude", "rh"), "training-points")
    points = S.read_by_header(t.spark, folder, "fid string, rh double, longitude double, latitude double")
    mask = t.reference_cells.where(F.col("region") == "05LE4")
    return rounded(S.training_points(points, "rh", ["fid"], mask, box=(134.0, 34.0, 135.0, 35.0), res=RES))


@query("scan_prediction_stack", f"""SELECT patch_num, row, col, {r('"B4"')} AS "B4", {r('"DEM"')} AS "DEM" FROM pixels WHERE forest_mask = 1""")
def scan_prediction_stack(t):
    mask = t.pixels.select(*CELL, F.col("forest_mask").cast("int").alias("mask"))
    return rounded(S.prediction_stack(t.pixels, ["B4", "DEM"], CELL, mask))


@query("load_patches_dir", f"""SELECT patch_id, count(*) AS n, {r('avg("B4")')} AS mean_b4, {r('avg(reference_height)')} AS mean_target FROM pixels GROUP BY patch_id""")
def load_patches_dir(t):
    folder = K.write_patches(t.pixels.select("patch_id", "row", "col", "B4", "reference_height"))
    px = t.spark.read.schema("row int, col int, B4 double, reference_height double, patch_id string").parquet(folder)
    return rounded(px.groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"), F.avg("B4").alias("mean_b4"),
                                              F.avg("reference_height").alias("mean_target")))


@query("load_patch", f"""SELECT patch_num, row, col, {r('"B4"')} AS "B4", {r('"S1_VV"')} AS "S1_VV", {r('reference_height')} AS target FROM pixels""")
def load_patch(t):
    return rounded(S.patch_data(t.pixels, ["B4", "S1_VV"], "reference_height", CELL))


@query("load_aoi", f"""SELECT {r('min(longitude)')} AS min_lon, {r('min(latitude)')} AS min_lat, {r('max(longitude)')} AS max_lon, {r('max(latitude)')} AS max_lat, 5 AS n_points FROM footprints""")
def load_aoi(t):
    from understory.session import new_path
    path = new_path(t.spark, "aoi")
    extent(t.footprints).coalesce(1).write.text(path)  # a single row
    return rounded(S.read_aoi(t.spark, path))


def extent(points, *keys):
    return points.groupBy(*keys).agg(S.box_polygon(F.min("longitude"), F.min("latitude"), F.max("longitude"), F.max("latitude")).alias("value"))


@query("extent_to_aoi", f"""WITH e AS (SELECT region, min(longitude) AS x0, min(latitude) AS y0, max(longitude) AS x1, max(latitude) AS y1 FROM footprints GROUP BY region)
 SELECT region, {r('x0')} AS x0, {r('y0')} AS y0, {r('x1')} AS x1, {r('y1')} AS y1, 'Polygon' AS kind FROM e""")
def extent_to_aoi(t):
    made = extent(t.footprints, "region")
    ring = F.get(F.from_json(F.get_json_object("value", "$.coordinates"), "array<array<array<double>>>"), 0)
    return rounded(made.select("region", F.get_json_object("value", "$.type").alias("kind"), ring.alias("g")).select(
        "region", "kind", F.get(F.get("g", 0), 0).alias("x0"), F.get(F.get("g", 0), 1).alias("y0"),
        F.get(F.get("g", 2), 0).alias("x1"), F.get(F.get("g", 2), 1).alias("y1")))


POINTS_SQL = f"SELECT {r('longitude')} AS longitude, {r('latitude')} AS latitude, {r('ch_tolan2024')} AS rh FROM footprints WHERE ch_tolan2024 IS NOT NULL"


def exported(t):
    return K.exported_points(t.footprints.select("longitude", "latitude", F.col("ch_tolan2024").alias("rh98")))


@query("sink_points_csv", POINTS_SQL)
def sink_points_csv(t):
    path = K.write_points_csv(exported(t))
    return rounded(t.spark.read.schema("longitude double, latitude double, rh double").option("header", "true").csv(path))


@query("sink_points_geojson", POINTS_SQL)
def sink_points_geojson(t):
    path = K.write_geojson(exported(t), "longitude", "latitude", ["rh"])
    schema = "geometry struct<coordinates: array<double>>, properties struct<rh: double>"
    back = t.spark.read.schema(schema).json(path)
    return rounded(back.select(F.get("geometry.coordinates", 0).alias("longitude"), F.get("geometry.coordinates", 1).alias("latitude"), F.col("properties.rh").alias("rh")))


@query("sink_training_csv", f"""SELECT patch_num, count(*) AS n, {r('avg(rh)')} AS mean_target, sum(count(*)) OVER ()::BIGINT AS n_named FROM pixels WHERE rh > 0 GROUP BY patch_num""")
def sink_training_csv(t):
    bands = ["B4", "B8"]
    path = K.write_training_csv(T.sparse_pixels(t.pixels, "rh").select("patch_num", *bands, "rh"), bands)
    back = t.spark.read.schema("patch_num long, B4 double, B8 double, rh double").option("header", "true").csv(path)
    named = F.regexp_extract(F.lit(path), r"training-n(\d+)-b2", 1).cast("long")
    return rounded(back.groupBy("patch_num").agg(F.count(F.lit(1)).alias("n"), F.avg("rh").alias("mean_target")).withColumn("n_named", named))


@query("sink_predictions", f"""SELECT patch_id, row, col, {r('CASE WHEN forest_mask = 1 THEN coalesce(pred, 0) ELSE 0 END')} AS pred FROM pixels""")
def sink_predictions(t):
    keys = ["patch_id", "row", "col"]
    preds = t.pixels.where((F.col("forest_mask") == 1) & F.col("pred").isNotNull())
    path = K.write_patches(K.filled_grid(t.pixels, preds, keys), label="predictions")
    return rounded(t.spark.read.schema("row int, col int, pred double, patch_id string").parquet(path).select(*keys, "pred"))


@query("sink_metrics_json", f"SELECT region, count(*) AS n, {r('avg(abs(rh - reference_height))')} AS mae FROM footprints GROUP BY region")
def sink_metrics_json(t):
    from understory.operators.metrics import regression_metrics
    path = K.write_json(regression_metrics(t.footprints, "rh", "reference_height", ["region"]))
    return rounded(t.spark.read.schema("region string, n long, mae double").json(path))


CENTRED = "(SELECT *, (min_x + max_x) / 2 AS mid_x, (min_y + max_y) / 2 AS mid_y, 32653 AS code FROM patches)"


@query("sink_patch_summary", f"""WITH c AS ({unproject_sql(CENTRED, 'mid_x', 'mid_y', 'code', 'lon', 'lat')})
 SELECT patch_id, 'outputs/' || region || '/' || patch_id || '.tif' AS file_path, temporal AS temporal_mode, band_count, max_x - min_x AS patch_size_m, pixel_size AS pixel_size_m,
 CAST((max_x - min_x) / pixel_size AS INT) AS width, CAST((max_y - min_y) / pixel_size AS INT) AS height, {r('lon')} AS center_lon, {r('lat')} AS center_lat,
 min_x, min_y, max_x, max_y, crs FROM c""")
def sink_patch_summary(t):
    from understory.operators.patches import summary_rows
    made = summary_rows(t.patches, F.concat(F.lit("outputs/"), "region", F.lit("/"), "patch_id", F.lit(".tif")))
    path = K.write_points_csv(made, "patch-summary")
    return rounded(t.spark.read.schema(made.schema).option("header", "true").csv(path))


@query("sink_patches", "SELECT 'area_patch_' || lpad(CAST(patch_num AS VARCHAR), 4, '0') AS patch_id, count(*) AS n FROM pixels GROUP BY patch_num")
def sink_patches(t):
    px = t.pixels.select(F.format_string("area_patch_%04d", "patch_num").alias("patch_id"), "row", "col", "B4")
    path = K.write_patches(px)
    return t.spark.read.schema("row int, col int, B4 double, patch_id string").parquet(path).groupBy("patch_id").agg(F.count(F.lit(1)).alias("n"))


LATEST = ["rf_", "mlp_", "dchm_", "none_"]


@query("latest_file", " UNION ALL ".join(
    f"SELECT '{p}' AS prefix, arg_max(path, (size % 500, path)) AS path FROM files WHERE starts_with(regexp_extract(path, '[^/]*$'), '{p}')" for p in LATEST))
def latest_file(t):
    """The newest file of each prefix; of equal times the last by name."""
    files = t.files.select("path", F.timestamp_seconds(F.col("size") % 500).alias("modificationTime"))
    found = [L.latest(files, p).select(F.lit(p).alias("prefix"), "path") for p in LATEST]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@query("materialize_features", f"""SELECT patch_num, count(*) AS n, {r('avg("B4")')} AS mean_b4 FROM (SELECT *, count(*) OVER (PARTITION BY patch_num) AS c FROM pixels WHERE rh > 0 AND rh < 100) WHERE c >= 10 GROUP BY patch_num""")
def materialize_features(t):
    params = {"folder": t.folder, "target": "rh", "bands": ["B4", "B8"], "min_samples": 10}
    table = K.materialized(t.spark, "features", params, lambda: T.training_table(t.pixels, "rh", ["B4", "B8"], 10),
                           inputs=[f"{t.folder}/lineitem.parquet"])
    return rounded(table.groupBy("patch_num").agg(F.count(F.lit(1)).alias("n"), F.avg("B4").alias("mean_b4")))


@query("incremental_outputs", "SELECT patch_num, patch_id FROM patches WHERE patch_num NOT IN (SELECT patch_num FROM pixels WHERE rh > 40)")
def incremental_outputs(t):
    return K.pending(t.patches.select("patch_num", "patch_id"), t.pixels.where(F.col("rh") > 40), "patch_num")


PATTERNS = ["%embedding_bandNum70%", "%prediction.tif", "%.tif"]


@query("find_prediction_files", """WITH p AS (SELECT DISTINCT run, path, CASE WHEN path LIKE '%embedding_bandNum70%' THEN 0 WHEN path LIKE '%prediction.tif' THEN 1 WHEN path LIKE '%.tif' THEN 2 END AS k FROM files),
 b AS (SELECT run, min(k) AS k FROM p WHERE k IS NOT NULL GROUP BY run)
 SELECT run, path FROM p JOIN b USING (run, k) QUALIFY row_number() OVER (PARTITION BY run ORDER BY path) <= 3""")
def find_prediction_files(t):
    return L.first_files(L.by_priority(t.files.select("run", "path"), "run", PATTERNS), ["run"], 3)


H = "((42 * 97 % 1000003) + (doc_id % 1000003) * 7919) % 1000003 * 48271 % 1000003"


@query("pick_prediction_file", f"SELECT run, arg_min(path, ({H}, path)) AS path FROM files WHERE path LIKE '%prediction.tif' GROUP BY run")
def pick_prediction_file(t):
    return L.pick_one(t.files.where(F.col("path").like("%prediction.tif")), "run")


@query("classify_patches", """SELECT CASE band_count WHEN 30 THEN 'unlabelled' WHEN 31 THEN 'labelled' ELSE 'unsupported' END AS kind, count(*) AS n FROM patches GROUP BY 1""")
def classify_patches(t):
    kind = (F.when(F.col("band_count") == fixed.UNLABELLED_BANDS, "unlabelled")
            .when(F.col("band_count") == fixed.LABELLED_BANDS, "labelled").otherwise("unsupported"))
    return t.patches.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


INVENTORY = " UNION ALL ".join(f"SELECT patch_num, '{n}' AS source, count({c}) AS n FROM pixels GROUP BY patch_num HAVING count({c}) > 0"
                               for c, n in [*fixed.HEIGHT_SOURCES.items(), ("forest_mask", "mask")])


@query("inventory_height_bands", INVENTORY)
def inventory_height_bands(t):
    bands = {**fixed.HEIGHT_SOURCES, "forest_mask": "mask"}
    wide = t.pixels.groupBy("patch_num").agg(*[F.count(c).alias(n) for c, n in bands.items()])
    return wide.unpivot("patch_num", list(bands.values()), "source", "n").where(F.col("n") > 0)


@query("inventory_run", """SELECT run, CASE WHEN bool_or(contains(split_part(path, '/', -1), 'rf_')) THEN 'rf' WHEN bool_or(contains(split_part(path, '/', -1), 'mlp_')) THEN 'mlp' ELSE 'unknown' END AS model_type,
 bool_or(contains(lower(path), 'temporal') OR contains(path, '_M01')) AS temporal, count(*) AS n_files, count(*) FILTER (WHERE contains(path, 'prediction')) AS n_predictions,
 count(*) FILTER (WHERE path LIKE '%.csv') AS n_tables FROM files GROUP BY run""")
def inventory_run(t):
    return L.run_inventory(t.files)


