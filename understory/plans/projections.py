"""Queries for filters, band selection, masks and training tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from understory.functions import fixed
from understory.functions.exprs import between, clip, drop_codes, finite_or_limits, finite_or_zero
from understory.operators import bands as B, cleaning as C, masks as K, training as T
from understory.operators.order import exact_medians
from understory.plans.metrics import QUALITY_SQL, clean_sql
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r

CELL = ["patch_num", "row", "col"]


@query("gedi_quality_filter", f"SELECT fid, region, {r('rh')} AS rh, beam FROM footprints WHERE {QUALITY_SQL}")
def gedi_quality_filter(t):
    return rounded(C.quality_footprints(t.footprints).select("fid", "region", "rh", "beam"))


@query("gedi_quality_filter_elev", f"""SELECT fid, {r('rh')} AS rh, {r('elev_lowestmode - srtm')} AS above FROM footprints
 WHERE {QUALITY_SQL} AND elev_lowestmode - srtm < 50""")
def gedi_quality_filter_elev(t):
    return rounded(C.quality_footprints_terrain(t.footprints).select(
        "fid", "rh", (F.col("elev_lowestmode") - F.col("srtm")).alias("above")))


@query("select_bands", f"""SELECT patch_num, row, col, {', '.join(f'{r(c)} AS {c}' for c in fixed.AUXILIARY_BANDS)} FROM pixels""")
def select_bands(t):
    return rounded(B.select_bands(t.pixels, "auxiliary"))


ORIGINAL = ["S1_VV", "S1_VH", "B4", "B8", "ALOS2_HH", "ALOS2_HV", "DEM", "slope", "aspect", "pred", "pred_b"]


@query("select_bands_original", f"""SELECT patch_num, row, col, {', '.join(f'{r(c)} AS "{c}"' for c in ORIGINAL)} FROM pixels""")
def select_bands_original(t):
    return rounded(B.select_bands(t.pixels, "original"))


@query("embedding_features", "SELECT vec_id, " + ", ".join(f'{r(chr(34) + b + chr(34))} AS "{b}"' for b in fixed.EMBEDDING_BANDS)
       + " FROM embedding_wide")
def embedding_features(t):
    return rounded(B.embedding_features(t.embedding_wide, ["vec_id"]))


@query("load_global_product", f"""SELECT patch_num, row, col, {r('CASE WHEN ch_pauls2024 > 0 AND ch_pauls2024 <= 100 THEN ch_pauls2024 END')} AS height FROM pixels""")
def load_global_product(t):
    return rounded(t.pixels.select(*CELL, F.when(between("ch_pauls2024", 0, 100), F.col("ch_pauls2024")).alias("height")))


NAMES_64 = B.positional_names(64)


@query("positional_band_names", f"""SELECT ([{', '.join(f"'{n}'" for n in NAMES_64)}])[i] AS band, count(*) AS n, {r('avg(v)')} AS mean
 FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embedding_pixels) GROUP BY 1""")
def positional_band_names(t):
    long = B.named_by_position(t.embedding_pixels, "embedding", B.positional_names(64), ["vec_id"])
    return rounded(long.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").cast("double")).alias("mean")))


@query("select_target", f"SELECT patch_num, row, col, {r('reference_height')} AS target FROM pixels WHERE reference_height IS NOT NULL")
def select_target(t):
    name = B.target_band(t.pixels.columns, "reference")
    return rounded(t.pixels.select(*CELL, F.col(name).alias("target")).where(F.col("target").isNotNull()))


@query("select_target_fallback", f"SELECT patch_num, row, col, {r('ch_pauls2024')} AS target FROM pixels WHERE ch_pauls2024 IS NOT NULL")
def select_target_fallback(t):
    px = t.pixels.drop("reference_height")
    name = B.target_band(px.columns, "reference")
    return rounded(px.select(*CELL, F.col(name).alias("target")).where(F.col("target").isNotNull()))


@query("extract_bands", f"""SELECT patch_num, row, col, {', '.join(f'{r(c)} AS {c}' for c in fixed.AUXILIARY_BANDS)}, {r('rh')} AS target FROM pixels""")
def extract_bands(t):
    return rounded(B.extract_bands(t.pixels, "auxiliary", "gedi_only"))


@query("patch_compatibility", "SELECT patch_num, count(rh) > 0 AS compatible FROM pixels GROUP BY patch_num")
def patch_compatibility(t):
    return B.patch_has_target(t.pixels, "rh")


DROP_BANDS = ["B4", "B8", "DEM", "rh"]


@query("drop_target_band", f"""SELECT patch_num, row, col, {r('"B4"')} AS "B4", {r('"B8"')} AS "B8", {r('"DEM"')} AS "DEM" FROM pixels""")
def drop_target_band(t):
    return rounded(B.drop_target(t.pixels.select(*CELL, *DROP_BANDS), DROP_BANDS))


def rule_sql() -> str:
    parts = []
    for name, low, low_open, high, high_open in T.HEIGHT_RULES:
        cond = f"rh {'>' if low_open else '>='} {low}::DOUBLE"
        if high is not None:
            cond += f" AND rh {'<' if high_open else '<='} {high}::DOUBLE"
        parts.append(f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {cond}) AS n_valid FROM footprints")
    return " UNION ALL ".join(parts)


@query("valid_height_filter", rule_sql())
def valid_height_filter(t):
    return T.rule_counts(t.footprints, "rh")


@query("valid_pair_filter", f"""SELECT patch_num, row, col, {r('pred')} AS pred FROM pixels WHERE pred BETWEEN 0 AND 35
 AND reference_height BETWEEN 0 AND 35 AND reference_height <> -32767""")
def valid_pair_filter(t):
    return rounded(T.prediction_pairs_in_range(t.pixels, "pred", "reference_height").select(*CELL, "pred"))


@query("extract_sparse_pixels", f"SELECT patch_num, row, col, {r('rh')} AS rh FROM pixels WHERE rh > 0")
def extract_sparse_pixels(t):
    return rounded(T.sparse_pixels(t.pixels, "rh").select(*CELL, "rh"))


@query("sparse_share", f"""SELECT count(*) FILTER (WHERE rh > 0) AS n_valid, count(*) AS n_total,
 {r('count(*) FILTER (WHERE rh > 0) * 100.0 / count(*)')} AS valid_percent FROM pixels""")
def sparse_share(t):
    return rounded(T.valid_share(t.pixels, "rh"))


@query("sparse_pixel_dataset", f"""WITH v AS (SELECT patch_num, row, col, rh, count(*) OVER (PARTITION BY patch_num) AS n_samples FROM pixels WHERE rh > 0)
 SELECT patch_num, row, col, {r('rh')} AS rh, n_samples FROM v WHERE n_samples >= 10""")
def sparse_pixel_dataset(t):
    return rounded(T.gate(T.sparse_pixels(t.pixels, "rh").select(*CELL, "rh"), "patch_num", 10))


@query("min_samples_gate", """WITH v AS (SELECT patch_num, count(*) FILTER (WHERE rh > 0 AND rh < 100) AS n_valid FROM pixels GROUP BY patch_num)
 SELECT * FROM v WHERE n_valid < 180""")
def min_samples_gate(t):
    valid = t.pixels.where(between("rh", 0, 100, high_open=True))
    return T.skipped_patches(t.pixels, valid, "patch_num", 180)


FEATURES = ["S1_VV", "B4", "B8", "ch_tolan2024", "ch_pauls2024"]


def training_sql(source: str, target: str, minimum: int) -> str:
    cols = ", ".join(f'coalesce("{f}", 0) AS "{f}"' for f in FEATURES)
    return f"""WITH v AS (SELECT *, count(*) OVER (PARTITION BY patch_num) AS _n FROM {source} WHERE {target} > 0 AND {target} < 100),
 f AS (SELECT patch_num, row, col, {cols}, {target} AS target FROM v WHERE _n >= {minimum})
 SELECT patch_num, row, col, {', '.join(f'{r(chr(34) + f + chr(34))} AS "{f}"' for f in FEATURES)}, {r('target')} AS target,
 {' AND '.join(f'"{f}" = 0' for f in FEATURES)} AS all_zero FROM f"""


@query("load_gedi_training", training_sql("pixels", "rh", 10))
def load_gedi_training(t):
    return rounded(T.training_table(t.pixels, "rh", FEATURES, 10))


@query("load_reference_training", training_sql(
    "(SELECT p.* EXCLUDE (reference_height), g.ref FROM pixels p JOIN (SELECT patch_num, row, col, avg(reference_height) AS ref FROM footprints GROUP BY 1, 2, 3) g USING (patch_num, row, col))",
    "ref", 100))
def load_reference_training(t):
    from understory.operators.resample import average_to_grid
    fine = t.footprints.select("patch_num", "row", "col", "reference_height")
    ref = average_to_grid(fine, CELL, "reference_height").withColumnRenamed("reference_height", "ref")
    return rounded(T.training_table(t.pixels.join(ref, CELL), "ref", FEATURES, 100))


@query("count_gedi_per_patch", "SELECT patch_num, count(*) FILTER (WHERE rh > 0 AND rh < 100) AS n_valid FROM pixels GROUP BY patch_num")
def count_gedi_per_patch(t):
    return T.count_valid(t.pixels, "rh")


# ---- observation masks ----------------------------------------------------------------

@query("cloud_mask", f"SELECT obs_id, px, {r('probability')} AS probability FROM observations WHERE probability < 65")
def cloud_mask(t):
    return rounded(K.drop_cloudy(t.observations).select("obs_id", "px", "probability"))


@query("edge_mask", f"""SELECT obs_id, px, {r('"B8A"')} AS "B8A", {r('"B9"')} AS "B9" FROM observations WHERE "B8A" IS NOT NULL AND "B9" IS NOT NULL""")
def edge_mask(t):
    return rounded(K.drop_edges(t.observations).select("obs_id", "px", "B8A", "B9"))


@query("qa60_mask", f"""SELECT obs_id, px, {r('"B4" / 10000.0', 9)} AS "B4", {r('"B8" / 10000.0', 9)} AS "B8" FROM observations
 WHERE cloudy_pct < 20 AND (qa60 & 1024) = 0 AND (qa60 & 2048) = 0""")
def qa60_mask(t):
    return rounded(K.clear_reflectance(t.observations, ["B4", "B8"]).select("obs_id", "px", "B4", "B8"), 9)


DW = """dw AS (SELECT px, CASE WHEN quantile_cont(dw_label, 0.5) = 0 OR quantile_cont(dw_label, 0.5) >= 2 THEN 0 ELSE 1 END AS dw FROM observations GROUP BY px)"""
FNF = """fn AS (SELECT px, CASE WHEN quantile_cont(fnf4, 0.5) IN (1, 2) THEN 1 ELSE 0 END AS fnf_mask FROM observations GROUP BY px)"""
ND = """nd0 AS (SELECT px, quantile_cont(("B8" - "B4") / nullif("B8" + "B4", 0), 0.5) AS m FROM observations
  WHERE probability < 70 AND "B8A" IS NOT NULL AND "B9" IS NOT NULL GROUP BY px),
 nd AS (SELECT px, CASE WHEN max(m) >= {t}::DOUBLE THEN 1 ELSE 0 END AS ndvi_mask FROM (SELECT DISTINCT px FROM observations) LEFT JOIN nd0 USING (px) GROUP BY px)"""
COVER = """cv AS (SELECT px, CASE WHEN arg_max(wc, (ts, obs_id)) = 10 THEN 1 ELSE 0 END AS wc_mask,
  CASE WHEN arg_max(chm, (ts, obs_id)) >= 1 THEN 1 ELSE 0 END AS chm_mask FROM observations GROUP BY px)"""


@query("forest_mask_dw", f"WITH {DW} SELECT * FROM dw")
def forest_mask_dw(t):
    return K.dynamic_world_mask(t.observations)


@query("forest_mask_fnf", f"WITH {FNF} SELECT * FROM fn")
def forest_mask_fnf(t):
    return K.forest_type_mask(t.observations)


@query("forest_mask_ndvi", f"WITH {ND.format(t=0.45)} SELECT * FROM nd")
def forest_mask_ndvi(t):
    return K.ndvi_mask(t.observations, threshold=0.45)


@query("forest_mask_wc", f"WITH {COVER} SELECT px, wc_mask FROM cv")
def forest_mask_wc(t):
    return K.cover_masks(t.observations).select("px", "wc_mask")


@query("forest_mask_chm", f"WITH {COVER} SELECT px, chm_mask FROM cv")
def forest_mask_chm(t):
    return K.cover_masks(t.observations).select("px", "chm_mask")


ALL_MASK = f"""{DW}, {FNF}, {ND.format(t=0.3)}, {COVER}, al AS (SELECT px, CASE WHEN (dw = 1 OR fnf_mask = 1 OR wc_mask = 1 OR ndvi_mask = 1) AND chm_mask = 1
 THEN 1 ELSE 0 END AS mask FROM dw JOIN fn USING (px) JOIN nd USING (px) JOIN cv USING (px))"""


@query("forest_mask_combine", f"WITH {ALL_MASK} SELECT px, mask FROM al")
def forest_mask_combine(t):
    return K.combined_mask(t.observations, "ALL")


@query("apply_forest_mask", f"""WITH {ALL_MASK} SELECT fid, {r('CASE WHEN mask = 1 THEN rh ELSE 0 END')} AS rh
 FROM footprints LEFT JOIN al ON al.px = patch_num * 16 + col % 16""")
def apply_forest_mask(t):
    points = t.footprints.select("fid", "rh", (F.col("patch_num") * 16 + F.col("col") % 16).alias("px"))
    mask = K.combined_mask(t.observations, "ALL")
    return rounded(K.mask_points(points, mask, ["px"]).select("fid", "rh"))


@query("apply_forest_mask_pixels", f"""WITH {DW} SELECT patch_num, row, col FROM pixels WHERE patch_num * 16 + col % 16 IN (SELECT px FROM dw WHERE dw = 1)""")
def apply_forest_mask_pixels(t):
    px = t.pixels.select(*CELL, (F.col("patch_num") * 16 + F.col("col") % 16).alias("px"))
    return K.mask_pixels(px, K.combined_mask(t.observations, "DW"), ["px"]).select(*CELL)


@query("patch_forest_mask", f"""SELECT patch_num, row, col, {r('CASE WHEN forest_mask > 0 THEN "B4" END')} AS "B4",
 {r('CASE WHEN forest_mask > 0 THEN "B8" END')} AS "B8" FROM pixels""")
def patch_forest_mask(t):
    return rounded(K.mask_bands(t.pixels, ["B4", "B8"]).select(*CELL, "B4", "B8"))


# ---- fills and cleaning --------------------------------------------------------------

def broken(t):
    """Pixels with NaN, infinities and no-data codes put in by key."""
    inf = F.lit(math.inf)
    return t.pixels.select(*CELL, F.when(F.col("row") % 9 == 0, F.lit(math.nan)).when(F.col("row") % 9 == 1, inf)
                           .when(F.col("row") % 9 == 2, -inf).otherwise(F.col("B4")).alias("v"),
                           F.when(F.col("col") % 8 == 0, -9999.0).otherwise(F.col("B8")).alias("w"))


BROKEN = """broken AS (SELECT patch_num, row, col, CASE WHEN row % 9 IN (0, 1, 2) THEN NULL ELSE "B4" END AS v,
  row % 9 AS kind, CASE WHEN col % 8 = 0 THEN -9999.0::DOUBLE ELSE "B8" END AS w FROM pixels)"""


@query("fill_nonfinite_zero", f"""WITH {BROKEN} SELECT patch_num, row, col, {r('coalesce(v, 0)')} AS zero_filled,
 {r('CASE kind WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN -100 ELSE v END')} AS limit_filled, {r('CASE WHEN w = -9999 THEN NULL ELSE w END')} AS coded FROM broken""")
def fill_nonfinite_zero(t):
    return rounded(broken(t).select(*CELL, finite_or_zero("v").alias("zero_filled"),
                                    finite_or_limits("v").alias("limit_filled"), drop_codes("w").alias("coded")))


@query("fill_median", f"""WITH {BROKEN}, m AS (SELECT patch_num, quantile_cont(v, 0.5) AS med FROM broken GROUP BY patch_num)
 SELECT patch_num, row, col, {r('coalesce(v, med, 0)')} AS v FROM broken JOIN m USING (patch_num)""")
def fill_median(t):
    return rounded(C.fill_group_median(broken(t).select(*CELL, "v"), ["patch_num"], ["v"]))


@query("impute_feature_median", f"""SELECT fid, {r('coalesce(mean_ent, (SELECT quantile_cont(mean_ent, 0.5) FROM footprints))')} AS mean_ent,
 {r('coalesce(ch_tolan2024, (SELECT quantile_cont(ch_tolan2024, 0.5) FROM footprints))')} AS ch_tolan2024 FROM footprints""")
def impute_feature_median(t):
    cols = ["mean_ent", "ch_tolan2024"]
    return rounded(C.fill_group_median(t.footprints.select("fid", *cols), [], cols))


@query("clip_height", f"SELECT fid, {r('greatest(0, least(100, rh))')} AS rh FROM footprints")
def clip_height(t):
    return rounded(t.footprints.select("fid", clip("rh", 0, 100).alias("rh")))


HEIGHTS = fixed.HEIGHT_COLUMNS


@query("clean_heights", f"SELECT fid, {', '.join(f'{r(c)} AS {c}' for c in HEIGHTS)} FROM ({clean_sql('footprints')})")
def clean_heights(t):
    return rounded(C.clean_heights(t.footprints).select("fid", *HEIGHTS))


TEXTURES = ["mean_asm", "mean_contrast", "mean_corr", "mean_var", "mean_ent", "median_savg"]


def clean_texture_sql() -> str:
    tex = ", ".join(
        f"CASE WHEN (SELECT count({c}) FROM k) <= 10 OR abs({c} - (SELECT avg({c}) FROM k)) < 3 * (SELECT stddev_samp({c}) FROM k) THEN {c} END AS {c}"
        for c in TEXTURES)
    return f"""v AS (SELECT *, abs(reference_height - rh) AS height_difference, abs(reference_height - rh) <= 5 AS height_agreement,
   abs(reference_height - rh) / (reference_height + 1e-6) AS relative_error, rh - reference_height AS bias
   FROM footprints WHERE reference_height > 0 AND reference_height <= 100 AND rh > 0 AND rh <= 100),
 k AS (SELECT * FROM v WHERE abs(height_difference - (SELECT avg(height_difference) FROM v)) < 3 * (SELECT stddev_samp(height_difference) FROM v)),
 tex AS (SELECT * REPLACE ({tex}) FROM k)"""


@query("clean_texture", f"""WITH {clean_texture_sql()} SELECT fid, height_agreement, {r('height_difference')} AS height_difference, {r('relative_error')} AS relative_error,
 {r('bias')} AS bias, {', '.join(f'{r(c)} AS {c}' for c in TEXTURES)} FROM tex""")
def clean_texture(t):
    out = C.clean_texture(t.footprints, TEXTURES)
    return rounded(out.select("fid", "height_agreement", "height_difference", "relative_error", "bias", *TEXTURES))


# ---- band-name logic over the data ----------------------------------------------------

@query("detect_temporal", "SELECT run, bool_or(lower(path) LIKE '%temporal%' OR path LIKE '%\\_M01%' ESCAPE '\\') AS temporal FROM files GROUP BY run")
def detect_temporal(t):
    return t.files.groupBy("run").agg(F.bool_or(B.is_temporal_file("path")).alias("temporal"))


@query("split_temporal_bands", """WITH n AS (SELECT 'S1_VV_M' || lpad(CAST(month AS VARCHAR), 2, '0') AS band FROM observations
  UNION ALL SELECT CASE WHEN dw_label = 0 THEN 'rh' WHEN dw_label = 1 THEN 'forest_mask' WHEN dw_label = 2 THEN 'DEM' ELSE 'slope' END FROM observations)
 SELECT band, regexp_matches(band, '_M(0[1-9]|1[0-2])') AS temporal, count(*) AS n FROM n WHERE band NOT IN ('rh', 'forest_mask') GROUP BY 1""")
def split_temporal_bands(t):
    label = F.col("dw_label")
    static = (F.when(label == 0, "rh").when(label == 1, "forest_mask").when(label == 2, "DEM").otherwise("slope"))
    names = t.observations.select(F.explode(F.array(F.format_string("S1_VV_M%02d", "month"), static)).alias("band"))
    return (names.where(~F.col("band").isin("rh", "forest_mask")).groupBy("band")
            .agg(F.count(F.lit(1)).alias("n")).select("band", B.is_temporal("band").alias("temporal"), "n"))


@query("variance_select", " UNION ALL ".join(
    f"SELECT '{c}' AS band, {r(f'var_pop({c})')} AS variance FROM footprints HAVING var_pop({c}) > 0.01::DOUBLE" for c in TEXTURES))
def variance_select(t):
    return rounded(B.high_variance(t.footprints, TEXTURES))


@query("training_info", f"""SELECT count(*) AS n_rows, {r('min(rh)')} AS min_target, {r('max(rh)')} AS max_target,
 'mean_asm,mean_contrast,mean_corr,mean_ent,mean_var,median_savg' AS bands FROM footprints""")
def training_info(t):
    return rounded(T.training_info(t.footprints, TEXTURES))


@query("check_predictions", """SELECT patch_num, row, NOT bool_and(coalesce(v = 0, false)) AS has_values FROM (SELECT patch_num, row, CASE WHEN col < 50 THEN 0 ELSE pred END AS v FROM pixels) GROUP BY patch_num, row""")
def check_predictions(t):
    px = t.pixels.withColumn("v", F.when(F.col("col") < 50, 0.0).otherwise(F.col("pred")))
    return T.has_values(px, "v", 0.0, ["patch_num", "row"])


@query("validate_pair", f"""SELECT {r('min(pred)')} AS pred_min, {r('max(pred)')} AS pred_max, {r('avg(pred)')} AS pred_mean, {r('stddev_pop(pred)')} AS pred_std,
 {r('min(reference_height)')} AS ref_min, {r('max(reference_height)')} AS ref_max, {r('avg(reference_height)')} AS ref_mean,
 {r('stddev_pop(reference_height)')} AS ref_std, true AS usable FROM pixels""")
def validate_pair(t):
    return rounded(T.require_usable(T.pair_summary(t.pixels, "pred", "reference_height")))
