"""Queries over moving windows, terrain and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import fixed
from understory.operators import augment as G, neighbourhood as N, resample as R
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r

CELL = ["patch_num", "row", "col"]


@query("focal_mean", f"""SELECT a.patch_num, a.row, a.col, {r('avg(b."S1_VV")')} AS "S1_VV_filtered", {r('avg(b."S1_VH")')} AS "S1_VH_filtered"
 FROM pixels a JOIN pixels b ON a.patch_num = b.patch_num AND b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 GROUP BY ALL""")
def focal_mean(t):
    return rounded(N.focal_mean(t.pixels, ["patch_num"], ["S1_VV", "S1_VH"], 3))


@query("gamma_map", f"""WITH m AS (SELECT a.patch_num, a.row, a.col, a."S1_VV" AS v, avg(b."S1_VV") AS m, var_pop(b."S1_VV") AS s
  FROM pixels a JOIN pixels b ON a.patch_num = b.patch_num AND abs(b.row - a.row) <= 2 AND abs(b.col - a.col) <= 2 GROUP BY ALL),
 w AS (SELECT *, CASE WHEN s > 0 THEN (m * m / s) / (m * m / s + 4) ELSE 1 END AS w FROM m)
 SELECT patch_num, row, col, {r('m * w + v * (1 - w) + 1e-8')} AS "S1_VV" FROM w""")
def gamma_map(t):
    out = N.gamma_map(t.pixels, ["patch_num"], "S1_VV", 5, 4.0)
    # the small offset keeps exact halves from rounding differently in two engines
    return rounded(out.withColumn("S1_VV", F.col("S1_VV") + 1e-8))


Z = ", ".join(f"max(CASE WHEN b.row - a.row = {dy} AND b.col - a.col = {dx} THEN b.v END) AS z{dy + 1}{dx + 1}" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
TERRAIN = f"""e AS (SELECT region, row, col, CASE WHEN value = -32767 THEN 5.0::DOUBLE ELSE value END AS v FROM reference_cells),
 n AS (SELECT a.region, a.row, a.col, count(*) AS n, {Z} FROM e a JOIN e b ON a.region = b.region AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3),
 g AS (SELECT region, row, col, z11 AS v, ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / 240 AS gx, ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / 240 AS gy FROM n WHERE n = 9),
 sa AS (SELECT region, row, col, v, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS a0 FROM g),
 tr AS (SELECT region, row, col, v, slope, CASE WHEN slope > 0 THEN fmod(a0 + 360, 360) ELSE 0 END AS aspect FROM sa)"""


def elevation(t):
    return t.reference_cells.select("region", "row", "col", F.when(F.col("value") == -32767.0, 5.0).otherwise(F.col("value")).alias("elevation"))


@query("terrain_one_source", f"WITH {TERRAIN} SELECT region, row, col, v AS elevation, {r('slope')} AS slope, {r('aspect')} AS aspect FROM tr")
def terrain_one_source(t):
    return rounded(N.slope_aspect(elevation(t), ["region"], "elevation", 30.0))


def terrain_sql(source: str, name: str) -> str:
    """The view ``{name}_t``: region, row, col, v, slope, aspect of a source's cells, NULL without all neighbours."""
    return f"""{name}_n AS (SELECT a.region, a.row, a.col, max(a.v) AS v, count(*) AS n, {Z} FROM {source} a JOIN {source} b ON a.region = b.region AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3),
 {name}_g AS (SELECT region, row, col, v, CASE WHEN n = 9 THEN ((z02 + 2 * z12 + z22) - (z00 + 2 * z10 + z20)) / 240 END AS gx, CASE WHEN n = 9 THEN ((z20 + 2 * z21 + z22) - (z00 + 2 * z01 + z02)) / 240 END AS gy FROM {name}_n),
 {name}_s AS (SELECT region, row, col, v, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, degrees(atan2(-gx, gy)) AS a0 FROM {name}_g),
 {name}_t AS (SELECT region, row, col, v, slope, CASE WHEN slope IS NULL THEN NULL WHEN slope > 0 THEN fmod(a0 + 360, 360) ELSE 0 END AS aspect FROM {name}_s)"""


STACK_SQL = f"""gm AS (SELECT region, row, col, value AS v FROM reference_cells WHERE value <> -32767),
 aw AS (SELECT region, row, col, max(elev_lowestmode) AS v FROM footprints WHERE beam <> 2 GROUP BY ALL),
 gl AS (SELECT region, row, col, max(srtm) AS v FROM footprints GROUP BY ALL),
 {terrain_sql('gm', 'gm')}, {terrain_sql('gl', 'gl')}"""


@query("terrain_slope_aspect", f"""WITH {STACK_SQL} SELECT region, row, col, {r('gm_t.v')} AS "GMTED_elevation", {r('gm_t.slope')} AS "GMTED_slope", {r('gm_t.aspect')} AS "GMTED_aspect",
 {r('aw.v')} AS "AW3D30_elevation", {r('gl_t.v')} AS "GLO30_elevation", {r('gl_t.slope')} AS "GLO30_slope", {r('gl_t.aspect')} AS "GLO30_aspect"
 FROM gm_t FULL JOIN aw USING (region, row, col) FULL JOIN gl_t USING (region, row, col)""")
def terrain_slope_aspect(t):
    """The elevation stack of three sources; the fourth is absent."""
    cell = ["region", "row", "col"]
    ref = t.reference_cells.where(F.col("value") != -32767.0).select(*cell, F.col("value").alias("elevation"))
    low = t.footprints.where(F.col("beam") != 2).groupBy(*cell).agg(F.max("elev_lowestmode").alias("elevation"))
    glo = t.footprints.groupBy(*cell).agg(F.max("srtm").alias("elevation"))
    return rounded(N.elevation_stack({"GMTED": ref, "SRTM": None, "AW3D30": low, "GLO30": glo}, ["region"], 30.0))


FACTOR = ("sin(acos(cos(radians(38.0::DOUBLE)) * cos(radians(slope)) + sin(radians(38.0::DOUBLE)) * sin(radians(slope)) * "
          "cos(radians(aspect) - CASE WHEN row % 2 = 0 THEN 0 ELSE pi() END))) / sin(radians(38.0::DOUBLE))")


@query("terrain_flatten", f"WITH {TERRAIN} SELECT region, row, col, {r(FACTOR)} AS factor, {r('v * ' + FACTOR)} AS corrected FROM tr")
def terrain_flatten(t):
    terrain = N.slope_aspect(elevation(t), ["region"], "elevation", 30.0)
    factor = N.terrain_factor(F.lit(38.0), "slope", "aspect", F.col("row") % 2 == 0)
    return rounded(terrain.select("region", "row", "col", factor.alias("factor"), (F.col("elevation") * factor).alias("corrected")))


GL = """gv AS (SELECT patch_num, row, col, 'A' || lpad(CAST(k AS VARCHAR), 2, '0') AS band, CAST(trunc((CAST(embedding[k + 1] AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE) AS INT) AS g
   FROM embedding_pixels, range(64) b(k)),
 dir AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1), (3, 1, -1)) d(d, dy, dx)),
 pr AS (SELECT c.patch_num, c.row, c.col, c.band, dir.d, a.g AS i, b.g AS j FROM gv c JOIN gv a ON a.patch_num = c.patch_num AND a.band = c.band AND abs(a.row - c.row) <= 1 AND abs(a.col - c.col) <= 1
   CROSS JOIN dir JOIN gv b ON b.patch_num = a.patch_num AND b.band = a.band AND b.row = a.row + dir.dy AND b.col = a.col + dir.dx AND abs(b.row - c.row) <= 1 AND abs(b.col - c.col) <= 1),
 sy AS (SELECT patch_num, row, col, band, d, i, j FROM pr UNION ALL SELECT patch_num, row, col, band, d, j, i FROM pr),
 cn AS (SELECT patch_num, row, col, band, d, i, j, count(*) AS n FROM sy GROUP BY ALL),
 pp AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY patch_num, row, col, band, d) AS p FROM cn),
 me AS (SELECT patch_num, row, col, band, d, sum(p * p) AS asm, sum(p * (i - j) * (i - j)) AS contrast, sum(p * i) AS mu, sum(p * i * i) - sum(p * i) * sum(p * i) AS va,
   sum(p * i * j) - sum(p * i) * sum(p * i) AS co, sum(p / (1.0::DOUBLE + (i - j) * (i - j))) AS idm, sum(p * (i + j)) AS savg, -sum(p * ln(p)) AS ent,
   sum(p * (i - j) * (i - j)) - sum(p * abs(i - j)) * sum(p * abs(i - j)) AS dvar FROM pp GROUP BY ALL),
 pb AS (SELECT patch_num, row, col, band, avg(asm) AS asm, avg(contrast) AS contrast, avg(CASE WHEN va > 1e-12::DOUBLE THEN co / va ELSE 0 END) AS corr, avg(va) AS var, avg(idm) AS idm,
   avg(savg) AS savg, avg(ent) AS ent, avg(dvar) AS dvar FROM me GROUP BY ALL)"""
GLCM_OUT = ", ".join(f"{r(f'avg({m}) + 1e-8', 6)} AS mean_{m}, {r(f'quantile_cont({m}, 0.5) + 1e-8', 6)} AS median_{m}" for m in N.GLCM_MEASURES)


@query("glcm_texture", f"WITH {GL} SELECT patch_num, row, col, {GLCM_OUT} FROM pb GROUP BY patch_num, row, col")
def glcm_texture(t):
    px = t.embedding_wide.select("patch_num", "row", "col", *fixed.EMBEDDING_BANDS)
    out = N.band_textures(px, ["patch_num"], fixed.EMBEDDING_BANDS, 3)
    # the small offset keeps exact halves from rounding differently in two engines
    return rounded(out.select(*CELL, *[(F.col(c) + 1e-8).alias(c) for c in out.columns if c not in CELL]))


AUG_ROW = """CASE turns WHEN 1 THEN 63 - fc WHEN 2 THEN 63 - fr WHEN 3 THEN fc ELSE fr END"""
AUG_COL = """CASE turns WHEN 1 THEN fr WHEN 2 THEN 63 - fc WHEN 3 THEN 63 - fr ELSE fc END"""


@query("augment_spatial", f"""WITH a AS (SELECT patch_num, row, col, reference_height, CAST(range AS INT) AS augment_id, CASE WHEN range = 0 THEN 0 ELSE (range - 1) % 3 + 1 END AS flip,
  CASE WHEN range = 0 THEN 0 ELSE (range - 1) // 3 END AS turns FROM pixels, range(12)),
 f AS (SELECT *, CASE WHEN flip IN (2, 3) THEN 63 - row ELSE row END AS fr, CASE WHEN flip IN (1, 3) THEN 63 - col ELSE col END AS fc FROM a)
 SELECT patch_num, augment_id, CAST({AUG_ROW} AS INT) AS row, CAST({AUG_COL} AS INT) AS col, reference_height FROM f""")
def augment_spatial(t):
    return G.spatial(t.pixels.select(*CELL, "reference_height"), 64).select("patch_num", "augment_id", "row", "col", "reference_height")


@query("augment_legacy")
def augment_legacy(t):
    return G.legacy(t.pixels.select(*CELL, "B4"), ["B4"], ["patch_num"], 64, crops=4, min_crop_size=64)


@query("augment_noise")
def augment_noise(t):
    return G.noise_copies(t.footprints.select("fid", "reference_height", "mean_var"), ["mean_var"], "reference_height", rare_share=0.25)


@query("augment_noise_counts", """WITH c AS (SELECT CAST((reference_height >= 0)::INT + (reference_height >= 5)::INT + (reference_height >= 10)::INT + (reference_height >= 15)::INT + (reference_height >= 20)::INT
  + (reference_height >= 30)::INT + (reference_height >= 50)::INT + (reference_height >= 100)::INT AS INT) AS class_no FROM footprints),
 k AS (SELECT class_no, count(*) AS c FROM c GROUP BY class_no)
 SELECT class_no, CAST(c * CASE WHEN class_no >= 5 AND c < (SELECT sum(c) FROM k) * 0.25 THEN 3 ELSE 1 END AS BIGINT) AS n FROM k""")
def augment_noise_counts(t):
    out = G.noise_copies(t.footprints.select("fid", "reference_height", "mean_var"), ["mean_var"], "reference_height", rare_share=0.25)
    return out.groupBy("class_no").agg(F.count(F.lit(1)).alias("n"))


RESIZE = "g AS (SELECT patch_num, i AS t_row, j AS t_col, i * (63.0::DOUBLE / 39) AS fy, j * (63.0::DOUBLE / 39) AS fx FROM (SELECT DISTINCT patch_num FROM pixels), (SELECT CAST(range AS INT) AS i FROM range(40)), (SELECT CAST(range AS INT) AS j FROM range(40)))"


@query("resize_grid", f"""WITH {RESIZE}, k AS (SELECT patch_num, t_row, t_col, CAST(floor(fy) + dy AS INT) AS row, CAST(floor(fx) + dx AS INT) AS col,
   (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
 SELECT patch_num, t_row, t_col, {r('sum("S1_VV" * w) / sum(w)')} AS "S1_VV" FROM k JOIN pixels USING (patch_num, row, col) WHERE w > 0 GROUP BY ALL""")
def resize_grid(t):
    return rounded(R.resize_linear(t.pixels.select(*CELL, "S1_VV"), "S1_VV", ["patch_num"], 64, 40))


@query("resize_grid_nearest", f"""WITH {RESIZE} SELECT g.patch_num, t_row, t_col, forest_mask FROM g JOIN pixels p ON p.patch_num = g.patch_num AND p.row = CAST(floor(fy + 0.5::DOUBLE) AS INT) AND p.col = CAST(floor(fx + 0.5::DOUBLE) AS INT)""")
def resize_grid_nearest(t):
    return R.resize_nearest(t.pixels.select(*CELL, "forest_mask"), "forest_mask", ["patch_num"], 64, 40)


@query("broadcast_time", f"""SELECT patch_num, row, col, CAST(range AS INT) AS month, {r('"B4"')} AS "B4" FROM pixels, range(1, 13)""")
def broadcast_time(t):
    return rounded(G.over_months(t.pixels.select(*CELL, "B4")))


@query("reshape_months", f"""SELECT vec_id, CAST((i - 1) // 12 AS INT) AS channel, CAST((i - 1) % 12 + 1 AS INT) AS month, {r('v')} AS value FROM (SELECT vec_id, embedding[i] AS v, i FROM embedding_pixels, range(1, 73) AS places(i))""")
def reshape_months(t):
    px = t.embedding_pixels.select("vec_id", F.col("embedding").cast("array<double>").alias("bands"))
    return rounded(G.months_from_bands(px, "bands", ["vec_id"]))


@query("pad_channels", f"""SELECT vec_id, {r('list_sum(embedding[1:64])', 5)} AS total, 70 AS channels, 0.0::DOUBLE AS last FROM embedding_pixels""")
def pad_channels(t):
    return t.embedding_pixels.select("vec_id", G.padded("embedding", 70).alias("a")).select(
        "vec_id", F.round(F.aggregate("a", F.lit(0.0), lambda x, y: x + y), 5).alias("total"), F.size("a").alias("channels"), F.get("a", 69).alias("last"))
