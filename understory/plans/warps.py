"""Queries across map projections, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import projection as P
from understory.functions.exprs import utm_epsg
from understory.operators import warp as W
from understory.operators.evaluation import pooled_patch_metrics
from understory.plans.metrics import eval_sql, rmse_sql
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r
from understory.session import written


# ---- pieces of check SQL ----------------------------------------------------------

def _terms(factors, outer: str, inner: str, a: str, b: str) -> str:
    return " + ".join(f"({c!r})::DOUBLE * {outer}({2 * k} * {a}) * {inner}({2 * k} * {b})" for k, c in enumerate(factors, 1))


def project_sql(source: str, lon: str, lat: str, code: str, x: str, y: str) -> str:
    ecc, radius = f"({P.ECCENTRICITY!r})::DOUBLE", f"({P.RADIUS!r})::DOUBLE"
    return f"""SELECT * EXCLUDE (_l, _t, _u, _v), CASE WHEN {code} = 4326 THEN {lon} ELSE 500000.0::DOUBLE + {radius} * (_v + {_terms(P.FORWARD, 'cos', 'sinh', '_u', '_v')}) END AS {x},
  CASE WHEN {code} = 4326 THEN {lat} ELSE CASE WHEN {code} // 100 = 327 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END + {radius} * (_u + {_terms(P.FORWARD, 'sin', 'cosh', '_u', '_v')}) END AS {y}
  FROM (SELECT *, atan2(_t, cos(_l)) AS _u, atanh(sin(_l) / sqrt(1 + _t * _t)) AS _v FROM (
    SELECT *, radians({lon}) - radians(({code} % 100) * 6.0::DOUBLE - 183.0::DOUBLE) AS _l,
      sinh(atanh(sin(radians({lat}))) - {ecc} * atanh({ecc} * sin(radians({lat})))) AS _t FROM {source}))"""


def unproject_sql(source: str, x: str, y: str, code: str, lon: str, lat: str) -> str:
    radius = f"({P.RADIUS!r})::DOUBLE"
    series = " + ".join(f"({c!r})::DOUBLE * sin({2 * k} * _c)" for k, c in enumerate(P.LATITUDE, 1))
    return f"""SELECT * EXCLUDE (_p, _q, _u, _v, _c), CASE WHEN {code} = 4326 THEN {x} ELSE degrees(radians(({code} % 100) * 6.0::DOUBLE - 183.0::DOUBLE) + atan2(sinh(_v), cos(_u))) END AS {lon},
  CASE WHEN {code} = 4326 THEN {y} ELSE degrees(_c + {series}) END AS {lat}
  FROM (SELECT *, asin(sin(_u) / cosh(_v)) AS _c FROM (SELECT *, _p - ({_terms(P.INVERSE, 'sin', 'cosh', '_p', '_q')}) AS _u, _q - ({_terms(P.INVERSE, 'cos', 'sinh', '_p', '_q')}) AS _v FROM (
    SELECT *, ({y} - CASE WHEN {code} // 100 = 327 THEN 10000000.0::DOUBLE ELSE 0.0::DOUBLE END) / {radius} AS _p, ({x} - 500000.0::DOUBLE) / {radius} AS _q FROM {source})))"""


def reproject_sql(source: str, x: str, y: str, code: str, to: str, out_x: str, out_y: str) -> str:
    geographic = unproject_sql(source, x, y, code, "_lon", "_lat")
    return f"SELECT * EXCLUDE (_lon, _lat) FROM ({project_sql(f'({geographic})', '_lon', '_lat', to, out_x, out_y)})"


def warp_sql(cells: str, grids: str, keys: str, value: str) -> str:
    """Values of the lattice ``lt`` from one side's grids."""
    named = f"(SELECT lt.*, g.code AS _to, g.\"left\" AS _left, g.top AS _top, g.res AS _res, g.rows AS _rows, g.cols AS _cols FROM lt JOIN {grids} g USING ({keys}))"
    return f"""(WITH moved AS ({reproject_sql(named, 'x', 'y', 'code', '_to', '_x', '_y')}),
   placed AS (SELECT *, (_top - _y) / _res - 0.5::DOUBLE AS fy, (_x - _left) / _res - 0.5::DOUBLE AS fx FROM moved),
   corners AS (SELECT {keys}, region AS r_, patch_num AS p_, t_row, t_col, CAST(floor(fy) + dy AS INT) AS row, CAST(floor(fx) + dx AS INT) AS col,
     (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
     FROM placed, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) WHERE fy >= -0.5 AND fy < _rows - 0.5 AND fx >= -0.5 AND fx < _cols - 0.5)
   SELECT r_ AS region, p_ AS patch_num, t_row, t_col, sum({value} * w) / sum(w) AS {value}
   FROM corners JOIN {cells} c USING ({keys}, row, col) WHERE w > 0 GROUP BY ALL)"""


EDGES = """(SELECT g.region, g.patch_num, g.code, o.code AS to_code, o."left" AS l, o.top AS t, o."left" + o.cols * o.res AS r, o.top - o.rows * o.res AS b,
   CASE side WHEN 0 THEN g."left" + g.cols * g.res * (i / 21.0::DOUBLE) WHEN 1 THEN g."left" + g.cols * g.res * (i / 21.0::DOUBLE) WHEN 2 THEN g."left" ELSE g."left" + g.cols * g.res END AS ex,
   CASE side WHEN 0 THEN g.top WHEN 1 THEN g.top - g.rows * g.res ELSE g.top - g.rows * g.res * (i / 21.0::DOUBLE) END AS ey
   FROM patch_grids g JOIN reference_grids o USING (region), range(22) s(i), range(4) d(side))"""
PAIRS = f"""boxes AS (SELECT region, patch_num, to_code, l, t, r, b, min(x_) AS x0, min(y_) AS y0, max(x_) AS x1, max(y_) AS y1
   FROM ({reproject_sql(EDGES, 'ex', 'ey', 'code', 'to_code', 'x_', 'y_')}) GROUP BY ALL),
 cut AS (SELECT region, patch_num, to_code AS code, greatest(x0, l) AS west, least(x1, r) AS east, greatest(y0, b) AS south, least(y1, t) AS north FROM boxes),
 sized AS (SELECT *, CAST(floor((east - west) / 100) AS INT) AS width, CAST(floor((north - south) / 100) AS INT) AS height FROM cut WHERE east > west AND north > south),
 lines AS (SELECT *, CAST(unnest(range(height)) AS INT) AS t_row FROM sized WHERE width >= 10 AND height >= 10),
 spots AS (SELECT *, CAST(unnest(range(width)) AS INT) AS t_col FROM lines),
 lt AS (SELECT region, patch_num, code, t_row, t_col, west + (t_col + 0.5::DOUBLE) * ((east - west) / width) AS x, north - (t_row + 0.5::DOUBLE) * ((north - south) / height) AS y FROM spots),
 mine AS (SELECT * FROM {warp_sql('(SELECT patch_num, region, row, col, pred FROM pixels WHERE pred IS NOT NULL)', 'patch_grids', 'region, patch_num', 'pred')}),
 other AS (SELECT * FROM {warp_sql('(SELECT region, row, col, value FROM reference_cells WHERE value <> -32767)', 'reference_grids', 'region', 'value')}),
 pairs AS (SELECT * FROM mine JOIN other USING (region, patch_num, t_row, t_col))"""


def grid_pairs(t):
    pred = t.pixels.select("region", "patch_num", "row", "col", "pred")
    ref = t.reference_cells.where(F.col("value") != -32767.0).select("region", "row", "col", "value")
    return W.warped_pairs(pred, t.patch_grids, ref, t.reference_grids, "patch_num", "region", "pred", "value")


@query("reproject_points", f"""WITH z AS (SELECT fid, longitude, latitude, 32600 + CAST(floor((longitude + 180) / 6) AS INT) % 60 + 1 AS zone, 4326 AS plain FROM footprints),
 fw AS ({project_sql('z', 'longitude', 'latitude', 'zone', 'x', 'y')}), nx AS (SELECT *, zone + 1 AS next FROM fw),
 mv AS ({reproject_sql('nx', 'x', 'y', 'zone', 'next', 'next_x', 'next_y')}), bk AS ({reproject_sql('mv', 'next_x', 'next_y', 'next', 'plain', 'lon', 'lat')})
 SELECT fid, zone, {r('x', 2)} AS x, {r('y', 2)} AS y, {r('next_x', 2)} AS next_x, {r('next_y', 2)} AS next_y,
   abs(lon - longitude) < 1e-9 AND abs(lat - latitude) < 1e-9 AS returns FROM bk""")
def reproject_points(t):
    """Footprints in their own zone, from there in the next one, and back to degrees."""
    zone = F.regexp_replace(utm_epsg("longitude", "latitude"), "EPSG:", "").cast("int")
    points = t.footprints.select("fid", "longitude", "latitude", zone.alias("zone"), F.lit(P.GEOGRAPHIC).alias("plain"))
    own = P.project(points, "longitude", "latitude", "zone").withColumn("next", F.col("zone") + 1)
    moved = P.reproject(own, "x", "y", "zone", "next", "next_x", "next_y")
    back = P.reproject(moved, "next_x", "next_y", "next", "plain", "lon", "lat")
    near = (F.abs(F.col("lon") - F.col("longitude")) < 1e-9) & (F.abs(F.col("lat") - F.col("latitude")) < 1e-9)
    return rounded(back.select("fid", "zone", "x", "y", "next_x", "next_y", near.alias("returns")), 2)


CENTRES = """(SELECT p.region, p.patch_num, p.row AS prow, p.col AS pcol, p.rh, g.code, o.code AS to_code, o."left" AS l, o.top AS t, o.res AS s, o.rows AS n_rows, o.cols AS n_cols,
   g."left" + (p.col + 0.5::DOUBLE) * g.res AS x, g.top - (p.row + 0.5::DOUBLE) * g.res AS y
   FROM (SELECT * FROM pixels WHERE rh > 0) p JOIN patch_grids g USING (region, patch_num) JOIN reference_grids o USING (region))"""


@query("gedi_points_vs_reference", f"""WITH moved AS ({reproject_sql(CENTRES, 'x', 'y', 'code', 'to_code', 'x_', 'y_')}),
 placed AS (SELECT *, CAST(floor((t - y_) / s) AS INT) AS row, CAST(floor((x_ - l) / s) AS INT) AS col FROM moved)
 SELECT patch_num, prow, pcol, {r('rh')} AS rh, value FROM placed JOIN (SELECT * FROM reference_cells WHERE value <> -32767) c USING (region, row, col)""")
def gedi_points_vs_reference(t):
    """Cells with a footprint, carried from their patch's zone into the reference's, and the reference cell there."""
    cells = t.pixels.where(F.col("rh") > 0).select("region", "patch_num", "row", "col", "rh").join(t.patch_grids, ["region", "patch_num"])
    points = W.cell_centres(cells).select("region", "patch_num", F.col("row").alias("prow"), F.col("col").alias("pcol"), "rh", "code", "x", "y")
    placed = W.cells_at(points, t.reference_grids, ["region"])
    known = t.reference_cells.where(F.col("value") != -32767.0).select("region", "row", "col", "value")
    return rounded(placed.join(known, ["region", "row", "col"]).select("patch_num", "prow", "pcol", "rh", "value"))


@query("resample_bilinear", f"WITH {PAIRS} SELECT region, patch_num, t_row, t_col, {r('pred + 1e-7', 3)} AS pred, {r('value + 1e-7', 3)} AS value FROM pairs")
def resample_bilinear(t):
    """Predictions and reference, each from its own zone, on the common 100 m grid of either patch."""
    pairs = grid_pairs(t)
    # A target with one cell has that cell's value; the small offset keeps its exact halves from rounding differently.
    return rounded(pairs.withColumns({c: F.col(c) + 1e-7 for c in ("pred", "value")}), 3)


@query("crs_eval_metrics", f"""WITH {PAIRS}, ok AS (SELECT *, count(*) OVER (PARTITION BY patch_num) AS _n FROM pairs WHERE pred > 0 AND pred < 100 AND value > 0 AND value < 100),
 kept AS (SELECT * FROM ok WHERE _n > 50)
 SELECT region, {eval_sql('value', 'pred')}, {r(rmse_sql('value', 'pred') + ' / avg(value) * 100')} AS relative_rmse,
 {r('min(pred)')} AS pred_min, {r('max(pred)')} AS pred_max, {r('min(value)')} AS ref_min, {r('max(value)')} AS ref_max, count(DISTINCT patch_num) AS n_patches
 FROM kept GROUP BY region HAVING count(*) > 10""")
def crs_eval_metrics(t):
    """Accuracy on the common grids: patches with more than 50 valid cells, more than 10 in all."""
    return rounded(pooled_patch_metrics(written(grid_pairs(t), "grid-pairs"), "value", "pred", "patch_num", ["region"]))
