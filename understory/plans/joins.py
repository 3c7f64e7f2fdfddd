"""Queries that join points, cells, patches and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions.exprs import area_code_of, between
from understory.operators import alignment as A, metrics as M, patches as P, resample as R
from understory.plans.metrics import eval_sql, sigma_sql
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r

CELL = ["patch_num", "row", "col"]
RES = 1 / 64


def located(t, *more):
    """Footprints with the cell of the reference grid they fall into."""
    return A.to_cells(t.footprints.select("fid", "region", "longitude", "latitude", *more), 134.0, 35.0, RES)


LOCATED = """pts AS (SELECT fid, region, longitude, latitude, rh, CAST(floor((35.0::DOUBLE - latitude) / 0.015625::DOUBLE) AS INT) AS row,
  CAST(floor((longitude - 134.0::DOUBLE) / 0.015625::DOUBLE) AS INT) AS col FROM footprints)"""


@query("sample_points", f"""WITH {LOCATED} SELECT fid, row, col, CASE WHEN value <> -32767 THEN value END AS value FROM pts LEFT JOIN reference_cells USING (region, row, col)""")
def sample_points(t):
    return A.sample_points(located(t), t.reference_cells, ["region", "row", "col"]).select("fid", "row", "col", "value")


@query("add_reference_to_points", f"""WITH {LOCATED}, named AS (SELECT *, 'outputs/dchm_' || region || '_points.csv' AS path FROM pts)
 SELECT fid, regexp_extract(path, 'dchm_([0-9A-Za-z]+)', 1) AS area, CASE WHEN value <> -32767 THEN value END AS reference
 FROM named LEFT JOIN reference_cells ON reference_cells.region = regexp_extract(path, 'dchm_([0-9A-Za-z]+)', 1) AND named.row = reference_cells.row AND named.col = reference_cells.col""")
def add_reference_to_points(t):
    named = located(t).withColumn("path", F.concat(F.lit("outputs/dchm_"), "region", F.lit("_points.csv"))).drop("region")
    coded = named.withColumn("area", F.regexp_replace(area_code_of("path"), "^dchm_", ""))
    cells = t.reference_cells.withColumnRenamed("region", "area")
    return A.sample_points(coded, cells, ["area", "row", "col"], out="reference").select("fid", "area", "reference")


@query("combine_heights", f"""WITH {LOCATED}, s AS (SELECT CASE WHEN value <> -32767 THEN value END AS v FROM pts LEFT JOIN reference_cells USING (region, row, col))
 SELECT count(*) AS total, count(v) AS valid, count(*) FILTER (WHERE v IS NULL) AS no_data, min(v) AS min_value, max(v) AS max_value FROM s""")
def combine_heights(t):
    return A.reference_summary(A.sample_points(located(t), t.reference_cells, ["region", "row", "col"]), "value")


@query("sample_regions", f"""SELECT fid, {r('f.longitude')} AS longitude, {r('p."B4"')} AS "B4", {r('p."S1_VV"')} AS "S1_VV" FROM footprints f JOIN pixels p
 ON f.patch_num = p.patch_num AND f.row = p.row AND f.col = p.col WHERE p.forest_mask > 0""")
def sample_regions(t):
    cells = t.pixels.where(F.col("forest_mask") > 0).select(*CELL, "B4", "S1_VV")
    points = t.footprints.select("fid", "longitude", *CELL)
    return rounded(A.sample_regions(points, cells, CELL).select("fid", "longitude", "B4", "S1_VV"))


HK = "(((42 * 97 % 1000003) + (patch_num % 1000003) * 7919 + (row % 1000003) * 104729 + (col % 1000003) * 1299709) % 1000003 * 48271 % 1000003)"


@query("sample_grid_points", f"SELECT patch_num, row, col, {r('rh')} AS rh FROM pixels WHERE rh IS NOT NULL ORDER BY {HK}, patch_num, row, col LIMIT 500")
def sample_grid_points(t):
    return rounded(A.sample_grid(t.pixels.select(*CELL, "rh"), "rh", 500, CELL, CELL, seed=42))


@query("points_vs_reference_same_system", f"""WITH c AS (SELECT region, patch_num, row AS prow, col AS pcol, rh, 35.0::DOUBLE - (row + 0.5::DOUBLE) * 0.015625::DOUBLE AS lat,
   134.0::DOUBLE + (col + 0.5::DOUBLE) * 0.015625::DOUBLE AS lon FROM pixels WHERE rh > 0)
 SELECT patch_num, prow, pcol, {r('rh')} AS rh, value FROM c JOIN (SELECT * FROM reference_cells WHERE value <> -32767) rc ON c.region = rc.region
 AND rc.row = CAST(floor((35.0::DOUBLE - lat) / 0.015625::DOUBLE) AS INT) AND rc.col = CAST(floor((lon - 134.0::DOUBLE) / 0.015625::DOUBLE) AS INT)""")
def points_vs_reference_same_system(t):
    cells = t.pixels.where(F.col("rh") > 0).select(
        "region", "patch_num", F.col("row").alias("prow"), F.col("col").alias("pcol"), "rh",
        (F.lit(35.0) - (F.col("row") + 0.5) * RES).alias("latitude"), (F.lit(134.0) + (F.col("col") + 0.5) * RES).alias("longitude"))
    sampled = A.sample_points(A.to_cells(cells, 134.0, 35.0, RES), t.reference_cells, ["region", "row", "col"])
    return rounded(sampled.where(F.col("value").isNotNull()).select("patch_num", "prow", "pcol", "rh", "value"))


@query("join_cloud_probability", f"""WITH cp AS (SELECT scene_id, px, arg_min(probability, obs_id) AS p FROM observations GROUP BY scene_id, px)
 SELECT obs_id, {r('p')} AS probability FROM observations o LEFT JOIN cp ON o.scene_id = cp.scene_id AND o.px = cp.px""")
def join_cloud_probability(t):
    right = t.observations.select("scene_id", "px", "probability", "obs_id")
    left = t.observations.select("obs_id", "scene_id", "px")
    out = A.attach_first(left, right, ["scene_id", "px"], "probability", ["obs_id"])
    return rounded(out.select("obs_id", "probability"))


@query("stack_bands", f"""WITH a AS (SELECT patch_num, row, col, "B4" AS b4 FROM pixels),
 b AS (SELECT patch_num, row, col, max(pred) AS p FROM predictions WHERE pred IS NOT NULL GROUP BY ALL),
 c AS (SELECT patch_num, row, col, min(rh) AS h FROM footprints GROUP BY ALL)
 SELECT patch_num, row, col, {r('b4')} AS "B4", {r('p')} AS pred, {r('h')} AS rh
 FROM a FULL OUTER JOIN b USING (patch_num, row, col) FULL OUTER JOIN c USING (patch_num, row, col)""")
def stack_bands(t):
    a = t.pixels.select(*CELL, "B4")
    b = t.predictions.where(F.col("pred").isNotNull()).groupBy(*CELL).agg(F.max("pred").alias("pred"))
    c = t.footprints.groupBy(*CELL).agg(F.min("rh").alias("rh"))
    return rounded(A.stack_bands([(a, ["B4"]), (b, ["pred"]), (c, ["rh"])], CELL))


@query("align_rasters", f"""WITH p AS (SELECT region, row // 4 AS row, col // 4 AS col, avg(pred) AS pred FROM pixels WHERE pred IS NOT NULL GROUP BY ALL),
 q AS (SELECT region, row // 4 AS row, col // 4 AS col, avg(value) AS value FROM reference_cells WHERE value <> -32767 GROUP BY ALL),
 m AS (SELECT region, row // 4 AS row, col // 4 AS col, avg(mask) AS m FROM reference_cells GROUP BY ALL)
 SELECT region, CAST(row AS INT) AS row, CAST(col AS INT) AS col, {r('CASE WHEN m > 0 THEN pred END')} AS pred, {r('CASE WHEN m > 0 THEN value END')} AS value
 FROM p JOIN q USING (region, row, col) LEFT JOIN m USING (region, row, col)""")
def align_rasters(t):
    ref = t.reference_cells
    return rounded(R.align(t.pixels, ref.where(F.col("value") != -32767.0), ["region"], "pred", "value", 4, ref))


@query("resample_average", f"""SELECT patch_num, CAST(row // 8 AS INT) AS row, CAST(col // 8 AS INT) AS col, {r('avg(reference_height)')} AS reference_height FROM footprints GROUP BY ALL""")
def resample_average(t):
    cells = t.footprints.select("patch_num", R.coarse_cell("row", 8).alias("row"), R.coarse_cell("col", 8).alias("col"), "reference_height")
    return rounded(R.average_to_grid(cells, CELL, "reference_height"))


@query("interpolate_points", f"""WITH f AS (SELECT fid, region, (35.0::DOUBLE - latitude) / 0.015625::DOUBLE - 0.5::DOUBLE AS fy, (longitude - 134.0::DOUBLE) / 0.015625::DOUBLE - 0.5::DOUBLE AS fx FROM footprints),
 k AS (SELECT fid, region, CAST(floor(fy) + dy AS INT) AS row, CAST(floor(fx) + dx AS INT) AS col,
   (CASE WHEN dy = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN dx = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) AS w
   FROM f, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
 SELECT region, fid, {r('sum(value * w) / sum(w)')} AS value FROM k JOIN (SELECT * FROM reference_cells WHERE value <> -32767) c USING (region, row, col) WHERE w > 0 GROUP BY region, fid""")
def interpolate_points(t):
    targets = t.footprints.select("fid", "region", ((F.lit(35.0) - F.col("latitude")) / RES - 0.5).alias("fy"),
                                  ((F.col("longitude") - 134.0) / RES - 0.5).alias("fx"))
    cells = t.reference_cells.where(F.col("value") != -32767.0)
    return rounded(R.bilinear(cells, targets, "value", ["region"], ["fid"], few=True))  # 64 x 64 cells a region


@query("resample_decimate", f"""WITH n AS (SELECT patch_num, CASE WHEN count(*) > 300 THEN CAST(ceil(sqrt(count(*) / 150.0::DOUBLE)) AS INT) ELSE 1 END AS f FROM pixels GROUP BY patch_num)
 SELECT patch_num, CAST(floor(row / f) AS INT) AS row, CAST(floor(col / f) AS INT) AS col, {r('avg("B4")')} AS "B4", max(f) AS factor
 FROM pixels JOIN n USING (patch_num) GROUP BY 1, 2, 3""")
def resample_decimate(t):
    return rounded(R.decimate(t.pixels, "B4", ["patch_num"], limit=300, target=150))


@query("add_reference_band", f"""WITH g AS (SELECT patch_num, row, col, avg(reference_height) AS v FROM footprints GROUP BY ALL)
 SELECT patch_num, row, col, {r('"B4"')} AS "B4", {r('coalesce(v, 0)')} AS reference_height FROM pixels LEFT JOIN g USING (patch_num, row, col)""")
def add_reference_band(t):
    ref = R.average_to_grid(t.footprints, CELL, "reference_height")
    px = t.pixels.select(*CELL, "B4").join(ref, CELL, "left")
    return rounded(px.withColumn("reference_height", F.coalesce("reference_height", F.lit(0.0))))


@query("bounds_overlap_gate", """WITH a AS (SELECT patch_num, min_x, min_y, max_x, max_y FROM patches WHERE region = '04hf3'),
 b AS (SELECT patch_num, min_x, min_y, max_x, max_y FROM patches WHERE region <> '04hf3')
 SELECT a.patch_num AS left_id, b.patch_num AS right_id, greatest(a.min_x, b.min_x) AS min_x, greatest(a.min_y, b.min_y) AS min_y,
 least(a.max_x, b.max_x) AS max_x, least(a.max_y, b.max_y) AS max_y FROM a, b
 WHERE a.min_x < b.max_x AND a.max_x > b.min_x AND a.min_y < b.max_y AND a.max_y > b.min_y""")
def bounds_overlap_gate(t):
    first = t.patches.where(F.col("region") == "04hf3")
    return P.overlapping_boxes(first, t.patches.where(F.col("region") != "04hf3"), "patch_num", "patch_num", 640.0)


@query("patch_neighbors", """SELECT a.patch_num AS left_id, b.patch_num AS right_id FROM patches a, patches b WHERE a.patch_num <> b.patch_num
 AND a.min_x - 10 <= b.max_x AND a.max_x + 10 >= b.min_x AND a.min_y - 10 <= b.max_y AND a.max_y + 10 >= b.min_y""")
def patch_neighbors(t):
    return P.neighbours(t.patches, 10.0, 640.0)


@query("grid_meets_patches", """WITH b AS (SELECT min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM patches),
 g AS (SELECT i, j, x0 + i * 230.0::DOUBLE AS min_x, y0 + j * 230.0::DOUBLE AS min_y, CAST(greatest(1, ceil((y1 - y0) / 230.0::DOUBLE)) AS BIGINT) AS ny
   FROM b, range(0, 100000) ii(i), range(0, 1000) jj(j) WHERE i < greatest(1, ceil((x1 - x0) / 230.0::DOUBLE)) AND j < greatest(1, ceil((y1 - y0) / 230.0::DOUBLE))),
 h AS (SELECT DISTINCT i * ny + j AS n, g.min_x, g.min_y FROM g JOIN patches p ON p.region = '05LE4' AND g.min_x < p.max_x AND g.min_x + 256 > p.min_x
   AND g.min_y < p.max_y AND g.min_y + 256 > p.min_y)
 SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS patch_no, min_x, min_y FROM h""")
def grid_meets_patches(t):
    from understory.operators.grids import numbered, stride_grid
    grid = stride_grid(P.bounds(t.patches), 256.0, 230.0)
    aoi = t.patches.where(F.col("region") == "05LE4")
    hits = P.overlapping_boxes(grid, aoi, "cell_no", "patch_num", 640.0).select(F.col("left_id").alias("cell_no")).distinct()
    return numbered(grid.join(hits, "cell_no", "left_semi"), "cell_no", "patch_no").select("patch_no", "min_x", "min_y")


AOI_SQL = """b AS (SELECT min(min_x) AS x0, min(min_y) AS y0, max(max_x) AS x1, max(max_y) AS y1 FROM patches),
 d AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b),
 e AS (SELECT x0 + u1 * w AS ax, y0 + v1 * h AS ay, x0 + u2 * w AS bx, y0 + v2 * h AS by_ FROM d, (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.125::DOUBLE), (1.0, 0.125, 1.0, 0.375), (1.0, 0.375, 0.375, 0.5),
   (0.375, 0.5, 0.25, 1.0), (0.25, 1.0, 0.0, 0.0), (0.125, 0.125, 0.25, 0.125), (0.25, 0.125, 0.25, 0.375), (0.25, 0.375, 0.125, 0.375), (0.125, 0.375, 0.125, 0.125)) v(u1, v1, u2, v2)),
 n AS (SELECT *, CAST(greatest(1, ceil(w / 230.0::DOUBLE)) AS BIGINT) AS nx, CAST(greatest(1, ceil(h / 230.0::DOUBLE)) AS BIGINT) AS ny FROM d),
 g AS (SELECT i * ny + j AS n, x0 + i * 230.0::DOUBLE AS min_x, y0 + j * 230.0::DOUBLE AS min_y FROM (SELECT *, unnest(range(ny)) AS j FROM (SELECT *, unnest(range(nx)) AS i FROM n))),
 c AS (SELECT g.*, ax, ay, bx, by_, (min_x - ax) * (by_ - ay) - (min_y - ay) * (bx - ax) AS s1, (min_x - ax) * (by_ - ay) - (min_y + 256 - ay) * (bx - ax) AS s2,
   (min_x + 256 - ax) * (by_ - ay) - (min_y - ay) * (bx - ax) AS s3, (min_x + 256 - ax) * (by_ - ay) - (min_y + 256 - ay) * (bx - ax) AS s4 FROM g, e),
 h AS (SELECT n, min_x, min_y FROM c GROUP BY ALL HAVING
   bool_or(least(ax, bx) <= min_x + 256 AND greatest(ax, bx) >= min_x AND least(ay, by_) <= min_y + 256 AND greatest(ay, by_) >= min_y AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0)
   OR count(*) FILTER (WHERE (ay > min_y) <> (by_ > min_y) AND min_x < ax + (bx - ax) * ((min_y - ay) / (by_ - ay))) % 2 = 1)"""

#: A concave area with a hole, in shares of the patches' box.
AOI = [[(0.0, 0.0), (1.0, 0.125), (1.0, 0.375), (0.375, 0.5), (0.25, 1.0)], [(0.125, 0.125), (0.25, 0.125), (0.25, 0.375), (0.125, 0.375)]]


@query("grid_intersects_aoi", f"WITH {AOI_SQL} SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS BIGINT) AS patch_no, min_x, min_y FROM h")
def grid_intersects_aoi(t):
    """Grid cells that meet a concave area with a hole, numbered in the order they are made."""
    from understory.operators import geometry as G
    from understory.operators.grids import numbered, stride_grid
    box = P.bounds(t.patches)
    rings = F.array(*[F.array(*[F.array(F.col("min_x") + u * (F.col("max_x") - F.col("min_x")), F.col("min_y") + v * (F.col("max_y") - F.col("min_y")))
                                for u, v in ring]) for ring in AOI])
    sides = G.edges(box.select(F.lit("aoi").alias("name"), rings.alias("rings")), ["name"])
    grid = stride_grid(box, 256.0, 230.0)
    hits = G.boxes_on_polygons(grid, sides, "cell_no", ["name"], 256.0).select("cell_no")
    return numbered(grid.join(hits, "cell_no", "left_semi"), "cell_no", "patch_no").select("patch_no", "min_x", "min_y")


@query("mask_point_filter", f"""WITH {LOCATED} SELECT fid, row, col FROM pts WHERE longitude BETWEEN 134 AND 134.5 AND latitude BETWEEN 34.25 AND 35
 AND (row, col) IN (SELECT (row, col) FROM reference_cells WHERE region = '04hf3' AND mask = 1)""")
def mask_point_filter(t):
    mask = t.reference_cells.where(F.col("region") == "04hf3")
    points = t.footprints.select("fid", "longitude", "latitude")
    return A.mask_points_in_bounds(points, mask, ["row", "col"], 134.0, 34.25, 134.5, 35.0, RES).select("fid", "row", "col")


@query("labelled_patches_only", """SELECT patch_num, region FROM patches WHERE patch_num IN (SELECT patch_num FROM pixels WHERE rh IS NOT NULL)
 AND patch_num IN (SELECT patch_num FROM pixels WHERE forest_mask > 0)""")
def labelled_patches_only(t):
    targets = t.pixels.where(F.col("rh").isNotNull())
    return A.labelled_patches(t.patches.select("patch_num", "region"), targets, t.pixels)


@query("points_to_cells", f"SELECT patch_num, row, col, {r('arg_min(rh, fid)')} AS rh FROM footprints WHERE rh IS NOT NULL GROUP BY patch_num, row, col")
def points_to_cells(t):
    return rounded(A.points_to_cells(t.footprints, CELL, "rh", ["fid"]))


@query("region_lookup", """SELECT path, coalesce(region_name, 'Unknown') AS region_name, coalesce(factor, 1.0::DOUBLE) AS factor FROM (
  SELECT path, CASE WHEN path LIKE '%dchm\\_04hf3%' ESCAPE '\\' THEN '04hf3' WHEN path LIKE '%dchm\\_05LE4%' ESCAPE '\\' THEN '05LE4'
  WHEN path LIKE '%dchm\\_09gd4%' ESCAPE '\\' THEN '09gd4' ELSE 'unknown' END AS region FROM files) LEFT JOIN regions USING (region)""")
def region_lookup(t):
    from understory.functions.exprs import region_of
    return A.with_region(t.files.select("path", region_of("path").alias("region")), t.regions).select("path", "region_name", "factor")


PAIRS = f"""src AS (SELECT p.region, patch_num, row, col, reference_height AS ref, pred / factor AS corrected FROM pixels p JOIN regions USING (region)),
 {sigma_sql('src', 'region, patch_num', 'ref', 'corrected', '50')}"""


@query("prediction_reference_pairs", f"WITH {PAIRS} SELECT region, patch_num, row, col, {r('ref')} AS reference_height, {r('corrected')} AS pred FROM sk")
def prediction_reference_pairs(t):
    pairs = A.prediction_pairs(t.pixels.select("region", *CELL, "hkey", "pred", "reference_height"), t.regions, "pred", "reference_height")
    return rounded(pairs.select("region", *CELL, "reference_height", "pred"))


@query("scenario_evaluation", f"WITH {PAIRS} SELECT region, {eval_sql('ref', 'corrected')} FROM sk GROUP BY region HAVING count(*) > 50")
def scenario_evaluation(t):
    pairs = A.prediction_pairs(t.pixels.select("region", *CELL, "hkey", "pred", "reference_height"), t.regions, "pred", "reference_height")
    return rounded(M.evaluation_metrics(pairs, "reference_height", "pred", ["region"], 51))


@query("ensemble_training_pairs", f"""SELECT patch_num, row, col, {r('pred')} AS pred, {r('pred_b')} AS pred_b, {r('reference_height')} AS reference_height FROM (
  SELECT *, count(*) OVER (PARTITION BY patch_num) AS n FROM pixels WHERE reference_height > 0 AND reference_height <= 100 AND pred IS NOT NULL AND pred_b IS NOT NULL) WHERE n >= 10""")
def ensemble_training_pairs(t):
    return rounded(A.ensemble_pairs(t.pixels, "pred", "pred_b", "reference_height").select(*CELL, "pred", "pred_b", "reference_height"))


def shift_sql(shifts, wrap: bool, low: str = "rh > 0 AND rh < 100") -> str:
    values = ", ".join(f"({dx}, {dy})" for dx, dy in shifts)
    row, col = "t.row + dy", "t.col + dx"
    if wrap:
        row, col = f"(({row}) % 64 + 64) % 64", f"(({col}) % 64 + 64) % 64"
    return f"""sp AS (SELECT t.patch_num, dx, dy, p.row, p.col, t.rh AS target, p.pred FROM (SELECT * FROM pixels WHERE {low}) t, (VALUES {values}) o(dx, dy),
  (SELECT patch_num, row, col, pred FROM pixels WHERE pred IS NOT NULL) p WHERE p.patch_num = t.patch_num AND p.row = {row} AND p.col = {col})"""


LOSS = "(CASE WHEN d < 1 THEN 0.5::DOUBLE * d * d ELSE d - 0.5::DOUBLE END)"


@query("shift_aware_join", f"""WITH {shift_sql(A.square_shifts(2), False)} SELECT patch_num, dx, dy, count(*) AS n, {r('sum(target)', 7)} AS target_sum, {r('sum(pred)', 7)} AS pred_sum
 FROM sp GROUP BY patch_num, dx, dy""")
def shift_aware_join(t):
    sums = A.shift_sums(t.pixels, "rh", "pred", A.square_shifts(2), 64)
    return rounded(sums.select("patch_num", "dx", "dy", "n", "target_sum", "pred_sum"), 7)


@query("shift_aware_loss", f"""WITH {shift_sql(A.square_shifts(2), False)},
 l AS (SELECT patch_num, dx, dy, avg({LOSS}) AS loss FROM (SELECT *, abs(pred - target) AS d FROM sp) GROUP BY ALL),
 b AS (SELECT patch_num, min(loss) AS loss, arg_min((dx, dy), (round(loss, 9), dx, dy)) AS s FROM l GROUP BY patch_num)
 SELECT p.patch_num, {r('coalesce(loss, 10)')} AS loss, s[1] AS dx, s[2] AS dy FROM (SELECT DISTINCT patch_num FROM pixels) p LEFT JOIN b USING (patch_num)""")
def shift_aware_loss(t):
    losses = A.shift_losses(A.shift_sums(t.pixels, "rh", "pred", A.square_shifts(2), 64, bound=1000.0))
    return rounded(A.best_shift_loss(t.pixels, losses))


@query("shift_aware_loss_disc", f"""WITH {shift_sql(A.disc_shifts(1), True)},
 l AS (SELECT patch_num, dx, dy, avg({LOSS}) AS loss FROM (SELECT *, abs(pred - target) AS d FROM sp) GROUP BY ALL)
 SELECT patch_num, {r('min(loss)')} AS loss FROM l GROUP BY patch_num""")
def shift_aware_loss_disc(t):
    losses = A.shift_losses(A.shift_sums(t.pixels, "rh", "pred", A.disc_shifts(1), 64, wrap=True))
    return rounded(losses.groupBy("patch_num").agg(F.min("loss").alias("loss")))


@query("shift_aware_loss_roll", f"""WITH {shift_sql(A.square_shifts(1), True, 'rh > 0')},
 l AS (SELECT patch_num, dx, dy, avg({LOSS}) AS loss FROM (SELECT *, abs(pred - target) AS d FROM sp) GROUP BY ALL)
 SELECT {r('min(m)')} AS loss FROM (SELECT avg(loss) AS m FROM l GROUP BY dx, dy)""")
def shift_aware_loss_roll(t):
    return rounded(A.rolled_prediction_loss(t.pixels, "rh", "pred", 1, 64))
