"""Queries for accuracy metrics, correlations and distributions, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions import fixed
from understory.functions.exprs import between
from understory.operators import metrics as M
from understory.operators.cleaning import clean_heights, quality_footprints
from understory.plans.flagship import flagship, regional_accuracy
from understory.plans.registry import query
from understory.plans.shape import round_half_away, rounded
from understory.plans.views import r

# ---- pieces of check SQL ----------------------------------------------------------

def r2_sql(truth: str, other: str) -> str:
    return f"(1 - sum(({truth} - {other}) * ({truth} - {other})) / nullif(var_pop({truth}) * count({truth}), 0))"


def rmse_sql(x: str, y: str) -> str:
    return f"sqrt(avg(({x} - {y}) * ({x} - {y})))"


def pair_sql(x: str, y: str) -> str:
    return (f"count(*) AS n_samples, {r(f'corr({y}, {x})')} AS pearson_r, {r(r2_sql(x, y))} AS r2_score, "
            f"{r(rmse_sql(x, y))} AS rmse, {r(f'avg(abs({x} - {y}))')} AS mae, {r(f'avg({y} - {x})')} AS bias, "
            f"{r(f'regr_slope({y}, {x})')} AS slope, {r(f'regr_intercept({y}, {x})')} AS intercept, "
            f"{r(f'avg({x})')} AS x_mean, {r(f'avg({y})')} AS y_mean, "
            f"{r(f'stddev_pop({x})')} AS x_std, {r(f'stddev_pop({y})')} AS y_std")


def eval_sql(ref: str, pred: str) -> str:
    return (f"count(*) AS n_samples, {r(r2_sql(ref, pred))} AS r2, {r(rmse_sql(ref, pred))} AS rmse, "
            f"{r(f'avg(abs({pred} - {ref}))')} AS mae, {r(f'avg({pred} - {ref})')} AS bias, "
            f"{r(f'corr({ref}, {pred})')} AS correlation, {r(f'avg({ref})')} AS ref_mean, "
            f"{r(f'avg({pred})')} AS pred_mean, {r(f'stddev_pop({ref})')} AS ref_std, "
            f"{r(f'stddev_pop({pred})')} AS pred_std")


def t_sql(c: str = "corr(y, x)", n: str = "count(*)") -> str:
    return f"({c} * sqrt(({n} - 2) / nullif(1 - {c} * {c}, 0)))"


def clean_sql(source: str, others=fixed.HEIGHT_COLUMNS[1:]) -> str:
    nulls = ", ".join(f"CASE WHEN {c} BETWEEN 0 AND 100 THEN {c} END AS {c}" for c in others)
    return (f"SELECT * REPLACE ({nulls}) FROM (SELECT * FROM {source} WHERE reference_height > 0 AND reference_height <= 100) "
            f"WHERE abs(reference_height - (SELECT avg(reference_height) FROM {source} WHERE reference_height > 0 AND reference_height <= 100)) "
            f"< 3 * (SELECT stddev_samp(reference_height) FROM {source} WHERE reference_height > 0 AND reference_height <= 100)")


QUALITY_SQL = ("rh > 0 AND quality_flag = 1 AND degrade_flag = 0 AND sensitivity > 0.95::DOUBLE AND beam > 4 "
               "AND solar_elevation <= 0 AND num_detectedmodes > 0")
PRODUCTS = fixed.HEIGHT_COLUMNS[1:]


def long_sql(source: str, columns, keep: str, name: str = "product", value: str = "value") -> str:
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep}'{c}' AS {name}, {c} AS {value} FROM {source} WHERE {c} IS NOT NULL" for c in columns)


def pairs_sql(source: str, columns) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS height1, '{b}' AS height2, {a} AS x, {b} AS y FROM {source} "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a in columns for b in columns if a != b)


QUALITY = f"good AS (SELECT * FROM footprints WHERE {QUALITY_SQL})"
REGIONAL = f"""{QUALITY}, clean AS ({clean_sql('good')}),
 long AS ({long_sql('clean', PRODUCTS, 'region, reference_height')}),
 enough AS (SELECT product FROM long GROUP BY product HAVING count(*) > 100),
 big AS (SELECT region FROM clean GROUP BY region HAVING count(*) >= 50),
 reg AS (SELECT region, product, count(*) AS n_samples, corr(value, reference_height) AS pearson_r,
   {r2_sql('reference_height', 'value')} AS r2_score, {rmse_sql('reference_height', 'value')} AS rmse
   FROM long WHERE product IN (SELECT product FROM enough) AND region IN (SELECT region FROM big)
   GROUP BY region, product HAVING count(*) >= 10)"""

SCENARIO_DF_SQL = f"""scen AS (
  SELECT 'Embedding' AS scenario, region, reference_height AS ref, rh AS pred FROM footprints
  UNION ALL SELECT 'Original', region, reference_height, ch_lang2022 FROM footprints),
 results AS (SELECT scenario, region, count(*) AS n_samples, {r2_sql('ref', 'pred')} AS r2,
   {rmse_sql('ref', 'pred')} AS rmse, avg(pred - ref) AS bias FROM scen
   WHERE ref IS NOT NULL AND pred IS NOT NULL GROUP BY scenario, region)"""


def scenario_results(t):
    both = (t.footprints.select(F.lit("Embedding").alias("scenario"), "region",
                                F.col("reference_height").alias("ref"), F.col("rh").alias("pred"))
            .unionByName(t.footprints.select(F.lit("Original").alias("scenario"), "region",
                                             F.col("reference_height").alias("ref"),
                                             F.col("ch_lang2022").alias("pred"))))
    return M.evaluation_metrics(both, "ref", "pred", ["scenario", "region"]).select(
        "scenario", "region", "n_samples", "r2", "rmse", "bias")


# ---- regional accuracy -------------------------------------------------------------

@query("regional_summary", f"""WITH {REGIONAL}
SELECT product, {r('avg(pearson_r)', 3)} AS pearson_r_mean, {r('stddev_samp(pearson_r)', 3)} AS pearson_r_std,
 {r('avg(r2_score)', 3)} AS r2_mean, {r('stddev_samp(r2_score)', 3)} AS r2_std, {r('avg(rmse)', 3)} AS rmse_mean,
 {r('stddev_samp(rmse)', 3)} AS rmse_std, CAST(sum(n_samples) AS BIGINT) AS total_samples FROM reg GROUP BY product""")
def regional_summary(t):
    return flagship(t.footprints)


@query("region_variation", f"""WITH {REGIONAL} SELECT {r('avg(s)')} AS mean_r_variation
 FROM (SELECT stddev_samp(pearson_r) AS s FROM reg GROUP BY product)""")
def region_variation(t):
    return rounded(M.region_variation(M.regional_summary(regional_accuracy(t.footprints))))


@query("regional_metrics", f"""WITH {QUALITY}, clean AS ({clean_sql('good')}),
 long AS ({long_sql('clean', PRODUCTS, 'region, reference_height AS x', value='y')}),
 enough AS (SELECT product FROM long GROUP BY product HAVING count(*) > 100),
 big AS (SELECT region FROM clean GROUP BY region HAVING count(*) >= 50)
SELECT region, product, {pair_sql('x', 'y')}, {r(t_sql(), 3)} AS t_stat
FROM long WHERE product IN (SELECT product FROM enough) AND region IN (SELECT region FROM big)
GROUP BY region, product HAVING count(*) >= 10""")
def regional_metrics(t):
    out = regional_accuracy(t.footprints)
    return rounded(out.withColumn("t_stat", F.round("t_stat", 3)))


@query("metric_pivot", f"""WITH {REGIONAL} SELECT product,
 {r("max(CASE WHEN region = '04hf3' THEN r2_score END)")} AS "04hf3",
 {r("max(CASE WHEN region = '05LE4' THEN r2_score END)")} AS "05LE4",
 {r("max(CASE WHEN region = '09gd4' THEN r2_score END)")} AS "09gd4" FROM reg GROUP BY product""")
def metric_pivot(t):
    codes = [code for code, _, _ in fixed.REGIONS]
    return rounded(M.metric_pivot(regional_accuracy(t.footprints), "product", "region", codes, "r2_score"))


@query("top_products", f"""WITH clean AS ({clean_sql('footprints')}),
 p AS (SELECT * FROM ({pairs_sql('clean', fixed.HEIGHT_COLUMNS)}) WHERE height1 = 'reference_height'),
 m AS (SELECT height2, corr(y, x) AS pearson_r, {r2_sql('x', 'y')} AS r2_score, {rmse_sql('x', 'y')} AS rmse FROM p GROUP BY height2)
SELECT height2, {r('pearson_r')} AS pearson_r, {r('r2_score')} AS r2_score, {r('rmse')} AS rmse FROM m ORDER BY m.pearson_r DESC LIMIT 3""")
def top_products(t):
    long = M.stacked(clean_heights(t.footprints), ["reference_height"], PRODUCTS, "height2")
    table = M.pair_metrics(long, "reference_height", "value", ["height2"])
    return rounded(table.orderBy(F.desc("pearson_r")).limit(3)
                   .select("height2", "pearson_r", "r2_score", "rmse"))


@query("correlation_matrix", f"""WITH clean AS ({clean_sql('footprints')}),
 p AS ({pairs_sql('clean', fixed.HEIGHT_COLUMNS)}),
 rk AS (SELECT height1, height2, x, y,
   rank() OVER (PARTITION BY height1, height2 ORDER BY x) + (count(*) OVER (PARTITION BY height1, height2, x) - 1) / 2.0 AS rx,
   rank() OVER (PARTITION BY height1, height2 ORDER BY y) + (count(*) OVER (PARTITION BY height1, height2, y) - 1) / 2.0 AS ry FROM p)
SELECT height1, height2, {pair_sql('x', 'y')}, {r(t_sql(), 3)} AS t_stat, {r('corr(rx, ry)')} AS spearman_r
FROM rk GROUP BY height1, height2 HAVING count(*) > 100""")
def correlation_matrix(t):
    out = M.correlation_matrix(clean_heights(t.footprints))
    return rounded(out.withColumn("t_stat", F.round("t_stat", 3)))


# ---- error metrics -----------------------------------------------------------------

@query("regression_metrics", f"""SELECT region, count(*) AS n, {r('avg((rh - reference_height) * (rh - reference_height))')} AS mse,
 {r(rmse_sql('reference_height', 'rh'))} AS rmse, {r('avg(abs(rh - reference_height))')} AS mae,
 {r(r2_sql('reference_height', 'rh'))} AS r2, {r('avg(rh - reference_height)')} AS mean_error,
 {r('stddev_pop(rh - reference_height)')} AS std_error, {r('max(abs(rh - reference_height))')} AS max_abs_error,
 {r('avg(CASE WHEN abs(rh - reference_height) <= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS within_1m,
 {r('avg(CASE WHEN abs(rh - reference_height) <= 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS within_2m,
 {r('avg(CASE WHEN abs(rh - reference_height) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100')} AS within_5m
 FROM footprints GROUP BY region""")
def regression_metrics(t):
    return rounded(M.regression_metrics(t.footprints, "rh", "reference_height", ["region"]))


@query("pair_metrics", f"""WITH rk AS (SELECT reference_height AS x, rh AS y,
   rank() OVER (ORDER BY reference_height) + (count(*) OVER (PARTITION BY reference_height) - 1) / 2.0 AS rx,
   rank() OVER (ORDER BY rh) + (count(*) OVER (PARTITION BY rh) - 1) / 2.0 AS ry FROM footprints)
SELECT {pair_sql('x', 'y')}, {r(t_sql(), 3)} AS t_stat, {r('corr(rx, ry)')} AS spearman_r,
 {r(t_sql('corr(rx, ry)'), 3)} AS spearman_t FROM rk""")
def pair_metrics(t):
    out = M.with_spearman(M.pair_metrics(t.footprints, "reference_height", "rh"),
                          t.footprints, "reference_height", "rh", [])
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("t_stat", "spearman_t")}))


@query("height_error_analysis", f"""WITH long AS ({long_sql('footprints', PRODUCTS, 'reference_height AS x', value='y')})
SELECT product, count(*) AS n, {r('corr(y, x)')} AS correlation, {r(rmse_sql('x', 'y'))} AS rmse, {r('avg(abs(y - x))')} AS mae,
 {r('avg(y - x)')} AS bias, {r('corr(y, x) * corr(y, x)')} AS r_squared, {r('regr_slope(y, x)')} AS slope,
 {r('regr_intercept(y, x)')} AS intercept, {r('stddev_pop(y - x)')} AS error_std,
 {r('quantile_cont(y - x, 0.05)')} AS error_p5, {r('quantile_cont(y - x, 0.25)')} AS error_p25,
 {r('quantile_cont(y - x, 0.5)')} AS error_p50, {r('quantile_cont(y - x, 0.75)')} AS error_p75,
 {r('quantile_cont(y - x, 0.95)')} AS error_p95 FROM long WHERE x <> -32767 GROUP BY product HAVING count(*) >= 2""")
def height_error_analysis(t):
    return rounded(M.height_errors(t.footprints, PRODUCTS))


@query("evaluation_metrics", f"""SELECT region, {eval_sql('reference_height', 'rh')} FROM footprints
 GROUP BY region HAVING count(*) >= 10""")
def evaluation_metrics(t):
    return rounded(M.evaluation_metrics(t.footprints, "reference_height", "rh", ["region"]))


def sigma_sql(source: str, keys: str, ref: str, aux: str, minimum: str) -> str:
    """Three-sigma cleaning of both sides per group, as a chain of common table expressions."""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""sv AS (SELECT *, count(*) OVER ({part}) AS _n, avg({ref}) OVER ({part}) AS _rm,
   stddev_pop({ref}) OVER ({part}) AS _rs, avg({aux}) OVER ({part}) AS _am, stddev_pop({aux}) OVER ({part}) AS _as
   FROM {source} WHERE {ref} IS NOT NULL AND {aux} IS NOT NULL),
 si AS (SELECT * FROM sv WHERE _n >= {minimum} AND abs({ref} - _rm) < 3 * _rs AND abs({aux} - _am) < 3 * _as
   AND {ref} > 0 AND {ref} <= 100 AND {aux} >= 0 AND {aux} <= 100),
 sk AS (SELECT * FROM (SELECT *, count(*) OVER ({part}) AS _m FROM si) WHERE _m >= {minimum})"""


def clean_metrics_sql(ref: str, aux: str) -> str:
    return (f"count(*) AS n_samples, {r(r2_sql(ref, aux))} AS r2, {r(rmse_sql(ref, aux))} AS rmse, "
            f"{r(f'avg({aux} - {ref})')} AS bias, {r(f'avg({ref})')} AS ref_mean, {r(f'avg({aux})')} AS aux_mean, "
            f"{r(f'stddev_pop({ref})')} AS ref_std, {r(f'stddev_pop({aux})')} AS aux_std")


@query("sigma_filter_pair", f"""WITH {sigma_sql('footprints', 'region', 'reference_height', 'rh', '50')}
 SELECT fid, region, reference_height, {r('rh')} AS rh FROM sk""")
def sigma_filter_pair(t):
    kept = M.sigma_filter_pair(t.footprints.select("fid", "region", "reference_height", "rh"),
                               "reference_height", "rh", ["region"], few=True)
    return rounded(kept.select("fid", "region", "reference_height", "rh"))


@query("clean_metrics", f"""WITH {sigma_sql('footprints', 'region', 'reference_height', 'rh', '50')}
 SELECT region, {clean_metrics_sql('reference_height', 'rh')} FROM sk GROUP BY region""")
def clean_metrics(t):
    return rounded(M.clean_metrics(t.footprints, "reference_height", "rh", ["region"], few=True))


# ---- scenarios ---------------------------------------------------------------------

@query("scenario_summary", f"""WITH {SCENARIO_DF_SQL} SELECT scenario,
 {r('avg(r2)')} AS r2_mean, {r('stddev_samp(r2)')} AS r2_std, {r('min(r2)')} AS r2_min, {r('max(r2)')} AS r2_max,
 {r('avg(rmse)')} AS rmse_mean, {r('stddev_samp(rmse)')} AS rmse_std, {r('min(rmse)')} AS rmse_min, {r('max(rmse)')} AS rmse_max,
 {r('avg(bias)')} AS bias_mean, {r('stddev_samp(bias)')} AS bias_std, CAST(sum(n_samples) AS BIGINT) AS n_samples_sum
 FROM results GROUP BY scenario""")
def scenario_summary(t):
    return rounded(M.scenario_summary(scenario_results(t)))


@query("scenario_r2_gain", f"""WITH {SCENARIO_DF_SQL}, g AS (SELECT
 avg(CASE WHEN scenario LIKE '%Embedding%' THEN r2 END) AS b, avg(CASE WHEN scenario LIKE '%Original%' THEN r2 END) AS o FROM results)
 SELECT {r('b')} AS better_r2, {r('o')} AS base_r2, {r('b - o')} AS gain, {r('(b - o) / nullif(o, 0)')} AS gain_ratio FROM g""")
def scenario_r2_gain(t):
    return rounded(M.scenario_gain(scenario_results(t), "Embedding", "Original"))


@query("weighted_overall_r2", f"""WITH {SCENARIO_DF_SQL} SELECT scenario, count(*) AS total_regions,
 CAST(sum(n_samples) AS BIGINT) AS total_pixels, {r('sum(r2 * n_samples) / nullif(sum(n_samples), 0)')} AS overall_r2,
 {r('max(r2)')} AS best_r2 FROM results WHERE scenario = 'Embedding' GROUP BY scenario""")
def weighted_overall_r2(t):
    mine = scenario_results(t).where(F.col("scenario") == "Embedding")
    return rounded(M.weighted_r2(mine).withColumn("scenario", F.lit("Embedding")))


@query("same_grid_metrics", f"""SELECT region, {eval_sql('reference_height', 'pred')} FROM pixels
 WHERE reference_height > 0 AND pred IS NOT NULL GROUP BY region""")
def same_grid_metrics(t):
    return rounded(M.grid_metrics(t.pixels, "reference_height", "pred", ["region"]))


@query("baseline_delta", f"""WITH {SCENARIO_DF_SQL}, base AS (SELECT * FROM (VALUES
   ('04hf3', -89.09::DOUBLE, 38.26::DOUBLE), ('09gd4', -99.95::DOUBLE, 45.97::DOUBLE)) b(region, base_r2, base_rmse))
 SELECT region, {r('r2')} AS r2, {r('rmse')} AS rmse, {r('r2 - base_r2')} AS r2_gain, {r('base_rmse - rmse')} AS rmse_reduction
 FROM results LEFT JOIN base USING (region) WHERE scenario = 'Embedding'""")
def baseline_delta(t):
    # R2 and RMSE of the baseline scenario per region.
    baseline = t.spark.createDataFrame(
        [("04hf3", -89.09, 38.26), ("09gd4", -99.95, 45.97)], "region string, base_r2 double, base_rmse double")
    mine = scenario_results(t).where(F.col("scenario") == "Embedding")
    return rounded(M.baseline_delta(mine, baseline, "region"))


@query("patch_eval_same_grid", f"""WITH ok AS (SELECT *, count(*) OVER (PARTITION BY patch_num) AS _n FROM pixels
   WHERE pred > 0 AND pred < 100 AND reference_height > 0 AND reference_height < 100),
 kept AS (SELECT * FROM ok WHERE _n > 50)
 SELECT region, {eval_sql('reference_height', 'pred')}, {r(rmse_sql('reference_height', 'pred') + ' / avg(reference_height) * 100')} AS relative_rmse,
 {r('min(pred)')} AS pred_min, {r('max(pred)')} AS pred_max, {r('min(reference_height)')} AS ref_min,
 {r('max(reference_height)')} AS ref_max, count(DISTINCT patch_num) AS n_patches
 FROM kept GROUP BY region HAVING count(*) > 10""")
def patch_eval_same_grid(t):
    from understory.operators.evaluation import pooled_patch_metrics
    return rounded(pooled_patch_metrics(t.pixels, "reference_height", "pred", "patch_num", ["region"]))


@query("ensemble_eval", f"""WITH ok AS (SELECT * FROM pixels WHERE reference_height > 0 AND reference_height <= 100 AND pred > -50 AND pred <= 100),
 gate AS (SELECT region, patch_num FROM ok GROUP BY region, patch_num HAVING count(*) > 10),
 kept AS (SELECT ok.* FROM ok JOIN gate USING (region, patch_num))
 SELECT region, patch_num, {eval_sql('reference_height', 'pred')} FROM kept GROUP BY region, patch_num
 UNION ALL SELECT region, NULL, {eval_sql('reference_height', 'pred')} FROM kept GROUP BY region""")
def ensemble_eval(t):
    from understory.operators.evaluation import patch_and_region_metrics
    return rounded(patch_and_region_metrics(t.pixels, "reference_height", "pred", "patch_num", "region"))


BAND_SQL = " UNION ALL ".join(
    f"SELECT region, patch_num, '{fixed.HEIGHT_SOURCES[c]}' AS source, reference_height AS ref, {c} AS aux FROM {{src}} "
    f"WHERE {c} IS NOT NULL AND reference_height > 0" + (" AND rh > 0" if c == "rh" else "")
    for c in fixed.HEIGHT_SOURCES)
GATE_SQL = "(CASE WHEN source = 'GEDI' THEN 5 ELSE 50 END)"


@query("band_vs_reference_full", f"""WITH holding AS (SELECT patch_num FROM pixels GROUP BY patch_num HAVING count(rh) > 0),
 src AS (SELECT * FROM pixels WHERE patch_num IN (SELECT patch_num FROM holding)),
 long AS (SELECT * FROM ({BAND_SQL.format(src='src')}) WHERE aux > 0),
 {sigma_sql('long', 'region, source', 'ref', 'aux', '50')}
 SELECT region, source, {clean_metrics_sql('ref', 'aux')} FROM sk GROUP BY region, source""")
def band_vs_reference_full(t):
    from understory.operators.evaluation import bands_against_reference, patches_with_footprints
    px = t.pixels.join(patches_with_footprints(t.pixels), "patch_num", "left_semi")
    long = bands_against_reference(px).where(F.col("aux") > 0)
    return rounded(M.clean_metrics(long, "ref", "aux", ["region", "source"], few=True))


@query("band_vs_reference_sample", f"""WITH counts AS (SELECT region, patch_num, count(*) FILTER (WHERE rh > 0) AS c FROM pixels GROUP BY region, patch_num),
 top AS (SELECT region, patch_num FROM counts WHERE c > 0 QUALIFY row_number() OVER (PARTITION BY region ORDER BY c DESC, patch_num) <= 3),
 src AS (SELECT pixels.* FROM pixels JOIN top USING (region, patch_num)),
 long AS ({BAND_SQL.format(src='src')}),
 {sigma_sql('long', 'region, source', 'ref', 'aux', GATE_SQL)}
 SELECT region, source, {clean_metrics_sql('ref', 'aux')} FROM sk GROUP BY region, source""")
def band_vs_reference_sample(t):
    from understory.operators.evaluation import bands_against_reference, densest_patches, source_gate
    px = t.pixels.join(densest_patches(t.pixels, 3), ["region", "patch_num"], "left_semi")
    return rounded(M.clean_metrics(bands_against_reference(px), "ref", "aux", ["region", "source"], source_gate(), few=True))


@query("band_vs_reference_patch", f"""WITH long AS ({BAND_SQL.format(src='pixels')}),
 {sigma_sql('long', 'region, source, patch_num', 'ref', 'aux', GATE_SQL)}
 SELECT region, source, patch_num, {clean_metrics_sql('ref', 'aux')} FROM sk GROUP BY region, source, patch_num""")
def band_vs_reference_patch(t):
    from understory.operators.evaluation import bands_against_reference, source_gate
    return rounded(M.clean_metrics(bands_against_reference(t.pixels), "ref", "aux",
                                   ["region", "source", "patch_num"], source_gate()))


@query("densest_patches", """WITH counts AS (SELECT region, patch_num, count(*) FILTER (WHERE rh > 0) AS n_rh FROM pixels GROUP BY region, patch_num)
 SELECT region, patch_num, n_rh FROM counts WHERE n_rh > 0 QUALIFY row_number() OVER (PARTITION BY region ORDER BY n_rh DESC, patch_num) <= 3""")
def densest(t):
    from understory.operators.evaluation import densest_patches
    return densest_patches(t.pixels, 3)


# ---- distributions -----------------------------------------------------------------

@query("prediction_stats", f"""SELECT region, count(*) AS total_pixels, count(v) AS valid_pixels, {r('avg(v)')} AS mean_height,
 {r('stddev_pop(v)')} AS std_height, {r('min(v)')} AS min_height, {r('max(v)')} AS max_height,
 {r('count(v) * 100.0 / count(*)')} AS coverage_percent, {r('quantile_cont(v, 0.25)')} AS p25, {r('quantile_cont(v, 0.5)')} AS p50,
 {r('quantile_cont(v, 0.75)')} AS p75, {r('quantile_cont(v, 0.9)')} AS p90, {r('quantile_cont(v, 0.95)')} AS p95
 FROM (SELECT region, CASE WHEN pred > 0 THEN pred END AS v FROM predictions) GROUP BY region""")
def prediction_stats(t):
    return rounded(M.value_statistics(t.predictions, "pred", ["region"], [0.25, 0.5, 0.75, 0.9, 0.95]))


@query("patch_prediction_stats", f"""WITH v AS (SELECT region, patch_num, pred, CASE WHEN pred > 0 THEN pred END AS v FROM predictions)
 SELECT region, patch_num, count(*) AS total_pixels, count(v) AS valid_pixels, {r('count(v) * 100.0 / count(*)')} AS coverage,
 {r('coalesce(min(v), 0)')} AS min_height, {r('coalesce(max(v), 0)')} AS max_height, {r('coalesce(avg(v), 0)')} AS mean_height,
 {r('coalesce(stddev_pop(v), 0)')} AS std_height FROM v GROUP BY region, patch_num
 UNION ALL SELECT region, NULL, count(*), count(v), {r('count(v) * 100.0 / count(*)')}, {r('coalesce(min(v), 0)')},
 {r('coalesce(max(v), 0)')}, {r('coalesce(avg(v), 0)')}, {r('coalesce(stddev_pop(v), 0)')} FROM v GROUP BY region""")
def patch_prediction_stats(t):
    from understory.operators.evaluation import patch_and_region_statistics
    return rounded(patch_and_region_statistics(t.predictions, "pred", "region", "patch_num"))


MOSAIC_CLASSES = ", ".join(
    f"count(*) FILTER (WHERE v >= {low} AND v < {top}) AS count_{low:g}_{top:g}m, {r(f'count(*) FILTER (WHERE v >= {low} AND v < {top}) * 100.0 / count(v)')} AS percent_{low:g}_{top:g}m"
    for low, top in zip(fixed.MOSAIC_EDGES, fixed.MOSAIC_EDGES[1:]))


@query("mosaic_stats", f"""WITH v AS (SELECT CASE WHEN pred > 0 THEN pred END AS v FROM predictions)
 SELECT count(*) AS total_pixels, count(v) AS valid_pixels, {r('avg(v)')} AS mean_height, {r('stddev_pop(v)')} AS std_height,
 {r('min(v)')} AS min_height, {r('max(v)')} AS max_height, {r('count(v) * 100.0 / count(*)')} AS coverage_percent,
 {r('quantile_cont(v, 0.5)')} AS p50, count(*) FILTER (WHERE v > 30) AS tall_count,
 {r('count(*) FILTER (WHERE v > 30) * 100.0 / count(v)')} AS tall_percent, {r('coalesce(max(v) FILTER (WHERE v > 30), 0)')} AS tall_max, {MOSAIC_CLASSES} FROM v""")
def mosaic_stats(t):
    from understory.operators.evaluation import mosaic_statistics
    return rounded(mosaic_statistics(t.predictions, "pred"))


@query("mosaic_height_classes", f"""WITH v AS (SELECT pred AS v FROM predictions WHERE pred > 0),
 c AS (SELECT CASE WHEN v < 5 THEN 1 WHEN v < 10 THEN 2 WHEN v < 20 THEN 3 WHEN v < 30 THEN 4 WHEN v < 50 THEN 5 WHEN v < 100 THEN 6 ELSE 7 END AS class_no FROM v)
 SELECT class_no, count(*) AS count, {r('count(*) * 100.0 / (SELECT count(*) FROM v)')} AS percentage FROM c WHERE class_no < 7 GROUP BY class_no""")
def mosaic_height_classes(t):
    return rounded(M.class_histogram(t.predictions, "pred", fixed.MOSAIC_EDGES))


@query("mosaic_compare", f"""WITH a AS (SELECT count(*) FILTER (WHERE pred > 0) AS v1, coalesce(avg(pred) FILTER (WHERE pred > 0), 0) AS m1,
  count(*) FILTER (WHERE pred_b > 0) AS v2, coalesce(avg(pred_b) FILTER (WHERE pred_b > 0), 0) AS m2 FROM pixels)
 SELECT v1 AS first_valid, v2 AS second_valid, v2 - v1 AS coverage_gain, {r('(v2 - v1) * 100.0 / nullif(v1, 0)')} AS coverage_gain_pct,
 {r('m1')} AS first_mean, {r('m2')} AS second_mean FROM a""")
def mosaic_compare(t):
    from understory.operators.evaluation import compare_mosaics
    return rounded(compare_mosaics(t.pixels.select("patch_num", "row", "col", F.col("pred").alias("value")),
                                   t.pixels.select("patch_num", "row", "col", F.col("pred_b").alias("value"))))


@query("valid_area_ha", f"""SELECT region, count(*) FILTER (WHERE value > 0) AS valid_cells,
 {r('count(*) FILTER (WHERE value > 0) * (111320.0::DOUBLE * cos(radians(34.5::DOUBLE)) / 64) * (111320.0::DOUBLE / 64) / 10000', 3)} AS area_ha
 FROM reference_cells GROUP BY region""")
def valid_area_ha(t):
    from understory.operators.evaluation import valid_area
    out = valid_area(t.reference_cells, F.col("value") > 0, ["region"], 1 / 64, centre_lat=34.5)
    return out.withColumn("area_ha", F.round("area_ha", 3))


def hist_sql(source: str, value: str, keys: str = "") -> str:
    k = keys + ", " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"{k}bin, lo, hi, n"
    return f"""SELECT {k}bin, {r('lo + bin * ((hi - lo) / 50.0::DOUBLE)')} AS left_edge, count(*) AS count,
 {r('count(*) / (n * ((hi - lo) / 50.0::DOUBLE))')} AS density FROM (
  SELECT {k}lo, hi, n, CAST(least(floor((v - lo) * 50.0::DOUBLE / (hi - lo)), 49) AS INT) AS bin FROM (
   SELECT {k}{value} AS v, min({value}) OVER ({part}) AS lo, max({value}) OVER ({part}) AS hi,
     count(*) OVER ({part}) AS n FROM {source} WHERE {value} IS NOT NULL)) GROUP BY {g}"""


@query("error_histogram", hist_sql("(SELECT rh - reference_height AS e FROM footprints)", "e"))
def error_histogram(t):
    return rounded(M.histogram(t.footprints.select((F.col("rh") - F.col("reference_height")).alias("e")), "e"))


@query("error_summary", f"""SELECT {r('avg(rh - reference_height)')} AS mean_error,
 {r('stddev_pop(rh - reference_height)')} AS std_error FROM footprints""")
def error_summary(t):
    e = F.col("rh") - F.col("reference_height")
    return rounded(t.footprints.agg(F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error")))


@query("height_histogram", hist_sql(
    "(SELECT 'reference_height' AS side, reference_height AS v0 FROM footprints UNION ALL SELECT 'rh', rh FROM footprints)", "v0", "side"))
def height_histogram(t):
    return rounded(M.histogram(M.stacked(t.footprints, [], ["reference_height", "rh"], "side", "v0"), "v0", 50, ["side"]))


@query("density_grid", """WITH s AS (SELECT min(reference_height) AS x0, max(reference_height) AS x1, min(rh) AS y0, max(rh) AS y1 FROM footprints)
 SELECT CAST(least(floor((reference_height - x0) * 30.0::DOUBLE / (x1 - x0)), 29) AS INT) AS x_bin,
 CAST(least(floor((rh - y0) * 30.0::DOUBLE / (y1 - y0)), 29) AS INT) AS y_bin, count(*) AS count FROM footprints, s GROUP BY 1, 2""")
def density_grid(t):
    return M.density_grid(t.footprints, "reference_height", "rh")


@query("trend_line", f"""SELECT region, {r('regr_slope(rh, reference_height)')} AS slope, {r('regr_intercept(rh, reference_height)')} AS intercept
 FROM footprints GROUP BY region""")
def trend_line(t):
    return rounded(M.trend_line(t.footprints, "reference_height", "rh", ["region"]))


@query("color_range", f"""WITH b AS (SELECT reference_height AS v FROM pixels UNION ALL SELECT pred * 1.5::DOUBLE FROM pixels)
 SELECT {r('greatest(0, quantile_cont(v, 0.01))')} AS low, {r('least(50, quantile_cont(v, 0.99))')} AS high FROM b WHERE v > 0 AND v <= 50""")
def color_range(t):
    return rounded(M.color_range(t.pixels, "pred", "reference_height", 1.5))


@query("bias_ratio", f"SELECT region, {r('avg(rh) / avg(reference_height)')} AS bias_ratio FROM footprints GROUP BY region")
def bias_ratio(t):
    return rounded(M.bias_ratio(t.footprints, "rh", "reference_height", "region"))


@query("region_counts", """SELECT region, count(*) AS n, count(DISTINCT patch_num) AS n_patches FROM footprints GROUP BY region""")
def region_counts(t):
    return t.footprints.groupBy("region").agg(F.count(F.lit(1)).alias("n"),
                                              F.countDistinct("patch_num").alias("n_patches"))


@query("class_weights", f"""WITH c AS (SELECT fid, reference_height, CAST((reference_height >= 0)::INT + (reference_height >= 5)::INT + (reference_height >= 10)::INT
  + (reference_height >= 15)::INT + (reference_height >= 20)::INT + (reference_height >= 30)::INT + (reference_height >= 50)::INT + (reference_height >= 100)::INT AS INT) AS class_no FROM footprints),
 k AS (SELECT class_no, count(*) AS c FROM c GROUP BY class_no)
 SELECT fid, class_no, {r('(SELECT sum(c) FROM k) / ((SELECT count(*) FROM k) * k.c)')} AS weight FROM c JOIN k USING (class_no)""")
def class_weights(t):
    return rounded(M.class_weights(t.footprints.select("fid", "reference_height"), "reference_height")
                   .select("fid", "class_no", "weight"))


LOSS = "(CASE WHEN abs({d}) < 1 THEN 0.5::DOUBLE * ({d}) * ({d}) ELSE abs({d}) - 0.5::DOUBLE END)"


@query("huber_weighted", f"""SELECT region, {r("avg((1.0::DOUBLE + 0.1::DOUBLE * reference_height / 30.0) * " + LOSS.format(d='rh - reference_height') + ")")} AS loss
 FROM footprints GROUP BY region""")
def huber_weighted(t):
    return rounded(t.footprints.groupBy("region").agg(M.huber_weighted("rh", "reference_height").alias("loss")))


@query("masked_loss", f"""SELECT patch_num, {r("coalesce(avg(" + LOSS.format(d='pred - rh') + ") FILTER (WHERE rh > 0 AND pred IS NOT NULL), 0)")} AS loss
 FROM pixels GROUP BY patch_num""")
def masked_loss(t):
    return rounded(t.pixels.groupBy("patch_num").agg(
        M.masked_loss("pred", "rh", between("rh", 0) & F.col("pred").isNotNull()).alias("loss")))


AUC_SQL = """auc AS (SELECT (sum(CASE WHEN y = 1 THEN rk END) - max(np) * (max(np) + 1) / 2.0) / (max(np) * max(nn)) AS auc FROM (
  SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk,
   sum(y) OVER () AS np, count(*) OVER () - sum(y) OVER () AS nn FROM lab))"""
LAB_SQL = "lab AS (SELECT CASE WHEN abs(reference_height - rh) <= 5 THEN 1 ELSE 0 END AS y, sensitivity - mean_corr / 2 AS s FROM footprints)"


def labelled(t):
    return t.footprints.select(
        (F.abs(F.col("reference_height") - F.col("rh")) <= fixed.AGREEMENT_M).cast("int").alias("y"),
        (F.col("sensitivity") - F.col("mean_corr") / 2).alias("s"))


@query("classifier_metrics", f"""WITH {LAB_SQL}, {AUC_SQL}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND s > 0.7::DOUBLE) AS tp,
  count(*) FILTER (WHERE y = 0 AND s > 0.7::DOUBLE) AS fp, count(*) FILTER (WHERE y = 1 AND s <= 0.7::DOUBLE) AS fn,
  count(*) FILTER (WHERE y = 0 AND s <= 0.7::DOUBLE) AS tn FROM lab)
 SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy, {r('tp / nullif(tp + fp, 0)')} AS precision,
 {r('tp / nullif(tp + fn, 0)')} AS recall, {r('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1, {r('auc')} AS auc FROM c, auc""")
def classifier_metrics(t):
    return rounded(M.classifier_metrics(labelled(t), "y", "s", 0.7))


@query("roc_curve", f"""WITH {LAB_SQL}, c AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM lab GROUP BY s)
 SELECT {r('s', 9)} AS threshold, {r('sum(n) OVER (ORDER BY s DESC) / (sum(n) OVER ())')} AS fpr,
 {r('sum(p) OVER (ORDER BY s DESC) / (sum(p) OVER ())')} AS tpr FROM c""")
def roc_curve(t):
    out = M.roc_points(labelled(t), "y", "s")
    return out.select(round_half_away(F.col("threshold"), 9).alias("threshold"), round_half_away(F.col("fpr"), 6).alias("fpr"), round_half_away(F.col("tpr"), 6).alias("tpr"))
