"""Queries that relate texture to footprint accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from understory.functions.exprs import agreement
from understory.functions.stats import NORMAL_CRITICAL
from understory.operators import cleaning as C, texture as X
from understory.plans.projections import TEXTURES, clean_texture_sql
from understory.plans.registry import query
from understory.plans.shape import rounded
from understory.plans.views import r
from understory.session import written
from understory.plans.metrics import r2_sql, rmse_sql, t_sql


def cleaned(t):
    """Cleaned rows, written once: every later step of the analysis reads them again."""
    rows = C.clean_texture(t.footprints, TEXTURES)
    return written(rows.select("fid", "reference_height", "rh", *X.ACCURACY, *TEXTURES), "clean-texture")


CLEAN = clean_texture_sql()
LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS texture, {c} AS v, height_difference AS d, height_agreement::INT::DOUBLE AS a, relative_error AS e, bias AS b FROM tex WHERE {c} IS NOT NULL"
    for c in TEXTURES) + ")"
CORR = """co AS (SELECT texture, count(*) AS n_samples, corr(v, d) AS cd, corr(v, a) AS ca, corr(v, e) AS ce, corr(v, b) AS cb,
  avg(v) AS tm, stddev_pop(v) AS ts, min(v) AS t0, max(v) AS t1 FROM long GROUP BY texture HAVING count(*) > 100)"""


def critical(level: float) -> str:
    """Student critical value by expansion around the normal one, independent of the p-value code."""
    z = NORMAL_CRITICAL[level]
    a, b = (z ** 3 + z) / 4, (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96
    return f"({z} + {a} / (n_samples - 2) + {b} / ((n_samples - 2) * (n_samples - 2)))"


def t_of(c: str) -> str:
    return f"abs({t_sql(c, 'n_samples')})"


RANKS = """rk AS (SELECT texture, rank() OVER (PARTITION BY texture ORDER BY v) + (count(*) OVER (PARTITION BY texture, v) - 1) / 2.0 AS rv,
   rank() OVER (PARTITION BY texture ORDER BY d) + (count(*) OVER (PARTITION BY texture, d) - 1) / 2.0 AS rd,
   rank() OVER (PARTITION BY texture ORDER BY a) + (count(*) OVER (PARTITION BY texture, a) - 1) / 2.0 AS ra FROM long),
 sp AS (SELECT texture, corr(rv, rd) AS sd, corr(rv, ra) AS sa FROM rk GROUP BY texture)"""


@query("texture_correlations", f"""WITH {CLEAN}, {LONG}, {CORR}, {RANKS}
 SELECT texture, n_samples, {r('cd')} AS corr_height_diff, {r('ca')} AS corr_agreement, {r('ce')} AS corr_rel_error, {r('cb')} AS corr_bias,
 {r('tm')} AS texture_mean, {r('ts')} AS texture_std, {r('t0')} AS texture_min, {r('t1')} AS texture_max,
 {r(t_sql('cd', 'n_samples'), 4)} AS t_height_diff, {r(t_sql('ca', 'n_samples'), 4)} AS t_agreement, {r(t_sql('ce', 'n_samples'), 4)} AS t_rel_error,
 {r(t_sql('cb', 'n_samples'), 3)} AS t_bias, {r('sd')} AS spearman_height_diff, {r('sa')} AS spearman_agreement FROM co JOIN sp USING (texture)""")
def texture_correlations(t):
    rows = C.clean_texture(t.footprints, TEXTURES).select("reference_height", "rh", *TEXTURES)
    rows = written(rows, "clean-texture").withColumns(agreement("reference_height", "rh"))  # these columns are cheaper made than written
    out = X.texture_correlations(rows, TEXTURES)
    return rounded(out.withColumns({**{f"t_{s}": F.round(f"t_{s}", 4) for s in ("height_diff", "agreement", "rel_error")},
                                    "t_bias": F.round("t_bias", 3)}))


@query("significance_level", f"""WITH {CLEAN}, {LONG}, {CORR}
 SELECT texture, {r('cd')} AS corr_height_diff, CASE WHEN {t_of('cd')} > {critical(0.001)} THEN '***' WHEN {t_of('cd')} > {critical(0.01)} THEN '**'
  WHEN {t_of('cd')} > {critical(0.05)} THEN '*' ELSE '' END AS level FROM co ORDER BY abs(cd) DESC""")
def significance_level(t):
    out = X.with_p_values(X.texture_correlations(cleaned(t), TEXTURES, ranks=False))
    return rounded(out.orderBy(F.desc(F.abs("corr_height_diff"))).select(
        "texture", "corr_height_diff", X.significance("p_height_diff").alias("level")))


SIGNIFICANT = f"""sg0 AS (SELECT texture, {t_of('cd')} > {critical(0.05)} OR {t_of('ca')} > {critical(0.05)} AS ok FROM co),
 sg AS (SELECT texture FROM sg0 WHERE ok OR NOT (SELECT bool_or(ok) FROM sg0))"""
SEARCH = f"""{CLEAN}, {LONG}, {CORR}, {SIGNIFICANT},
 lg AS (SELECT * FROM long WHERE texture IN (SELECT texture FROM sg)),
 ct AS (SELECT texture, unnest([10, 25, 50, 75, 90]) AS percentile, unnest(quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9])) AS threshold FROM lg GROUP BY texture),
 dr AS (SELECT *, unnest(['above', 'below']) AS direction FROM ct),
 hit AS (SELECT dr.*, lg.d, lg.a FROM dr JOIN lg ON dr.texture = lg.texture AND ((direction = 'above' AND v >= threshold) OR (direction = 'below' AND v <= threshold))),
 ba AS (SELECT texture, count(*) AS n, avg(a) AS agree, avg(d) AS diff FROM lg GROUP BY texture),
 fs AS (SELECT h.texture, percentile, direction, threshold, count(*) AS n_samples, count(*) / max(n) AS retention_rate, avg(a) AS agreement_rate,
  avg(d) AS mean_height_diff, quantile_cont(d, 0.5) AS median_height_diff, stddev_pop(d) AS std_height_diff, avg(a) - max(agree) AS agreement_improvement,
  max(diff) - avg(d) AS height_diff_reduction FROM hit h JOIN ba USING (texture) GROUP BY h.texture, percentile, direction, threshold
  HAVING count(*) >= 50 AND max(n) >= 100),
 sc AS (SELECT *, 0.4::DOUBLE * agreement_improvement + 0.3::DOUBLE * (-mean_height_diff / 10) + 0.3::DOUBLE * (retention_rate - 0.5::DOUBLE) AS quality_score FROM fs)"""
FILTER_COLS = ["threshold", "retention_rate", "agreement_rate", "mean_height_diff", "median_height_diff", "std_height_diff",
               "agreement_improvement", "height_diff_reduction"]


def searched(t, rows=None):
    rows = cleaned(t) if rows is None else rows
    chosen = X.significant(X.with_p_values(X.texture_correlations(rows, TEXTURES, ranks=False)))
    return X.filter_search(rows, TEXTURES, written(chosen.select("texture"), "chosen-textures"))


@query("texture_filter_search", f"WITH {SEARCH} SELECT texture, percentile, direction, n_samples, {', '.join(f'{r(c)} AS {c}' for c in FILTER_COLS)} FROM sc")
def texture_filter_search(t):
    return rounded(searched(t))


@query("texture_filter_score", f"WITH {SEARCH} SELECT texture, percentile, direction, {r('quality_score')} AS quality_score FROM sc")
def texture_filter_score(t):
    return rounded(X.scored(searched(t)).select("texture", "percentile", "direction", "quality_score")
                   .orderBy(F.desc("quality_score")))


BEST = "SELECT * FROM sc ORDER BY round(quality_score, 9) DESC, texture, percentile, direction LIMIT {k}"


@query("top_filters", f"WITH {SEARCH} SELECT texture, percentile, direction, {r('threshold')} AS threshold, {r('quality_score')} AS quality_score FROM ({BEST.format(k=10)})")
def top_filters(t):
    return rounded(X.best_filters(searched(t), 10).select("texture", "percentile", "direction", "threshold", "quality_score"))


@query("top_textures", f"WITH {CLEAN}, {LONG}, {CORR} SELECT texture, {r('cd')} AS corr_height_diff FROM co ORDER BY cd LIMIT 5")
def top_textures(t):
    return rounded(X.texture_correlations(cleaned(t), TEXTURES, ranks=False).orderBy("corr_height_diff").limit(5)
                   .select("texture", "corr_height_diff"))


@query("texture_report", f"""WITH {CLEAN}, {LONG}, {CORR}, {SIGNIFICANT} SELECT (SELECT count(*) FROM co) AS n_textures, (SELECT count(*) FROM sg0 WHERE ok) AS n_significant,
 {r('avg(cd)')} AS mean_corr, {r('avg(ca)')} AS mean_corr_agreement, {r('min(cd)')} AS lowest_corr, arg_min(texture, cd) AS lowest_texture,
 arg_max(texture, abs(cd)) AS strongest_texture, {r('max(abs(cd))')} AS strongest_abs_corr FROM co""")
def texture_report(t):
    return rounded(X.report(X.with_p_values(X.texture_correlations(cleaned(t), TEXTURES, ranks=False))))


# ``SUMMARY`` applies the best filter by a value column built from its texture name.
VALUE = "CASE bt " + " ".join(f"WHEN '{c}' THEN {c}" for c in TEXTURES) + " END"
SUMMARY = f"""WITH {SEARCH}, be AS ({BEST.format(k=1)}),
 rw AS (SELECT *, {VALUE} AS bv FROM (SELECT tex.*, be.texture AS bt, be.threshold AS bc, be.direction AS bd FROM tex, be)),
 lb AS (SELECT 'no_filter' AS scenario, * FROM rw WHERE bv IS NOT NULL UNION ALL SELECT 'filtered', * FROM rw WHERE (bd = 'above' AND bv >= bc) OR (bd = 'below' AND bv <= bc)),
 sm AS (SELECT scenario, count(*) AS n_samples, avg(height_agreement::INT) AS agreement_rate, avg(height_difference) AS mean_height_diff,
  stddev_samp(height_difference) AS std_height_diff, corr(reference_height, rh) AS correlation, {r2_sql('reference_height', 'rh')} AS r2_score,
  {rmse_sql('reference_height', 'rh')} AS rmse, quantile_cont(height_difference, 0.5) AS median_height_diff FROM lb GROUP BY scenario)"""
MEASURES = ["agreement_rate", "mean_height_diff", "std_height_diff", "correlation", "r2_score", "rmse", "median_height_diff"]


def summarised(t):
    rows = cleaned(t)
    best = written(X.best_filters(searched(t, rows), 1), "best-filter")
    return X.agreement_summary(rows, best, TEXTURES)


@query("agreement_summary", f"{SUMMARY} SELECT scenario, n_samples, {', '.join(f'{r(c)} AS {c}' for c in MEASURES)} FROM sm")
def agreement_summary(t):
    return rounded(summarised(t))


CHANGES = f"""{SUMMARY}, ch AS (SELECT max(CASE WHEN scenario = 'filtered' THEN n_samples END) / max(CASE WHEN scenario = 'no_filter' THEN n_samples END) AS retention_rate,
 {', '.join(f"max(CASE WHEN scenario = 'filtered' THEN {c} END) - max(CASE WHEN scenario = 'no_filter' THEN {c} END) AS {c}_change" for c in MEASURES)} FROM sm)"""


CHANGE_COLS = ", ".join(f"{r(c + '_change')} AS {c}_change" for c in MEASURES)


@query("scenario_improvement", f"{CHANGES} SELECT {r('retention_rate')} AS retention_rate, {CHANGE_COLS} FROM ch")
def scenario_improvement(t):
    return rounded(X.improvement(summarised(t)))


@query("hypothesis_checks", f"{CHANGES} SELECT agreement_rate_change > 0 AS agreement_up, correlation_change > 0 AS correlation_up, mean_height_diff_change < 0 AS difference_down FROM ch")
def hypothesis_checks(t):
    return X.hypotheses(X.improvement(summarised(t)))
