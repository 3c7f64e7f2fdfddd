"""Texture against height accuracy: correlations, threshold search and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions import stats
from understory.operators.metrics import spearman_of_columns, stacked
from understory.operators.order import exact_quantiles, exact_quantiles_of_slots, value_counts
from understory.session import written

PERCENTILES = [10, 25, 50, 75, 90]
ACCURACY = ["height_difference", "height_agreement", "relative_error", "bias"]
SHORT = {"height_difference": "height_diff", "height_agreement": "agreement",
         "relative_error": "rel_error", "bias": "bias"}


def long_textures(df: DataFrame, textures: Sequence[str], keep: Sequence[str] = ACCURACY) -> DataFrame:
    rows = df.withColumn("height_agreement", F.col("height_agreement").cast("double"))
    return stacked(rows, keep, [t for t in textures if t in df.columns], "texture", "v")


def texture_correlations(df: DataFrame, textures: Sequence[str], min_values: int = 100,
                         min_pairs: int = 50, ranks: bool = True) -> DataFrame:
    """Correlation of each texture with the accuracy columns, with t statistics."""
    long = long_textures(df, textures)
    out = long.groupBy("texture").agg(
        F.count(F.lit(1)).alias("n_samples"),
        *[F.corr("v", a).alias(f"corr_{SHORT[a]}") for a in ACCURACY],
        F.avg("v").alias("texture_mean"), F.stddev_pop("v").alias("texture_std"),
        F.min("v").alias("texture_min"), F.max("v").alias("texture_max"),
    ).where((F.col("n_samples") > min_values) & (F.col("n_samples") >= min_pairs))
    out = out.withColumns({f"t_{SHORT[a]}": stats.t_statistic(f"corr_{SHORT[a]}", "n_samples") for a in ACCURACY})
    if ranks:
        present = [t for t in textures if t in df.columns]
        rows = df.withColumn("height_agreement", F.col("height_agreement").cast("double"))
        found = spearman_of_columns(rows, present, "height_difference", "height_agreement").select(
            F.col("name").alias("texture"), F.col("spearman_other").alias("spearman_height_diff"), F.col("spearman_few").alias("spearman_agreement"))
        out = out.join(F.broadcast(found), "texture", "left")  # one row per texture name
    return out


def with_p_values(correlations: DataFrame) -> DataFrame:
    return correlations.withColumns({f"p_{s}": stats.two_sided_p(f"t_{s}", "n_samples") for s in SHORT.values()})


def significance(p: str) -> Column:
    p = F.col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def significant(with_p: DataFrame, level: float = 0.05) -> DataFrame:
    """Textures significant on difference or agreement; all of them when none is."""
    ok = (F.col("p_height_diff") < level) | (F.col("p_agreement") < level)
    any_ok = with_p.agg(F.coalesce(F.bool_or(ok), F.lit(False))).scalar()
    return with_p.where(ok | ~any_ok)


def filter_search(df: DataFrame, textures: Sequence[str], chosen: DataFrame | None = None,
                  min_values: int = 100, min_kept: int = 50) -> DataFrame:
    """Every percentile threshold in both directions, per texture.

    A slot tells which thresholds a value passes. Sums and counts by value range are taken per slot, so the wide step works
    on these and on the few rows near a median.
    """
    keep = ["height_difference", "height_agreement"]
    long = long_textures(df, textures, keep)
    if chosen is not None:
        long = long.join(F.broadcast(chosen.select("texture")), "texture", "left_semi")  # one row per texture name
    cuts = written(exact_quantiles(long, ["texture"], "v", [p / 100 for p in PERCENTILES], "cuts"), "threshold-cuts")
    placed = written(long.join(F.broadcast(cuts), "texture").select(  # one row per texture name
        "texture", *keep,
        F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("n_below"),
        F.size(F.filter("cuts", lambda c: c <= F.col("v"))).alias("n_reached")), "threshold-slots")
    d, a, position = F.col("height_difference"), F.col("height_agreement"), F.col("p")

    def passing(rows: DataFrame) -> DataFrame:
        every = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(len(PERCENTILES) - 1))))
        return every.withColumn("direction", F.explode(F.filter(
            F.array(F.when(position < F.col("n_reached"), F.lit("above")),
                    F.when(position >= F.col("n_below"), F.lit("below"))), lambda d: d.isNotNull())))

    slot, keys = ["n_below", "n_reached"], ["texture", "p", "direction"]
    sums = written(placed.groupBy("texture", *slot).agg(
        F.count(F.lit(1)).alias("w"), F.sum(a).alias("sa"), F.sum(d).alias("sd"), F.sum(d * d).alias("sdd")), "threshold-sums")
    w, mean = F.sum("w"), F.sum("sd") / F.sum("w")
    kept = passing(sums).groupBy(*keys).agg(
        w.alias("n_samples"), (F.sum("sa") / w).alias("agreement_rate"), mean.alias("mean_height_diff"),
        F.sqrt(F.greatest(F.lit(0.0), F.sum("sdd") / w - mean * mean)).alias("std_height_diff"))
    kept = kept.join(F.broadcast(cuts), "texture").withColumn("threshold", F.get("cuts", F.col("p")))  # one row per texture name
    medians = exact_quantiles_of_slots(placed, ["texture"], slot, passing, keys, "height_difference", [0.5], "_m").select(
        *keys, F.get("_m", 0).alias("median_height_diff"))
    base = sums.groupBy("texture").agg(w.alias("_n"), (F.sum("sa") / w).alias("_agree"), mean.alias("_diff"))
    out = (kept.join(medians, keys).join(F.broadcast(base), "texture")  # one row per texture name
           .where((F.col("_n") >= min_values) & (F.col("n_samples") >= min_kept)))
    return out.select(
        "texture", F.get(F.array(*[F.lit(p) for p in PERCENTILES]), F.col("p")).alias("percentile"), "direction",
        "threshold", "n_samples", (F.col("n_samples") / F.col("_n")).alias("retention_rate"), "agreement_rate",
        "mean_height_diff", "median_height_diff", "std_height_diff",
        (F.col("agreement_rate") - F.col("_agree")).alias("agreement_improvement"),
        (F.col("_diff") - F.col("mean_height_diff")).alias("height_diff_reduction"))


def scored(filters: DataFrame) -> DataFrame:
    return filters.withColumn("quality_score", F.lit(0.4) * F.col("agreement_improvement")
                              + F.lit(0.3) * (-F.col("mean_height_diff") / 10.0)
                              + F.lit(0.3) * (F.col("retention_rate") - 0.5))


def best_filters(filters: DataFrame, k: int) -> DataFrame:
    return scored(filters).orderBy(F.desc(F.round("quality_score", 9)), "texture", "percentile", "direction").limit(k)


def agreement_summary(df: DataFrame, best: DataFrame, textures: Sequence[str],
                      ref: str = "reference_height", rh: str = "rh") -> DataFrame:
    """Accuracy of all rows with the best filter's texture, and of those it keeps."""
    rule = best.agg(F.struct(F.first("texture").alias("t"), F.first("threshold").alias("c"),
                             F.first("direction").alias("d")).alias("x")).scalar()
    value = F.coalesce(*[F.when(rule["t"] == t, F.col(t)) for t in textures])
    rows = df.withColumn("_v", value).where(F.col("_v").isNotNull())
    passes = F.when(rule["d"] == "above", F.col("_v") >= rule["c"]).otherwise(F.col("_v") <= rule["c"])
    labelled = rows.withColumn("scenario", F.explode(
        F.when(passes, F.array(F.lit("no_filter"), F.lit("filtered"))).otherwise(F.array(F.lit("no_filter")))))
    d = "height_difference"
    enough = F.count(F.lit(1)) > 10
    flat = labelled.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg(F.col("height_agreement").cast("double")).alias("agreement_rate"),
        F.avg(d).alias("mean_height_diff"), F.stddev_samp(d).alias("std_height_diff"),
        F.when(enough, F.corr(ref, rh)).otherwise(0.0).alias("correlation"),
        F.when(enough, stats.r2_score(ref, rh)).otherwise(0.0).alias("r2_score"),
        F.when(enough, stats.rmse(ref, rh)).otherwise(0.0).alias("rmse"))
    med = exact_quantiles(value_counts(labelled, ["scenario"], d), ["scenario"], d, [0.5], "_m", weight="n")
    return flat.join(med, "scenario").withColumn("median_height_diff", F.get("_m", 0)).drop("_m")


def improvement(summary: DataFrame) -> DataFrame:
    """Filtered minus unfiltered, from the two-row summary."""
    measures = [c for c in summary.columns if c not in ("scenario", "n_samples")]

    def side(name: str, c: str):
        return F.max(F.when(F.col("scenario") == name, F.col(c)))

    return summary.agg(
        (side("filtered", "n_samples") / side("no_filter", "n_samples")).alias("retention_rate"),
        *[(side("filtered", c) - side("no_filter", c)).alias(f"{c}_change") for c in measures])


def hypotheses(changes: DataFrame) -> DataFrame:
    return changes.select((F.col("agreement_rate_change") > 0).alias("agreement_up"),
                          (F.col("correlation_change") > 0).alias("correlation_up"),
                          (F.col("mean_height_diff_change") < 0).alias("difference_down"))


def report(with_p: DataFrame) -> DataFrame:
    """Counts and extremes of the texture correlations in one row."""
    ok = (F.col("p_height_diff") < 0.05) | (F.col("p_agreement") < 0.05)
    c = F.col("corr_height_diff")
    return with_p.agg(
        F.count(F.lit(1)).alias("n_textures"), F.count_if(ok).alias("n_significant"),
        F.avg(c).alias("mean_corr"), F.avg("corr_agreement").alias("mean_corr_agreement"),
        F.min(c).alias("lowest_corr"), F.min_by("texture", c).alias("lowest_texture"),
        F.max_by("texture", F.abs(c)).alias("strongest_texture"), F.max(F.abs(c)).alias("strongest_abs_corr"))
