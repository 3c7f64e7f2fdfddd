"""Accuracy, correlation and distribution operators over height pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from understory.functions import fixed, stats
from understory.functions.exprs import as_col, between, clip, equal_width_bin, height_class, is_finite
from understory.session import written
from understory.operators.order import average_ranks, exact_quantiles, in_rank_ranges, one_group, rank_cuts, row_ranks, rows_below, value_counts


def _by(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys)


def stacked(df: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str = "product",
            value: str = "value") -> DataFrame:
    """Long form of several columns; NULL values are dropped, nothing is shuffled."""
    entries = F.array(*[F.struct(F.lit(c).alias("n"), F.col(c).cast("double").alias("v"))
                        for c in columns])
    return (df.select(*keep, F.explode(entries).alias("_e"))
            .select(*keep, F.col("_e.n").alias(name), F.col("_e.v").alias(value))
            .where(F.col(value).isNotNull()))


def finite_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both sides are finite numbers: neither NULL, NaN nor infinite."""
    return df.where(F.coalesce(is_finite(x) & is_finite(y), F.lit(False)))


# ---- metric tables --------------------------------------------------------------

def regression_metrics(df: DataFrame, pred: str, ref: str, keys: Sequence[str] = ()) -> DataFrame:
    return _by(finite_pairs(df, pred, ref), keys).agg(
        F.count(F.lit(1)).alias("n"), *stats.named(stats.prediction_errors(pred, ref)))


def pair_metrics(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), min_rows: int = 10) -> DataFrame:
    """Pearson, error and regression statistics; groups under ``min_rows`` give no row."""
    return (_by(finite_pairs(df, x, y), keys)
            .agg(F.count(F.lit(1)).alias("n_samples"), *stats.named(stats.pair_statistics(x, y)))
            .where(F.col("n_samples") >= min_rows)
            .withColumn("t_stat", stats.t_statistic("pearson_r", "n_samples")))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, spearman_r): correlation of average ranks.

    Equal (x, y) pairs are combined first; ranks come from counts of distinct values, and
    the correlation is formed from ranks centred on their known mean.
    """
    from understory.operators.order import null_safe_keys

    df, group = null_safe_keys(finite_pairs(df, x, y), keys)
    # read by both rankings and the final join, so it is written once instead of recomputed
    pairs = written(df.groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("w")), "rank-pairs")
    rx = average_ranks(pairs, group, x, "rx", "w").select(*group, x, "rx", "n_total")
    ry = average_ranks(pairs, group, y, "ry", "w").select(*group, y, "ry")
    centre = (F.col("n_total") + 1) / 2.0
    joined = (pairs.join(rx, [*group, x]).join(ry, [*group, y])
              .withColumn("_a", F.col("rx") - centre).withColumn("_b", F.col("ry") - centre))
    w, a, b = F.col("w"), F.col("_a"), F.col("_b")
    out = joined.groupBy(*group).agg(F.try_divide(
        F.sum(w * a * b), F.sqrt(F.sum(w * a * a)) * F.sqrt(F.sum(w * b * b))).alias("spearman_r"))
    return out.select(*keys, "spearman_r")


def spearman_of_columns(df: DataFrame, columns: Sequence[str], other: str, few: str) -> DataFrame:
    """(name, spearman_other, spearman_few): ``spearman`` of each column with ``other`` and with ``few``, which has few values.

    The wide rows move once, by ranges of ``other``, which gives each column's ranks of it over the rows where the column is
    finite. Then a row of each column moves by ranges of its own value unless that is a frequent one. Only small tables are written.
    """
    rows = finite_pairs(df, other, few).select(other, few, *[F.col(c).cast("double").alias(c) for c in columns])
    rows = rows.withColumn("_g", one_group(other))
    placed = in_rank_ranges(rows, rank_cuts(rows, ["_g"], other), ["_g"], other)
    has = [F.when(is_finite(c), 1).otherwise(0) for c in columns]
    slot = ["_part", "_tied"]
    counted = placed.groupBy("_g", *slot).agg(*[F.sum(h).alias(f"_n{i}") for i, h in enumerate(has)])
    below = {k: v for i in range(len(has)) for k, v in rows_below(counted, ["_g"], f"_n{i}").items()}
    slots = written(counted.withColumns(below).drop("_g"), "rank-ranges")
    # rows of a frequent value need no order, so they are dealt over many tasks
    deal = F.when(F.col("_tied"), F.xxhash64(*columns) % 1024).otherwise(F.lit(0))
    moved = placed.drop("_g").withColumn("_deal", deal)
    inside, alike = W.partitionBy(*slot, "_deal").orderBy(other), W.partitionBy(*slot, "_deal", other)
    ranked = moved.withColumns({f"_c{i}": F.sum(h).over(inside) - (F.sum(h).over(alike) - 1) / 2.0 for i, h in enumerate(has)})
    ranked = ranked.join(F.broadcast(slots), slot)  # some hundred rows
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v"), (
        F.col(f"_n{i}_off") + F.when(F.col("_tied"), (F.col(f"_n{i}") + 1) / 2.0).otherwise(F.col(f"_c{i}"))
        - (F.col(f"_n{i}_total") + 1) / 2.0).alias("_b")) for i, c in enumerate(columns)])
    long = ranked.select(few, F.explode(entries).alias("_e")).select(few, "_e.*").where(is_finite("v"))
    base = stacked(rows, [few], columns, "name", "v").where(is_finite("v"))
    of_few = written(average_ranks(base, ["name"], few, "_d").select("name", few, "_d"), "few-ranks")
    both = row_ranks(long, base, ["name"], "v", "_rx", "_total").join(F.broadcast(of_few), ["name", few])  # a row per column and value
    centre = (F.col("_total") + 1) / 2.0
    a, b, d = F.col("_rx") - centre, F.col("_b"), F.col("_d") - centre
    return both.groupBy("name").agg(*[
        F.try_divide(F.sum(a * y), F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(y * y))).alias(out) for y, out in ((b, "spearman_other"), (d, "spearman_few"))])


def with_spearman(metrics: DataFrame, df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Attach rank correlation to a metrics table with the same keys."""
    ranks = spearman(df, x, y, keys)
    joined = metrics.join(ranks, list(keys)) if keys else _pair_rows(metrics, ranks)
    return joined.withColumn("spearman_t", stats.t_statistic("spearman_r", "n_samples"))


def _pair_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Put two one-row tables side by side."""
    return (left.withColumn("_one", one_group(left.columns[0])).join(right.withColumn("_one", one_group(right.columns[0])), "_one")
            .drop("_one"))


def with_p_values(metrics: DataFrame) -> DataFrame:
    """Two-sided p-values for the t statistics present."""
    out = metrics.withColumn("pearson_p", stats.two_sided_p("t_stat", "n_samples"))
    if "spearman_t" in metrics.columns:
        out = out.withColumn("spearman_p", stats.two_sided_p("spearman_t", "n_samples"))
    return out


def evaluation_metrics(df: DataFrame, ref: str, pred: str, keys: Sequence[str] = (),
                       min_rows: int = 10) -> DataFrame:
    return (_by(finite_pairs(df, ref, pred), keys)
            .agg(F.count(F.lit(1)).alias("n_samples"),
                 *stats.named(stats.evaluation_statistics(ref, pred)))
            .where(F.col("n_samples") >= min_rows))


def height_errors(df: DataFrame, columns: Sequence[str], ref: str = "reference_height",
                  nodata: float = -32767.0) -> DataFrame:
    """Error statistics of each height column; R-squared is the squared correlation."""
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    if not isinstance(columns, (list, tuple)):
        raise TypeError("columns must be a list")
    if ref not in df.columns:
        raise ValueError(f"reference column '{ref}' not found")
    present = [c for c in columns if c in df.columns]
    long = stacked(df.where(F.col(ref).isNotNull() & (F.col(ref) != nodata)), [ref], present)
    x, y = F.col(ref), F.col("value")
    long = long.withColumn("_e", y - x)
    flat = (long.groupBy("product").agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("correlation"),
        stats.rmse(x, y).alias("rmse"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias"),
        F.pow(F.corr(x, y), F.lit(2.0)).alias("r_squared"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.stddev_pop("_e").alias("error_std")).where(F.col("n") >= 2))
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    cuts = exact_quantiles(long, ["product"], "_e", probs, "_q")
    return flat.join(cuts, "product").select(
        *flat.columns,
        *[F.get("_q", i).alias(f"error_p{round(p * 100)}") for i, p in enumerate(probs)])


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (height1, height2, x, y) for every ordered pair of columns with both values."""
    entries = [F.struct(F.lit(a).alias("height1"), F.lit(b).alias("height2"),
                        F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
               for a in columns for b in columns if a != b]
    return finite_pairs(df.select(F.inline(F.array(*entries))), "x", "y")


def correlation_matrix(df: DataFrame, columns: Sequence[str] = fixed.HEIGHT_COLUMNS,
                       min_values: int = 100, min_pairs: int = 10, ranks: bool = True) -> DataFrame:
    """Pair statistics of every ordered pair of columns that hold more than ``min_values`` values.

    R-squared is not symmetric, so both orders are kept. Rows are widened inside the map
    stage and combined there; only one partial row per pair and task is shuffled. Rank
    correlation is symmetric and is computed once per unordered pair.
    """
    present = [c for c in columns if c in df.columns]
    pairs = correlation_pairs(df, present)
    enough = (stacked(df, [], present).groupBy("product").agg(F.count(F.lit(1)).alias("k"))
              .where(F.col("k") > min_values))
    keys = ["height1", "height2"]
    out = pair_metrics(pairs, "x", "y", keys, min_pairs)
    for side in keys:
        out = out.join(enough.select(F.col("product").alias(side)), side, "left_semi")
    if ranks:
        one_way = spearman(pairs.where(F.col("height1") < F.col("height2")), "x", "y", keys)
        both = one_way.unionByName(one_way.select(
            F.col("height2").alias("height1"), F.col("height1").alias("height2"), "spearman_r"))
        out = out.join(both, keys, "left")
    return out


def regional_metrics(df: DataFrame, region: str = "region", ref: str = "reference_height",
                     columns: Sequence[str] = fixed.HEIGHT_COLUMNS[1:], min_region: int = 50,
                     min_values: int = 100, min_pairs: int = 10) -> DataFrame:
    """Pair statistics per region and product.

    Products need more than ``min_values`` values overall, regions ``min_region`` rows.
    """
    present = [c for c in columns if c in df.columns]
    long = stacked(df, [region, ref], present)
    sizes = df.groupBy(region).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_region)
    enough = (long.groupBy("product").agg(F.count(F.lit(1)).alias("_k"))
              .where(F.col("_k") > min_values))
    return (pair_metrics(long, ref, "value", [region, "product"], min_pairs)
            .join(sizes.select(region), region, "left_semi")
            .join(enough.select("product"), "product", "left_semi"))


def regional_summary(regional: DataFrame) -> DataFrame:
    """Mean and sample deviation over regions per product."""
    return regional.groupBy("product").agg(
        F.avg("pearson_r").alias("pearson_r_mean"), F.stddev_samp("pearson_r").alias("pearson_r_std"),
        F.avg("r2_score").alias("r2_mean"), F.stddev_samp("r2_score").alias("r2_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"),
        F.sum("n_samples").alias("total_samples"))


def region_variation(summary: DataFrame) -> DataFrame:
    return summary.agg(F.avg("pearson_r_std").alias("mean_r_variation"))


def metric_pivot(metrics: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    return metrics.groupBy(row).pivot(column, list(values)).agg(F.first(metric))


def scenario_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("scenario").agg(
        *[f(c).alias(f"{c}_{n}") for c in ("r2", "rmse")
          for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
        F.avg("bias").alias("bias_mean"), F.stddev_samp("bias").alias("bias_std"),
        F.sum("n_samples").alias("n_samples_sum"))


def scenario_gain(results: DataFrame, better: str, base: str) -> DataFrame:
    """Mean R2 of scenarios whose name contains ``better`` minus those containing ``base``."""
    name = F.col("scenario")
    both = results.agg(F.avg(F.when(name.contains(better), F.col("r2"))).alias("better_r2"),
                       F.avg(F.when(name.contains(base), F.col("r2"))).alias("base_r2"))
    gain = F.col("better_r2") - F.col("base_r2")
    return both.select("better_r2", "base_r2", gain.alias("gain"),
                       F.try_divide(gain, F.col("base_r2")).alias("gain_ratio"))


def weighted_r2(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total_regions"), F.sum("n_samples").alias("total_pixels"),
        F.try_divide(F.sum(F.col("r2") * F.col("n_samples")), F.sum("n_samples")).alias("overall_r2"),
        F.max("r2").alias("best_r2"))


def grid_metrics(df: DataFrame, ref: str, pred: str, keys: Sequence[str]) -> DataFrame:
    """Pooled same-grid metrics of cells with a positive reference."""
    return evaluation_metrics(df.where(F.col(ref) > 0), ref, pred, keys, min_rows=1)


def baseline_delta(results: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Change against a fixed per-key baseline (key, base_r2, base_rmse); a lookup table."""
    return results.join(F.broadcast(baseline), key, "left").select(
        key, "r2", "rmse", (F.col("r2") - F.col("base_r2")).alias("r2_gain"),
        (F.col("base_rmse") - F.col("rmse")).alias("rmse_reduction"))


# ---- cleaning that depends on the data's own spread -----------------------------

def within_sigma(c: str, mean: Column, std: Column, k: float = 3.0) -> Column:
    return F.abs(F.col(c) - mean) < F.lit(k) * std


def sigma_filter_pair(df: DataFrame, ref: str, aux: str, keys: Sequence[str] = (),
                      min_rows: int | Column = 50, few: bool = False) -> DataFrame:
    """Keep rows within three population deviations on both sides and inside height limits.

    ``min_rows`` is a number or a column over the keys. Groups with fewer than ``min_rows`` rows before or after are dropped whole. The
    statistics are one aggregate row per group, joined back; no group is gathered. With ``few`` groups no row is moved.
    """
    from understory.operators.order import _ALL, join_groups, null_safe_keys

    valid, group = null_safe_keys(finite_pairs(df, ref, aux), keys)
    bound = F.lit(min_rows) if isinstance(min_rows, int) else min_rows
    spread = (valid.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(ref).alias("_rm"), F.stddev_pop(ref).alias("_rs"),
        F.avg(aux).alias("_am"), F.stddev_pop(aux).alias("_as"))
        .where(F.col("_n") >= bound))
    inside = (within_sigma(ref, F.col("_rm"), F.col("_rs"))
              & within_sigma(aux, F.col("_am"), F.col("_as"))
              & between(ref, 0, 100) & between(aux, 0, 100, low_open=False))
    kept = join_groups(valid, spread, group, few=few).where(inside).drop("_n", "_rm", "_rs", "_am", "_as")
    enough = (kept.groupBy(*group).agg(F.count(F.lit(1)).alias("_m"))
              .where(F.col("_m") >= bound).select(*group))
    return join_groups(kept, enough, group, "left_semi", few).drop(_ALL)


def clean_metrics(df: DataFrame, ref: str, aux: str, keys: Sequence[str] = (),
                  min_rows: int | Column = 50, few: bool = False) -> DataFrame:
    kept = sigma_filter_pair(df, ref, aux, keys, min_rows, few)
    return _by(kept, keys).agg(
        F.count(F.lit(1)).alias("n_samples"), stats.r2_score(ref, aux).alias("r2"),
        stats.rmse(ref, aux).alias("rmse"), F.avg(F.col(aux) - F.col(ref)).alias("bias"),
        F.avg(ref).alias("ref_mean"), F.avg(aux).alias("aux_mean"),
        F.stddev_pop(ref).alias("ref_std"), F.stddev_pop(aux).alias("aux_std"))


# ---- distributions --------------------------------------------------------------

def value_statistics(df: DataFrame, value: str, keys: Sequence[str] = (),
                     probs: Sequence[float] = (), positive: bool = True) -> DataFrame:
    """Coverage and distribution of valid (non-null, positive) values."""
    ok = between(value, 0) if positive else F.col(value).isNotNull()
    v = F.when(ok, F.col(value))
    flat = _by(df, keys).agg(
        F.count(F.lit(1)).alias("total_pixels"), F.count(v).alias("valid_pixels"),
        F.avg(v).alias("mean_height"), F.stddev_pop(v).alias("std_height"),
        F.min(v).alias("min_height"), F.max(v).alias("max_height"),
    ).withColumn("coverage_percent", F.col("valid_pixels") / F.col("total_pixels") * 100.0)
    if not probs:
        return flat
    cuts = exact_quantiles(df.withColumn("_v", v), keys, "_v", probs, "_q")
    joined = flat.join(cuts, list(keys)) if keys else _pair_rows(flat, cuts)
    return joined.select(*flat.columns, *[
        F.get("_q", i).alias(f"p{round(p * 100)}") for i, p in enumerate(probs)])


def class_histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts and shares of right-open classes of the valid values."""
    valid = df.where(between(value, 0))
    counted = (valid.select(height_class(value, edges).alias("class_no"))
               .groupBy("class_no").agg(F.count(F.lit(1)).alias("count")))
    total = valid.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (counted.where(F.col("class_no").between(1, len(edges) - 1))
            .withColumn("percentage", F.col("count") / total * 100.0))


def histogram(df: DataFrame, value: str, bins: int = 50, keys: Sequence[str] = (), few: bool = True) -> DataFrame:
    """Equal-width density histogram between each group's minimum and maximum.

    Rows are counted where they are read; for more groups than fit a broadcast ``few`` is False.
    """
    from understory.operators.order import _ALL, join_groups, null_safe_keys

    rows, group = null_safe_keys(df.where(F.col(value).isNotNull()), keys)
    span = rows.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                    F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    counted = (join_groups(rows, span, group, few=few)
               .withColumn("bin", equal_width_bin(value, "_lo", "_hi", bins))
               .groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"),
                                           F.first("_hi").alias("_hi"), F.first("_n").alias("_n")))
    return counted.select(
        *keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left_edge"), "count",
        F.try_divide(F.col("count"), F.col("_n") * width).alias("density"))


def density_grid(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Counts in square bins over the joint range; empty bins are left out."""
    rows = finite_pairs(df, x, y)
    span = rows.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"),
                             F.min(y).alias("y0"), F.max(y).alias("y1")).alias("s")).scalar()
    return rows.select(
        equal_width_bin(x, span["x0"], span["x1"], bins).alias("x_bin"),
        equal_width_bin(y, span["y0"], span["y1"], bins).alias("y_bin"),
    ).groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


def trend_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    return _by(finite_pairs(df, x, y), keys).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))


def bias_ratio(df: DataFrame, pred: str, ref: str, key: str) -> DataFrame:
    return finite_pairs(df, pred, ref).groupBy(key).agg(
        F.try_divide(F.avg(pred), F.avg(ref)).alias("bias_ratio"))


def color_range(df: DataFrame, pred: str, ref: str, scale: float = 1.0, limit: float = 50.0,
                min_values: int = 100) -> DataFrame:
    """Display range: 1st and 99th percentile of both sides inside (0, limit)."""
    both = stacked(df.withColumn(pred, F.col(pred) * scale), [], [ref, pred], "side", "v")
    # counted once: the quantiles of both sets read the counts several times
    seen = written(value_counts(both.where(between("v", 0, limit)), ["side"], "v"), "value-counts")
    counts = seen.withColumn("_set", F.explode(
        F.when(F.col("side") == ref, F.array(F.lit("both"), F.lit("ref"))).otherwise(F.array(F.lit("both")))))
    cuts = exact_quantiles(counts, ["_set"], "v", [0.01, 0.99], "_q", weight="n")
    sizes = counts.groupBy("_set").agg(F.sum("n").alias("_k")).where(F.col("_k") > min_values)
    wide = cuts.join(sizes, "_set").agg(
        F.max(F.when(F.col("_set") == "both", F.col("_q"))).alias("q_both"),
        F.max(F.when(F.col("_set") == "ref", F.col("_q"))).alias("q_ref"))
    chosen = F.coalesce("q_both", "q_ref", F.array(F.lit(0.0), F.lit(40.0)))
    return wide.select(F.greatest(F.lit(0.0), F.get(chosen, 0)).alias("low"),
                       F.least(F.lit(limit), F.get(chosen, 1)).alias("high"))


# ---- losses ---------------------------------------------------------------------

def class_weights(df: DataFrame, value: str, edges: Sequence[float] = fixed.HEIGHT_EDGES) -> DataFrame:
    """Row weight N / (classes * rows of its class); one tiny count table is joined back."""
    rows = df.withColumn("class_no", height_class(value, edges))
    counts = rows.groupBy("class_no").agg(F.count(F.lit(1)).alias("_c"))
    overall = counts.agg(F.struct(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    weights = counts.select("class_no", (overall["n"] / (overall["k"] * F.col("_c"))).alias("weight"))
    return rows.join(F.broadcast(weights), "class_no")  # one row per height class: at most nine


def huber_weighted(pred: str, ref: str) -> Column:
    """Mean Huber loss with taller trees weighted up."""
    y = as_col(ref)
    return F.avg((F.lit(1.0) + F.lit(0.1) * y / 30.0) * stats.smooth_l1(as_col(pred) - y))


def masked_loss(pred: str, ref: str, mask: Column) -> Column:
    d = as_col(pred) - as_col(ref)
    return F.coalesce(F.avg(F.when(mask, stats.smooth_l1(d))), F.lit(0.0))


def classifier_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and rank-based ROC AUC in one row."""
    y, p = F.col(label), (F.col(score) > threshold).cast("int")
    tp, fp = F.count_if((y == 1) & (p == 1)), F.count_if((y == 0) & (p == 1))
    fn, tn = F.count_if((y == 1) & (p == 0)), F.count_if((y == 0) & (p == 0))
    flat = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    flat = flat.withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")),
        "precision": precision, "recall": recall,
        "f1": F.try_divide(2 * precision * recall, precision + recall)})
    return _pair_rows(flat, roc_auc(df, label, score))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate at every distinct score, as cumulative shares."""
    from understory.operators.order import running_counts

    counts = (df.where(F.col(score).isNotNull()).withColumn("_g", one_group(score)).groupBy("_g", score)
              .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")))
    run = running_counts(counts, ["_g"], score, sums=("pos", "neg"))
    return run.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("neg_total") - F.col("neg_before"), F.col("neg_total")).alias("fpr"),
        F.try_divide(F.col("pos_total") - F.col("pos_before"), F.col("pos_total")).alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Share of (positive, negative) pairs ordered rightly, ties counted half."""
    from understory.operators.order import running_counts

    counts = (df.where(F.col(score).isNotNull()).withColumn("_g", one_group(score)).groupBy("_g", score)
              .agg(F.count_if(F.col(label) == 1).cast("double").alias("pos"),
                   F.count_if(F.col(label) == 0).cast("double").alias("neg")))
    run = running_counts(counts, ["_g"], score, sums=("pos", "neg"))
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return run.agg(F.try_divide(won, F.max("pos_total") * F.max("neg_total")).alias("auc"))


def clipped(c: str, low: float = 0.0, high: float = 100.0) -> Column:
    return clip(c, low, high)
