import math

import pytest
from pyspark.sql import functions as F

from understory.functions import stats
from understory.operators import metrics as M, texture as X, training as T


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_constant_offset(spark):
    df = frame(spark, [(float(v), float(v) + 2) for v in (10, 20, 30, 40, 50)], "reference_height double, test double")
    r = M.height_errors(df, ["test"]).first()
    assert (r.n, r.rmse, r.bias) == (5, pytest.approx(2), pytest.approx(2))
    assert r.correlation == pytest.approx(1) and r.slope == pytest.approx(1) and r.r_squared == pytest.approx(1)


def test_missing_and_nodata_pairs_are_left_out(spark):
    df = frame(spark, [(10.0, 12.0), (None, 22.0), (30.0, None), (-32767.0, 42.0), (50.0, 52.0)], "reference_height double, test double")
    assert M.height_errors(df, ["test"]).first().n == 2


def test_height_errors_reject_bad_arguments(spark):
    df = frame(spark, [(1.0,)], "a double")
    with pytest.raises(ValueError):
        M.height_errors(df, ["a"])
    with pytest.raises(TypeError):
        M.height_errors(df, "a")
    with pytest.raises(TypeError):
        M.height_errors([], ["a"])


def test_ten_measures(spark):
    df = frame(spark, [(10.0, 11.0), (15.0, 14.0), (20.0, 21.0), (25.0, 24.0), (30.0, 31.0)], "ref double, pred double")
    r = M.regression_metrics(df, "pred", "ref").first()
    assert r.rmse == pytest.approx(1) and r.mae == pytest.approx(1) and r.rmse >= r.mae
    assert r.r2 == pytest.approx(1 - 5 / 250) and r.within_1m == 100.0
    assert r.std_error == pytest.approx(math.sqrt(0.96)) and r.max_abs_error == pytest.approx(1)


def test_p_values(spark):
    # Two-sided Student tails from published tables.
    df = frame(spark, [(2.228, 12), (3.169, 12), (1.960, 100_002), (0.0, 30)], "t double, n long")
    p = [r[0] for r in df.select(stats.two_sided_p("t", "n")).collect()]
    assert p == pytest.approx([0.05, 0.01, 0.05, 1.0], abs=2e-4)


def test_small_groups_give_no_row(spark):
    df = frame(spark, [("a", float(i), float(i)) for i in range(9)] + [("b", float(i), float(i)) for i in range(10)], "k string, x double, y double")
    assert [r.k for r in M.pair_metrics(df, "x", "y", ["k"]).collect()] == ["b"]


def test_spearman_of_a_monotone_curve_is_one(spark):
    df = frame(spark, [(float(i), float(i) ** 3) for i in range(40)] + [(7.0, 343.0)], "x double, y double")
    assert M.spearman(df, "x", "y").first().spearman_r == pytest.approx(1)


def test_sigma_filter_drops_groups_below_the_minimum(spark):
    rows = [("a", 10.0 + i % 5, 10.0 + i % 5) for i in range(60)] + [("a", 99.0, 10.0)] + [("b", 5.0, 5.0 + i % 2) for i in range(10)]
    kept = M.sigma_filter_pair(frame(spark, rows, "k string, r double, p double"), "r", "p", ["k"], 50)
    assert {r.k for r in kept.collect()} == {"a"} and kept.count() == 60


def test_auc_of_a_perfect_and_a_useless_score(spark):
    good = frame(spark, [(int(i > 20), float(i)) for i in range(40)], "y int, s double")
    flat = good.withColumn("s", F.lit(0.5))
    assert M.roc_auc(good, "y", "s").first().auc == pytest.approx(1)
    assert M.roc_auc(flat, "y", "s").first().auc == pytest.approx(0.5)


def test_unusable_pairs_fail(spark):
    for value in (0.0, 0.001):
        df = frame(spark, [(value, value)] * 4, "p double, r double")
        with pytest.raises(Exception, match="no variance"):
            T.require_usable(T.pair_summary(df, "p", "r")).collect()


def test_filter_search_retention_and_direction(spark):
    rows = [(float(i), float(abs(i - 60)) / 10, abs(i - 60) <= 50, 0.1, 0.0) for i in range(200)]
    df = frame(spark, rows, "mean_asm double, height_difference double, height_agreement boolean, relative_error double, bias double")
    found = X.filter_search(df, ["mean_asm"]).collect()
    assert len(found) == 8  # the two filters that keep under 50 rows are left out
    for r in found:
        keep = [x for x in rows if (x[0] >= r.threshold if r.direction == "above" else x[0] <= r.threshold)]
        assert r.n_samples == len(keep) and 0 <= r.retention_rate <= 1
        assert r.mean_height_diff == pytest.approx(sum(x[1] for x in keep) / len(keep))


def test_rows_that_are_not_finite_and_groups_without_name(spark):
    from understory.operators.cleaning import fill_group_median
    from understory.operators.order import number_by_hash
    from understory.operators.sampling import standardize

    nan = float("nan")
    df = spark.createDataFrame([(None, 1.0, 1.0), (None, 3.0, 2.0), ("a", nan, 2.0), ("a", 5.0, float("inf")), ("a", 4.0, 4.0)],
                               "g string, x double, y double")
    assert M.regression_metrics(df, "x", "y").first()["n"] == 3
    assert standardize(df.where("x = x"), ["x"], "g").count() == 5
    filled = {tuple(r) for r in fill_group_median(df, ["g"], ["x", "y"]).select("g", "x", "y").collect()}
    assert ("a", 4.5, 2.0) in filled and ("a", 5.0, 3.0) in filled and (None, 1.0, 1.0) in filled
    numbered = number_by_hash(df.where("y < 100").selectExpr("g", "y", "CAST(y AS INT) % 7 AS h"), ["g"], "h", ["y"])
    assert sorted(r["row_no"] for r in numbered.where("g IS NULL").collect()) == [1, 2]


def moved_rows(spark, make):
    """Rows that the exchanges of a table's plan write, where no size is known to be small."""
    def walk(node):
        name = node.nodeName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan() if name.endswith("QueryStage") else None
        own = node.metrics().get("shuffleRecordsWritten").get().value() if name == "Exchange" else 0
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        return own + sum(walk(c) for c in children)

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = make()._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        return walk(plan)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_histograms_count_rows_where_they_are_read(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("CAST(id % 2 AS STRING) AS side", "CAST(id % 997 AS DOUBLE) AS v")
    for keys in ([], ["side"]):
        assert moved_rows(spark, lambda: M.histogram(df, "v", 10, keys)) < 1000
        assert sum(r["count"] for r in M.histogram(df, "v", 10, keys).collect()) == 20_000


def test_sigma_filter_of_few_groups_moves_no_rows(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("CAST(id % 2 AS STRING) AS k", "CAST(1 + id % 97 AS DOUBLE) AS r", "CAST(2 + id % 89 AS DOUBLE) AS p")
    assert moved_rows(spark, lambda: M.sigma_filter_pair(df, "r", "p", ["k"], few=True)) < 1000
    assert (M.sigma_filter_pair(df, "r", "p", ["k"], few=True).exceptAll(M.sigma_filter_pair(df, "r", "p", ["k"])).count() == 0
            and M.sigma_filter_pair(df, "r", "p", ["k"], few=True).count() == 20_000)


def test_mosaic_statistics_hold_the_height_classes(spark):
    from understory.operators.evaluation import mosaic_statistics

    df = frame(spark, [(v,) for v in (None, -1.0, 0.0, 0.5, 4.0, 5.0, 9.9, 20.0, 30.0, 31.0, 50.0, 100.0, 130.0)], "v double")
    r = mosaic_statistics(df, "v").first()
    assert [r[f"count_{c}m"] for c in ("0_5", "5_10", "10_20", "20_30", "30_50", "50_100")] == [2, 2, 0, 1, 2, 1]
    assert r.percent_0_5m == pytest.approx(20) and r.percent_10_20m == 0 and (r.valid_pixels, r.tall_count) == (10, 4)


def test_importance_summary_holds_the_histogram(spark):
    import numpy as np
    from understory.operators.learn import importance_summary

    values = [0.0, 0.01, 0.02, 0.02, 0.1, 0.25, 0.6, 0.0]
    r = importance_summary(frame(spark, [(str(i), v) for i, v in enumerate(values)], "feature string, importance double")).first()
    counts, edges = np.histogram([v for v in values if v > 0], 20)
    assert r.bin_counts == counts.tolist() and r.bin_edges == pytest.approx(edges.tolist()) and (r.total, r.zero) == (8, 2)
    r = importance_summary(frame(spark, [("a", 0.5), ("b", 0.5)], "feature string, importance double")).first()
    counts, edges = np.histogram([0.5, 0.5], 20)
    assert r.bin_counts == counts.tolist() and r.bin_edges == pytest.approx(edges.tolist())
    r = importance_summary(frame(spark, [("a", 0.0)], "feature string, importance double")).first()
    assert r.bin_counts is None and r.bin_edges is None and r.zero == 1


def test_rank_correlations_of_columns_write_small_tables(spark, monkeypatch):
    """Ties, values that fill whole ranges, NULL and NaN; the tables written before had a row per pair."""
    from understory.operators import order

    df = spark.range(0, 6000, 1, 3).selectExpr(
        "CASE WHEN id % 10 < 4 THEN 7.0D ELSE CAST(hash(id, 1) % 900 AS DOUBLE) END AS d", "CAST(id % 10 < 7 AS DOUBLE) AS a",
        "CAST(hash(id, 2) % 5 AS DOUBLE) AS p", "IF(id % 7 = 0, NULL, IF(id % 11 = 0, DOUBLE('NaN'), hash(id, 3) / 1e6 + id)) AS q",
        "CAST(NULL AS DOUBLE) AS r").cache()
    want = {(c, o): M.spearman(df, c, o).first() for c in "pq" for o in "da"}
    sizes = []
    for module in (M, order):
        monkeypatch.setattr(module, "written", lambda rows, label, write=module.written: sizes.append(rows.count()) or write(rows, label))
    got = {r.name: r for r in M.spearman_of_columns(df, ["p", "q", "r"], "d", "a").collect()}
    assert set(got) == {"p", "q"} and 0 < max(sizes) < 1500
    for (c, o), r in want.items():
        assert got[c]["spearman_other" if o == "d" else "spearman_few"] == pytest.approx(r.spearman_r, abs=1e-12)
    sizes.clear()
    rows = df.selectExpr("d AS height_difference", "a > 0 AS height_agreement", "d AS relative_error", "d AS bias", "p", "q")
    assert X.texture_correlations(rows, ["p", "q"]).count() == 2 and max(sizes) < 1500
