"""Order statistics against brute force, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from understory.functions.exprs import sample_hash
from understory.operators import order as O, sampling as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({
        "k": ["hot"] * 700 + [f"g{i % 20}" for i in range(300)],
        "v": np.round(rng.normal(20, 6, 1000), 1), "w": np.round(rng.gamma(2, 5, 1000), 1), "id": range(1000)})
    pdf.loc[::17, "v"] = np.nan
    pdf.loc[::17, "v"] = None
    return pdf, spark.createDataFrame(pdf.assign(v=pdf.v.astype(object).where(pdf.v.notna(), None)),
                                      "k string, v double, w double, id long")


@pytest.mark.parametrize("limit", [1, 50, 10_000])
def test_quantiles_equal_numpy_on_both_paths(skewed, limit):
    pdf, df = skewed
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in O.exact_quantiles(df, ["k"], "v", probs, "q", limit=limit).collect()}
    for k, g in pdf.dropna().groupby("k"):
        np.testing.assert_allclose(got[k], np.percentile(g.v, [100 * p for p in probs]), atol=1e-9)
    whole = O.exact_quantiles(df, [], "v", probs, "q", limit=limit).collect()
    np.testing.assert_allclose(whole[0].q, np.percentile(pdf.v.dropna(), [100 * p for p in probs]), atol=1e-9)


@pytest.mark.parametrize("limit", [1, 10_000])
def test_average_ranks_equal_pandas(skewed, limit):
    pdf, df = skewed
    got = {(r.k, r.w): r.avg_rank for r in O.average_ranks(df, ["k"], "w", limit=limit).collect()}
    want = pdf.assign(r=pdf.groupby("k").w.rank())
    assert len(got) == len(want[["k", "w"]].drop_duplicates())
    for row in want.itertuples():
        assert got[(row.k, row.w)] == pytest.approx(row.r)


def test_medians_of_several_columns(skewed):
    pdf, df = skewed
    got = {r.k: r for r in O.exact_medians(df, ["k"], ["v", "w"], limit=10).collect()}
    for k, g in pdf.groupby("k"):
        assert got[k].v == pytest.approx(g.v.median())
        assert got[k].w == pytest.approx(g.w.median())


def test_numbering_by_hash_is_a_permutation_and_limits_exactly(skewed):
    _, df = skewed
    df = df.withColumn("h", sample_hash(["id"]))
    rows = O.number_by_hash(df, ["k"], "h", ["id"]).toPandas()
    for _, g in rows.groupby("k"):
        assert sorted(g.row_no) == list(range(1, len(g) + 1))
        assert g.sort_values("row_no").h.is_monotonic_increasing
    capped = O.number_by_hash(df, ["k"], "h", ["id"], limit=25).toPandas()
    assert capped.groupby("k").size().max() == 25
    first = rows[rows.row_no <= 25]
    assert set(capped.id) == set(first.id)


def test_positions_without_global_sort(spark):
    df = spark.range(0, 500, 3).withColumnRenamed("id", "n")
    rows = S.row_positions(df, "n", "p").toPandas().sort_values("n")
    assert list(rows.p) == list(range(len(rows)))


def test_cuts_below_a_value_are_counted(spark):
    for k in (0, 1, 2, 100, O.SPLITS - 1):
        cuts = [float(2 * i) for i in range(k)]
        df = spark.range(-3, 2 * k + 3).select(F.col("id").cast("double").alias("v"), F.lit(cuts).cast("array<double>").alias("c"))
        got = O._count_below(df, "c", "v", "n").collect()
        assert all(r.n == sum(c < r.v for c in cuts) for r in got)


def test_quantiles_order_only_the_ranges_that_hold_a_rank(spark):
    """Once all distinct values of a large group were moved and ordered."""
    df = spark.range(0, 60_000, 1, 4).select(F.xxhash64("id").cast("double").alias("v"))
    made = O.exact_quantiles(df, [], "v", [0.5], "q", limit=1000)
    q = made.first().q[0]
    assert q == np.median([r.v for r in df.collect()])
    # between the ordering inside the ranges and the rows lies the choice of ranges
    lines = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
    ordered = next(i for i, line in enumerate(lines) if "Window" in line and "_v" in line)
    assert any("LeftSemi" in line and "_part" in line for line in lines[ordered:])


def test_overlapping_groups_are_spread_on_few_rows(spark):
    """Medians of overlapping unions of slots; the large side meets its cuts without a shuffle of all rows."""
    data = [("x", i % 5, float((i * 7919) % 4001) / 3) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, s int, v double")
    spread = lambda rows: rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("s"))))
    got = O.exact_quantiles_of_slots(df, ["g"], ["s"], spread, ["g", "p"], "v", [0.5], "m", limit=100)
    assert {r.p: round(r.m[0], 9) for r in got.collect()} == {
        p: round(float(np.median([v for _, s, v in data if s >= p])), 9) for p in range(5)}
    plan = O._cut(df, ["g"], "v", 100)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranks_and_colour_range_count_their_rows_once(spark):
    from understory.operators.metrics import color_range
    from understory.operators.sampling import quantile_normal

    df = spark.range(0, 3000, 1, 4).selectExpr("CAST(id % 41 AS DOUBLE) AS a", "CAST(id % 37 AS DOUBLE) AS b")
    for out in (quantile_normal(df, ["a", "b"]), color_range(df, "a", "b")):
        assert out.count() > 0
        assert "Range (" not in out._jdf.queryExecution().analyzed().toString()  # only the written counts are read again
