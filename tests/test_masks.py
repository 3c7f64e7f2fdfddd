"""Medians of several columns from one grouping, and the combined forest mask that is built on them."""

from __future__ import annotations

import random
import statistics

from pyspark.sql import functions as F

from understory.operators import masks as K
from understory.operators.order import exact_medians

COLUMNS = "px int, obs_id int, ts int, dw_label int, fnf4 int, fnf int, B8 double, B4 double, B8A double, B9 double, probability double, wc int, chm double"


def observations(spark, n: int = 600):
    rng = random.Random(12)

    def some(value):
        return None if rng.random() < 0.2 else value

    rows = [(min(rng.randrange(30), 9), i, rng.randrange(50), some(rng.choice([0, 1, 1, 2])), some(rng.randrange(1, 4)), some(rng.randrange(1, 3)),
             rng.random(), rng.random(), some(1.0), some(1.0), some(rng.random() * 100), some(rng.choice([10, 20])), some(rng.random() * 2))
            for i in range(n)]
    rows += [(77, n, 1, *[None] * 10)]
    return spark.createDataFrame(rows, COLUMNS)


def test_medians_of_several_columns_within_and_beyond_the_limit(spark):
    """Pixel 9 holds two thirds of the rows; NULLs take no part."""
    obs = observations(spark)
    groups: dict = {}
    for r in obs.collect():
        for c in ("dw_label", "B8", "chm"):
            groups.setdefault((r.px, c), []).append(r[c])
    want = {k: [v for v in vs if v is not None] for k, vs in groups.items()}
    for limit in (10_000, 40, 5):
        got = {r.px: r for r in exact_medians(obs, ["px"], ["dw_label", "B8", "chm"], limit).collect()}
        for (px, c), values in want.items():
            if values:
                assert abs(got[px][c] - statistics.median(values)) < 1e-12
            else:
                assert got[px][c] is None


def test_combined_mask_equals_its_parts(spark):
    obs = observations(spark)
    for drop in ([], ["fnf4"], ["fnf4", "fnf"]):
        table = obs.withColumns({c: F.lit(None).cast("int") for c in drop}) if drop else obs
        parts = (K.dynamic_world_mask(table).join(K.forest_type_mask(table), "px").join(K.ndvi_mask(table), "px")
                 .join(K.cover_masks(table), "px"))
        want = {r.px: max(r.dw, r.fnf_mask, r.ndvi_mask, r.wc_mask) * r.chm_mask for r in parts.collect()}
        got = {r.px: r.mask for r in K.combined_mask(table, "ALL").collect()}
        assert got == want and len(got) == 11


def test_forest_classes_are_counted_in_parts_that_follow_the_rows(spark, monkeypatch):
    """The counts that all else reads come from as many tasks as the rows need; a pixel without a number is one like any other."""
    obs = observations(spark).withColumn("px", F.when(F.col("px") != 3, F.col("px")))
    held = []

    def keep(df, label):
        held.append(df)
        return df

    monkeypatch.setattr(K, "TASK_ROWS", 50)
    monkeypatch.setattr(K, "written", keep)
    got = {r.px: r.fnf_mask for r in K.forest_type_mask(obs).collect()}
    values: dict = {}
    for r in obs.collect():
        values.setdefault(r.px, []).extend([r.fnf4] if r.fnf4 is not None else [])
    assert got == {px: int(bool(v) and statistics.median(v) in (1, 2)) for px, v in values.items()}
    assert [df.rdd.getNumPartitions() for df in held] == [13]
