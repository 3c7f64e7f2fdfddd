"""The driver contract and a spread of queries against their check SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from check import TABLES, plain

FOLDER = "/root/testdata/sf0.001"
SOME = ["regional_summary", "height_error_analysis", "clean_metrics", "histogram", "merge_mosaic", "composite_median",
        "sample_points", "resample_bilinear", "patch_neighbors", "shift_aware_loss", "stratified_sample", "quantile_normal",
        "terrain_slope_aspect", "normalize_bands", "parse_region", "forest_mask_fnf", "fill_median", "scan_granules",
        "sink_points_geojson", "stream_monthly_mean", "stream_incremental_patches", "ensemble_stack"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def names():
    queries = driver.queries()
    return list(driver.oracle_sql()) if os.environ.get("ALL_QUERIES") else [n for n in SOME if n in queries]


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, con, name):
    df = driver.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(driver.oracle_sql()[name])
    places = {d[0]: i for i, d in enumerate(cur.description)}
    assert columns == sorted(places)
    assert mine == sorted(tuple(plain(w[places[c]]) for c in columns) for w in cur.fetchall())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and rows[0].product


def test_every_check_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
