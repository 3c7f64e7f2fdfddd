"""Runs away from the repository: workers get the package's functions by value; tables may be folders of parts."""

import csv
import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")

ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as driver
from understory.session import build_session
sys.path.remove({root!r})
spark = build_session("elsewhere", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
for name in ("significance_level", "focal_mean"):
    print(name, len(driver.queries()[name](spark, {folder!r}).collect()))
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT, folder=FOLDER)], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=240)
    assert run.returncode == 0, run.stderr[-2000:]
    assert "focal_mean" in run.stdout


@pytest.mark.parametrize("name", ["stream_incremental_patches", "stream_monthly_mean"])
def test_streams_read_a_table_of_many_files(spark, tmp_path, name):
    for table in os.listdir(FOLDER):
        df = spark.read.parquet(f"{FOLDER}/{table}")
        df.repartition(4 if table == "lineitem.parquet" else 1).write.parquet(str(tmp_path / table))
    parts, whole = (sorted(map(tuple, driver.queries()[name](spark, f).collect())) for f in (str(tmp_path), FOLDER))
    assert parts and parts == whole


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    from understory.sources import scans

    (tmp_path / "a_gedi.csv").write_text("fid,reference_height,rh\n1,20.0,10.0\n2,21.0,\n")
    (tmp_path / "b_gedi.csv").write_text('"rh","note","reference_height","fid"\n5.5,x,6.5,3\n')
    (tmp_path / "c_gedi.csv").write_text("fid,rh\n4,1.0\n")
    rows = scans.read_point_tables(spark, str(tmp_path), ["*.csv"], "fid string, region string, rh double, reference_height double",
                                   ["rh", "reference_height"]).collect()
    assert sorted((r.fid, r.rh, r.reference_height, r.region) for r in rows) == [("1", 10.0, 20.0, None), ("2", None, 21.0, None), ("3", 5.5, 6.5, None)]


def test_csv_files_with_odd_headers_are_read_whole(spark, tmp_path):
    heads = ["\ufefffid,rh,reference_height", ",fid,rh,reference_height", "system:index,fid,rh,reference_height,.geo",
             '"rh (m)",fid,rh,reference_height,"a, b"', "fid,rh,reference_height,rh", "\nfid,rh,reference_height"]
    for i, head in enumerate(heads):
        names = next(csv.reader([head.strip("\ufeff\n")]))
        row = [{"fid": str(i), "rh": "1.5", "reference_height": "2.5"}[n] if n in names and n in ("fid", "rh", "reference_height") else "9" for n in names]
        (tmp_path / f"{i} [x]_gedi.csv").write_text(head + "\n" + ",".join(row) + "\n", encoding="utf-8")
    (tmp_path / "empty_gedi.csv").write_text("")
    (tmp_path / "notes.csv").write_text("something,else\n1,2\n")
    from understory.sources import scans

    def read(globs):
        return scans.read_point_tables(spark, str(tmp_path), globs, "fid string, rh double, reference_height double", ["rh", "reference_height"])

    assert sorted(tuple(r) for r in read(["*_gedi.csv"]).select("fid", "rh", "reference_height").collect()) == [(str(i), 1.5, 2.5) for i in range(len(heads))]
    with pytest.raises(ValueError, match="notes.csv"):
        read(["*.csv"])
