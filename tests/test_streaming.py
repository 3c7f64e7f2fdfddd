"""Streaming jobs over restarts."""

from datetime import datetime, timedelta

from understory.streaming import jobs

DAY = datetime(2024, 1, 1)


def test_every_key_once_over_restarts_and_late_rows_apart(spark, tmp_path):
    """Three runs of one job: keys come back after the delay, some rows are behind the watermark, one key is done already."""
    schema = "patch string, ts timestamp, extra int"
    feed, out, progress = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "progress")
    done = spark.createDataFrame([("z",), ("z",)], "patch string")
    runs = [
        [("a", 0), ("a", 0), ("b", 1), ("z", 1), (None, 1)],
        [("a", 40), ("c", 41), ("b", 1), ("d", 41)],
        [("a", 90), ("e", 2), ("c", 3), ("f", 90), ("e", 95), ("g", 4), ("g", 5), (None, 90)],
    ]
    for turn in runs:
        rows = [(k, DAY + timedelta(days=d), 1) for k, d in turn]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        stream = jobs.file_stream(spark, feed, spark.read.parquet(feed).schema)
        assert jobs.new_items(stream, done, "patch", "ts", "10 days", progress, out) == out
    found = spark.read.schema("patch string, ts timestamp, late boolean").parquet(out).collect()
    day = lambda r: (r.ts - DAY).days
    assert sorted((r.patch or "", day(r)) for r in found if not r.late) == [("", 1), ("a", 0), ("b", 1), ("c", 41), ("d", 41), ("e", 95), ("f", 90)]
    late = sorted((r.patch, day(r)) for r in found if r.late)
    assert late == [("c", 3), ("e", 2), ("g", 4), ("g", 5)]


def test_a_key_counts_as_seen_for_a_time(spark, tmp_path):
    """With an expiry of 30 days a key comes out again only after it; a row of the same day does not."""
    feed, out, progress = (str(tmp_path / n) for n in ("feed", "out", "progress"))
    done = spark.createDataFrame([], "patch string")
    for days in ((5, 3), (4, 20), (60, 40)):
        spark.createDataFrame([("a", DAY + timedelta(days=d)) for d in days], "patch string, ts timestamp").coalesce(1).write.mode("append").parquet(feed)
        stream = jobs.file_stream(spark, feed, spark.read.parquet(feed).schema)
        jobs.new_items(stream, done, "patch", "ts", "365 days", progress, out, keep=timedelta(days=30))
    found = spark.read.schema("patch string, ts timestamp, late boolean").parquet(out).collect()
    assert sorted((r.ts - DAY).days for r in found) == [3, 40] and not any(r.late for r in found)


def test_times_of_a_key_travel_in_one_row_and_done_keys_are_written_once(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"patch": ["a", "b", "a", None, "a"], "ts": pa.array([3, 1, None, 2, 3], pa.int64())})
    rows = [r for b in jobs.times_by_key(iter([batch])) for r in b.to_pylist()]
    assert {r["patch"]: r["ts"] for r in rows} == {"a": [3, None, 3], "b": [1], None: [2]} and len(rows) == 3

    labels = []
    monkeypatch.setattr(jobs, "written", lambda df, label: labels.append(label) or df)
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(5, DAY), (5, DAY - timedelta(days=1)), (None, DAY), (7, DAY), (8, None)], "patch long, ts timestamp").write.parquet(feed)
    stream = jobs.file_stream(spark, feed, spark.read.parquet(feed).schema)
    out = jobs.new_items(stream, spark.createDataFrame([(7,)], "patch long"), "patch", "ts", "10 days", str(tmp_path / "progress"), str(tmp_path / "out"))
    found = spark.read.schema("patch long, ts timestamp, late boolean").parquet(out).collect()
    assert {(r.patch, r.ts, r.late) for r in found} == {(5, DAY - timedelta(days=1), False), (None, DAY, False), (8, None, False)}
    assert len(found) == 3 and labels == ["done-keys"]
