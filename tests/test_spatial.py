import json

import pytest
from pyspark.sql import functions as F

from understory.functions.exprs import sample_hash
from understory.operators import alignment as A, augment as G, composite as Q, patches as P, resample as R, sampling as S
from understory.session import new_path
from understory.sources import scans


def test_average_of_two_tiles(spark):
    rows = [(p, p, r, c, v) for p, v in ((1, 10.0), (2, 20.0)) for r in range(8) for c in range(8)]
    df = spark.createDataFrame(rows, "patch_num int, patch_order int, row int, col int, pred double")
    out = Q.mosaic(df, "pred", ["patch_num", "patch_order"], ["row", "col"]).collect()
    assert len(out) == 64
    assert all((o.average, o.first, o.last, o.min, o.max) == (15, 10, 20, 10, 20) for o in out)


def test_mosaic_of_one_patch_is_itself_and_gaps_are_nodata(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 5.0), (1, 1, 0, 1, float("nan")), (1, 1, 0, 2, 0.0)],
                               "patch_num int, patch_order int, row int, col int, pred double")
    out = {o.col: o.average for o in Q.mosaic(df, "pred", ["patch_order"], ["row", "col"], nodata=-9.0).collect()}
    assert out == {0: 5.0, 1: -9.0, 2: -9.0}


def test_points_in_the_masked_quadrant(spark):
    # 10 x 10 cells over (0, 0, 1, 1); the mask is set in the upper-left quadrant
    mask = spark.createDataFrame([(r, c, int(r < 5 and c < 5)) for r in range(10) for c in range(10)], "row int, col int, mask int")
    points = spark.createDataFrame([(1, 0.1, 0.9), (2, 0.4, 0.6), (3, 0.9, 0.1), (4, 0.6, 0.9), (5, 2.0, 2.0)], "id int, longitude double, latitude double")
    got = A.mask_points_in_bounds(points, mask, ["row", "col"], 0.0, 0.0, 1.0, 1.0, 0.1).collect()
    assert {r.id for r in got} == {1, 2}
    assert mask.where("mask = 1").count() == 25


def test_neighbours_equal_brute_force(spark):
    boxes = [(i, float(x), float(y), float(x + s), float(y + s)) for i, (x, y, s) in enumerate(
        [(0, 0, 10), (5, 5, 10), (20, 0, 10), (30.5, 0, 3), (-40, -40, 70), (100, 100, 1), (5, 5, 10)])]
    df = spark.createDataFrame(boxes, "patch_num int, min_x double, min_y double, max_x double, max_y double")
    got = sorted((r.left_id, r.right_id) for r in P.neighbours(df, 1.0, 8.0).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[0] != b[0] and a[1] - 1 <= b[3] and a[3] + 1 >= b[1]
                  and a[2] - 1 <= b[4] and a[4] + 1 >= b[2])
    assert got == want


def test_linear_resize_keeps_corners_and_ramps(spark):
    cells = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "g int, row int, col int, v double")
    out = {(o.t_row, o.t_col): o.v for o in R.resize_linear(cells, "v", ["g"], 4, 7).collect()}
    assert out[(0, 0)] == 0 and out[(6, 6)] == 33 and out[(1, 0)] == pytest.approx(5) and len(out) == 49


def _brute_linear(cells, size, target, name):
    """Weighted mean of the four cells around each target cell, those without a value left out."""
    out = {}
    for tr in range(target):
        for tc in range(target):
            y, x = tr * ((size - 1) / (target - 1)), tc * ((size - 1) / (target - 1))
            near = [((1 - abs(y - r)) * (1 - abs(x - c)), v[name]) for (r, c), v in cells.items() if abs(y - r) < 1 and abs(x - c) < 1 and v[name] is not None]
            if sum(w for w, _ in near) > 0:
                out[(tr, tc)] = sum(w * v for w, v in near) / sum(w for w, _ in near)
    return out


@pytest.mark.parametrize("size,target", [(9, 23), (12, 5)])
def test_resize_of_sparse_grids_equals_brute_force(spark, monkeypatch, size, target):
    monkeypatch.setattr(R, "TILE", 7)
    cells = {(r, c): {"a": float(r * r + 3 * c), "b": None if (r + c) % 4 == 0 else float(r - c)}
             for r in range(size) for c in range(size) if (r * 5 + c * 3) % 7 < 3}
    df = spark.createDataFrame([(1, r, c, v["a"], v["b"]) for (r, c), v in cells.items()], "g int, row int, col int, a double, b double")
    want = {n: _brute_linear(cells, size, target, n) for n in "ab"}
    out = {(o.t_row, o.t_col): (o.a, o.b) for o in R.resize_linear(df, ["a", "b"], ["g"], size, target).collect()}
    assert set(out) == set(want["a"]) & set(want["b"])
    assert all(out[k] == pytest.approx((want["a"][k], want["b"][k])) for k in out)
    nearest = sorted((o.t_row, o.t_col, o.a) for o in R.resize_nearest(df, "a", ["g"], size, target).collect())
    at = [int(t * ((size - 1) / (target - 1)) + 0.5) for t in range(target)]
    assert nearest == [(i, j, cells[at[i], at[j]]["a"]) for i in range(target) for j in range(target) if (at[i], at[j]) in cells]


def test_resize_plans_no_join(spark):
    """A target grid was once broadcast, since expanding it is not in Spark's estimates."""
    df = spark.range(10).selectExpr("id AS g", "0 AS row", "0 AS col", "1.0D AS v")
    for made in (R.resize_linear(df, "v", ["g"], 64, 40), R.resize_nearest(df, "v", ["g"], 64, 40), G.legacy(df, ["v"], ["g"], 64, min_crop_size=64)):
        assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_augmentation_is_a_bijection(spark):
    cells = spark.createDataFrame([(r, c, float(5 * r + c)) for r in range(5) for c in range(5)], "row int, col int, v double")
    rows = G.spatial(cells, 5).collect()
    assert len(rows) == 12 * 25
    for i in range(12):
        mine = [r for r in rows if r.augment_id == i]
        assert len({(r.row, r.col) for r in mine}) == 25 and sorted(r.v for r in mine) == sorted(float(x) for x in range(25))
    at = {(r.augment_id, r.row, r.col): r.v for r in rows}
    assert at[(1, 0, 0)] == 4.0 and at[(2, 0, 0)] == 20.0 and at[(3, 0, 0)] == 24.0
    assert at[(4, 0, 0)] == 0.0  # column flip, then a quarter turn counter-clockwise


def test_best_shift_is_never_worse_than_none(spark):
    cells = [(1, r, c, float((3 * r + 5 * c) % 17 + 1)) for r in range(12) for c in range(12)]
    px = spark.createDataFrame(cells, "patch_num int, row int, col int, pred double")
    moved = px.select("patch_num", "row", "col", "pred", F.lit(None).cast("double").alias("t0"))
    target = px.select("patch_num", (F.col("row") + 1).alias("row"), "col", F.col("pred").alias("rh"))
    px = moved.join(target, ["patch_num", "row", "col"], "left")
    losses = A.shift_losses(A.shift_sums(px, "rh", "pred", A.square_shifts(1), 12))
    best = A.best_shift_loss(px, losses).first()
    assert best.loss == pytest.approx(0) and (best.dx, best.dy) == (0, -1)
    none = px.where(F.lit(False)).select("patch_num", "row", "col", "pred", "rh")
    assert A.best_shift_loss(px, A.shift_losses(A.shift_sums(none, "rh", "pred", A.square_shifts(1), 12))).first().loss == 10.0


def test_split_is_disjoint_by_patch(spark):
    px = spark.range(1000).select((F.col("id") % 50).alias("patch_num")).withColumn("train", S.hash_split(["patch_num"], 0.8))
    assert px.groupBy("patch_num").agg(F.count_distinct("train").alias("n")).where("n > 1").count() == 0


def test_stratified_sample_with_a_hot_patch(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1500, 1).otherwise(F.col("id") % 9 + 2).alias("patch_num"), "id",
                                  ((F.col("id") * 7) % 60).cast("double").alias("h")).withColumn("hk", sample_hash(["id"]))
    out = S.stratified_sample(df, "h", 70, "patch_num", "hk", ["id"])
    sizes = {r.patch_num: r["count"] for r in out.groupBy("patch_num").count().collect()}
    have = {r.patch_num: r["count"] for r in df.groupBy("patch_num").count().collect()}
    assert sizes == {k: min(70, n) for k, n in have.items()}
    assert out.select("id").distinct().count() == out.count()


def write_text(spark, text):
    path = new_path(spark, "aoi")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


RING = [[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]


@pytest.mark.parametrize("shape", [
    {"type": "Polygon", "coordinates": [RING]}, {"type": "MultiPolygon", "coordinates": [[RING], [[[9, 9], [9, 8], [8, 8], [9, 9]]]]},
    {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [RING]}}]}])
def test_area_of_interest(spark, shape):
    r = scans.read_aoi(spark, write_text(spark, json.dumps(shape))).first()
    assert (r.min_lon, r.min_lat, r.max_lon, r.max_lat) == (0, 0, 2, 1)


@pytest.mark.parametrize("shape", [{"type": "Point", "coordinates": [0, 0]}, {"type": "FeatureCollection", "features": []}])
def test_unsupported_areas_fail(spark, shape):
    with pytest.raises(Exception, match="unsupported area"):
        scans.read_aoi(spark, write_text(spark, json.dumps(shape))).collect()


def test_quality_split_keeps_class_shares(spark):
    from understory.operators.learn import quality_split

    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("good")).withColumn("hk", sample_hash(["id"]))
    train, test = quality_split(df, "good", "hk", ["id"], 0.7)
    sizes = {r.good: r["count"] for r in train.groupBy("good").count().collect()}
    assert sizes == {0: 630, 1: 70}
    assert train.join(test, "id").count() == 0 and test.count() == 300


def test_forest_learns_and_predicts_only_whole_rows(spark):
    from understory.operators import learn

    df = spark.range(400).select((F.col("id") % 40).cast("double").alias("a"), ((F.col("id") * 7) % 11).cast("double").alias("b"))
    df = df.withColumn("y", F.col("a") * 2 + 1)
    model = learn.fit_forest(df, ["a", "b"], "y", trees=10, depth=6)
    gaps = df.withColumn("b", F.when(F.col("b") != 3, F.col("b")))
    out = learn.predict(model, gaps, ["a", "b"], ["a", "b", "y"])
    assert out.where(F.col("b").isNull() & F.col("pred").isNotNull()).count() == 0
    assert out.where(F.col("b").isNotNull() & (F.abs(F.col("pred") - F.col("y")) > 25)).count() == 0
    with pytest.raises(ValueError):
        learn.fit_forest(df.limit(5), ["a", "b"], "y")


def test_cached_table_is_built_once(spark):
    import uuid

    from understory.sources.sinks import materialized

    built, params = [], {"id": uuid.uuid4().hex}

    def build():
        built.append(1)
        return spark.range(7)

    assert [materialized(spark, "t", params, build).count() for _ in range(2)] == [7, 7] and len(built) == 1


def test_cached_table_follows_its_inputs(spark, tmp_path):
    import uuid

    from understory.sources.sinks import materialized

    built, params, source = [], {"id": uuid.uuid4().hex}, tmp_path / "in.csv"

    def build():
        built.append(1)
        return spark.read.text(str(source))

    for text, count, builds in (("a\n", 1, 1), ("a\n", 1, 1), ("a\nb\n", 2, 2)):
        if not source.exists() or source.read_text() != text:
            source.write_text(text)
        assert materialized(spark, "t", params, build, [str(source)]).count() == count and len(built) == builds


def test_columns_are_bound_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("v,other,id\n1.5,x,1\n")
    (tmp_path / "b.csv").write_text("id,v\n2,2.5\n")
    rows = scans.read_by_header(spark, str(tmp_path), "id int, v double").collect()
    assert sorted((r.id, r.v) for r in rows) == [(1, 1.5), (2, 2.5)]


def test_point_tables_need_two_heights_and_a_matching_name(spark, tmp_path):
    for name, other in (("dchm_04hf3_gedi_reference", "5.0"), ("dchm_05LE4_gedi_reference", ""), ("dchm_09gd4_other", "5.0")):
        (tmp_path / f"{name}.csv").write_text(f"id,rh,reference_height\n1,3.0,{other}\n")
    rows = scans.read_point_tables(spark, str(tmp_path), ["*gedi*reference*.csv", "*gedi*.csv"],
                                   "id int, rh double, reference_height double", ["rh", "reference_height"]).collect()
    assert [(r.source_file, r.region_code, r.region_name) for r in rows] == [
        ("dchm_04hf3_gedi_reference.csv", "04hf3", "Kochi")]


def test_bilinear_targets_travel_once(spark):
    from tests.test_metrics import moved_rows

    cells = spark.createDataFrame([("a", r, c, float(r * 10 + c)) for r in range(6) for c in range(6) if (r, c) != (2, 2)]
                                  + [("a", 1, 1, 99.0), ("a", 0, 0, None)], "g string, row int, col int, v double").coalesce(1)
    targets = spark.range(0, 5000, 1, 4).selectExpr("'a' AS g", "id", "id % 640 / 100 - 0.5 AS fy", "id % 577 / 100 - 0.25 AS fx")
    held = {}
    for g, r, c, v in ((x.g, x.row, x.col, x.v) for x in cells.collect() if x.v is not None):
        held.setdefault((r, c), []).append(v)
    want = {}
    for t in targets.collect():
        y, x = int(t.fy // 1), int(t.fx // 1)
        near = [(v, (float(t.fy) - y if dy else 1 - (float(t.fy) - y)) * (float(t.fx) - x if dx else 1 - (float(t.fx) - x)))
                for dy in (0, 1) for dx in (0, 1) for v in held.get((y + dy, x + dx), [])]
        near = [(v, w) for v, w in near if w > 0]
        if near:
            want[t.id] = sum(v * w for v, w in near) / sum(w for _, w in near)
    for few in (True, False):
        got = {r.id: r.v for r in R.bilinear(cells, targets, "v", ["g"], ["id"], few).collect()}
        assert got == pytest.approx(want)
    # the target itself and the few squares, where it travelled once for each corner before
    assert moved_rows(spark, lambda: R.bilinear(cells, targets, "v", ["g"], ["id"], True)) < 1.1 * targets.count()


def test_blocks_are_averaged_in_parts_that_follow_the_cells(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_CELLS", 100)
    cells = spark.range(1600).select((F.col("id") % 2).alias("g"), F.floor(F.col("id") / 40).cast("int").alias("row"),
                                     (F.col("id") % 40).cast("int").alias("col"), F.col("id").cast("double").alias("v"))
    out = R.decimate(cells, "v", ["g"], limit=100, target=50)
    want: dict = {}
    for i in range(1600):
        want.setdefault((i % 2, i // 40 // 4, i % 40 // 4), []).append(float(i))
    assert {(o.g, o.row, o.col): (o.v, o.factor) for o in out.collect()} == {k: (sum(v) / len(v), 4) for k, v in want.items()}
    assert out.rdd.getNumPartitions() == 16


def test_first_lines_are_found_in_parts_that_follow_the_lines(spark, tmp_path, monkeypatch):
    from understory.sources import standin

    monkeypatch.setattr(standin, "TASK_LINES", 100)
    lines = spark.range(1000).selectExpr(
        "id AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "1 AS l_linenumber", "1D AS l_quantity", "CAST(id AS DOUBLE) AS l_extendedprice",
        "0D AS l_discount", "0D AS l_tax", "'N' AS l_returnflag")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    px = standin.Tables(spark, str(tmp_path)).pixels
    first: dict = {}
    for i in range(1000):
        cell = (i % 5, i % 64, i % 7)
        first[cell] = min(first.get(cell, (f"{i}-1-", i)), (f"{i}-1-", i))
    assert {(r.patch_num, r.row, r.col): r.B4 for r in px.collect()} == {c: i / 20.0 for c, (_, i) in first.items()}
    assert px.rdd.getNumPartitions() == 10


def test_legacy_crops_move_cells_once(spark, monkeypatch):
    """Crops over several tiles with missing, NULL and repeated cells equal the resize of each; every crop dealt the cells anew before."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(R, "TILE", 7)
    df = spark.range(900).selectExpr("IF(id % 5 = 0, NULL, id % 2) AS g", "CAST(id % 20 AS INT) AS row", "CAST(id * 7 % 19 AS INT) AS col",
                                     "IF(id % 11 = 0, NULL, CAST(id AS DOUBLE)) AS v").where("id % 3 > 0")
    made = G.legacy(df, ["v"], ["g"], 20, crops=3, min_crop_size=20)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    for i in range(3):
        off = [F.pmod(F.xxhash64("g", F.lit(42 + 2 * i + j)), F.lit(3)) for j in (0, 1)]
        cut = df.select("g", (F.col("row") - off[0]).cast("int").alias("row"), (F.col("col") - off[1]).cast("int").alias("col"), "v").where(
            "row BETWEEN 0 AND 17 AND col BETWEEN 0 AND 17")
        want = sorted((str(r.g), r.t_row, r.t_col, r.v) for r in R.resize_linear(cut, "v", ["g"], 18, 20).collect())
        got = sorted((str(r.g), r.row, r.col, r.v) for r in made.where(f"kind = 'crop_{i + 1}'").collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])
