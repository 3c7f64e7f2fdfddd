import math

import pytest
from pyspark.sql import functions as F

from understory.functions import exprs as X, names as NM
from understory.operators import bands as B, grids as GR, neighbourhood as N, sampling as S, tiles


def value(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("kind, x, want", [
    ("sentinel1", -31, -0.24), ("sentinel1", 17, 1.68), ("sentinel1", 0, 1), ("sentinel2", 10, 0.001),
    ("sentinel2", 15769, 1.5769), ("srtm_elevation", -27, -0.0135), ("srtm_elevation", 331, 0.1655),
    ("srtm_slope", 39.3, 0.786), ("srtm_aspect", 0, -1), ("srtm_aspect", 180, 0), ("srtm_aspect", 360, 1),
    ("canopy_height", 40, 0.8), ("alos2", 100, 10 * math.log10(1e4) - 83)])
def test_normalisation(spark, kind, x, want):
    assert value(spark, X.normalize(kind, F.lit(float(x)))) == pytest.approx(want)


def test_unknown_band_type():
    with pytest.raises(ValueError):
        X.normalize("radar", "x")


def test_non_finite_values(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "v double")
    assert [r[0] for r in df.select(X.finite_or_zero("v")).collect()] == [1, 0, 0, 0, 0]
    assert [r[0] for r in df.select(X.finite_or_limits("v")).collect()] == [1, 0, 100, -100, 0]


def test_height_classes(spark):
    df = spark.createDataFrame([(float(v),) for v in (-1, 0, 4.9, 5, 99, 100, 150)], "v double")
    assert [r[0] for r in df.select(X.height_class("v")).collect()] == [0, 1, 1, 2, 7, 8, 8]


def test_resolutions(spark):
    df = spark.createDataFrame([(10,), (20,), (30,)], "s int")
    assert [tuple(r) for r in df.select(*NM.resolution(F.col("s"))).collect()] == [(2560, 256), (2560, 128), (2560, 85)]
    with pytest.raises(Exception, match="unsupported scale"):
        spark.createDataFrame([(15,)], "s int").select(*NM.resolution(F.col("s"))).collect()


def test_folded_names(spark):
    text = value(spark, NM.folded(F.array(*[F.lit(f"band{i:02d}") for i in range(30)]), 40))
    assert all(len(line) <= 40 for line in text.split("\n"))
    assert ", ".join(text.split("\n")).split(", ") == [f"band{i:02d}" for i in range(30)]


def test_band_selection():
    names = ["A01", "A00", "S1_VV", "ch_lang2022", "forest_mask", "rh", "reference_height"]
    assert B.band_names(names, "embedding") == ["A00", "A01"]
    assert B.band_names(names, "auxiliary") == ["ch_lang2022", "forest_mask"]
    assert B.band_names(names, "original") == ["S1_VV"]
    assert B.target_band(names, "reference") == "reference_height"
    assert B.target_band(["x", "ch_lang2022"], "reference") == "ch_lang2022"
    with pytest.raises(ValueError):
        B.target_band(["x"], "gedi_only")
    assert len(B.positional_names(196, True)) == 196 and B.positional_names(196, True)[24] == "S2_B2_M01"
    assert B.positional_names(21)[-2:] == ["band_19", "band_20"]
    assert B.split_temporal(["S1_VV_M01", "DEM", "rh", "forest_mask"]) == (["S1_VV_M01"], ["DEM"])
    assert B.target_position(["a", "b"]) == 1


def test_patch_grid_covers_its_bounds(spark):
    for far, extruded in ((5120.0, True), (3000.0, True)):
        boxes = spark.createDataFrame([(0.0, 0.0, far, far)], "min_x double, min_y double, max_x double, max_y double")
        cells = GR.patch_grid(boxes).collect()
        assert max(c.min_x + c.width for c in cells) >= far and any(c.is_extruded for c in cells) == extruded
        assert all(c.min_x + c.width <= far + 1e-9 for c in cells if c.is_extruded)
    with pytest.raises(ValueError):
        GR.patch_grid(boxes, scale=15)


def test_inverse_normal(spark):
    df = spark.createDataFrame([(0.5, 0.0), (0.975, 1.959963985), (0.001, -3.090232306)], "p double, z double")
    for r in df.select(S.inverse_normal("p").alias("got"), "z").collect():
        assert r.got == pytest.approx(r.z, abs=1e-7)


def test_slope_of_a_tilted_plane(spark):
    cells = [(1, r, c, 10.0 * c) for r in range(5) for c in range(5)]  # rises to the east by 1 in 1
    out = N.slope_aspect(spark.createDataFrame(cells, "g int, row int, col int, z double"), ["g"], "z", 10.0).collect()
    assert len(out) == 9
    assert all(o.slope == pytest.approx(45) and o.aspect == pytest.approx(270) for o in out)


def test_focal_mean_of_a_constant_is_the_constant(spark):
    cells = spark.createDataFrame([(1, r, c, 4.0) for r in range(4) for c in range(4)], "grid int, row int, col int, v double")
    rows = N.focal_mean(cells, ["grid"], ["v"]).collect()
    assert len(rows) == 16 and all(r.v_filtered == pytest.approx(4) for r in rows)


def test_texture_of_a_flat_patch(spark):
    cells = spark.createDataFrame([(1, r, c, 0.25) for r in range(4) for c in range(4)], "grid int, row int, col int, v double")
    rows = N.glcm(cells, ["grid"], ["v"]).collect()
    assert len(rows) == 16
    assert all(r.asm == pytest.approx(1) and r.ent == pytest.approx(0) and r.contrast == 0 and r.idm == pytest.approx(1) for r in rows)


def test_focal_mean_across_tiles_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 5)
    cells = [(r, c, float((r * 31 + c * 17) % 23)) for r in range(13) for c in range(12) if (r * c) % 7 != 3]
    df = spark.createDataFrame([(1, *x) for x in cells], "grid int, row int, col int, v double")
    got = {(x.row, x.col): x.v_filtered for x in N.focal_mean(df, ["grid"], ["v"], 2).collect()}
    assert set(got) == {(r, c) for r, c, _ in cells}
    for r, c, _ in cells:
        near = [v for y, x, v in cells if abs(y - r) <= 2 and abs(x - c) <= 2]
        assert got[(r, c)] == pytest.approx(sum(near) / len(near))


def test_rounding_equals_duckdb(spark):
    import duckdb
    from understory.plans.shape import round_half_away
    values = [k / 1_200_000 for k in range(-3000, 3000)] + [k / 2_000_000 + 0.1 for k in range(4000)] + [0.0, float("nan"), float("inf"), 1e305]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [str(r.v) for r in df.select("i", round_half_away(F.col("v"), 6).alias("v")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INT, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [str(v) for v, in con.execute("SELECT round(v, 6) + 0.0 FROM t ORDER BY i").fetchall()]
    assert got == want
