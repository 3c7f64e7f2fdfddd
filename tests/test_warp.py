"""Map projection against an independent series and numeric arcs, warps against a plain loop."""

import math
import random

import numpy as np

from understory.functions.projection import AXIS, EAST, FLATTENING, SCALE, project, reproject, unproject
from understory.operators import warp

E2 = FLATTENING * (2 - FLATTENING)


def arc(lat):
    """Meridian distance by numeric integration."""
    phi = np.linspace(0, math.radians(lat), 200_001)
    f = AXIS * (1 - E2) / (1 - E2 * np.sin(phi) ** 2) ** 1.5
    h = phi[1] - phi[0]
    return float(h / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()))


def plainly(lon, lat, zone):
    """The classical power series in the distance from the meridian, good to a millimetre near it."""
    phi, a = math.radians(lat), math.radians(lon - (zone * 6 - 183))
    ep2 = E2 / (1 - E2)
    n, t, c, a = AXIS / math.sqrt(1 - E2 * math.sin(phi) ** 2), math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, a * math.cos(phi)
    x = SCALE * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * a ** 5 / 120)
    y = SCALE * (arc(lat) + n * math.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24
                                                + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * a ** 6 / 720))
    return EAST + x, y


def test_forward_and_inverse_agree_over_three_zones(spark):
    rows = [(float(lon), float(lat), 32600 + zone + (100 if lat < 0 else 0))
            for zone in (52, 53, 54) for lon in np.linspace(131.5, 139.5, 9) for lat in (-60, -33.3, -1, 0, 0.5, 34.7, 35, 61.2, 80)]
    there = project(spark.createDataFrame(rows, "lon double, lat double, code int"), "lon", "lat", "code")
    back = unproject(there, "x", "y", "code", "lon2", "lat2").collect()
    assert len(back) == len(rows)
    for r in back:
        assert abs(r["lon2"] - r["lon"]) * 111_320 < 1e-3 and abs(r["lat2"] - r["lat"]) * 111_320 < 1e-3
        if abs(r["lon"] - (r["code"] % 100 * 6 - 183)) <= 2:
            x, y = plainly(r["lon"], r["lat"], r["code"] % 100)
            assert abs(r["x"] - x) < 2e-3 and abs(r["y"] - (10_000_000 if r["lat"] < 0 else 0) - y) < 2e-3


def test_zones_meet_and_degrees_pass(spark):
    rows = [(138.0, 35.0, 4326, 32653), (138.0, 35.0, 4326, 4326), (None, 35.0, 4326, 32654), (138.0, 35.0, None, 32654)]
    df = spark.createDataFrame(rows, "x double, y double, source int, target int")
    found = [(r["a"], r["b"]) for r in reproject(df, "x", "y", "source", "target", "a", "b").collect()]
    assert found[1] == (138.0, 35.0) and found[2][0] is None and found[3] == (None, None)
    again = spark.createDataFrame([(*found[0], 32653, 32654)], "x double, y double, source int, target int")
    r = reproject(again, "x", "y", "source", "target", "a", "b").first()
    # The zones mirror each other about the meridian between them.
    assert abs(found[0][0] - EAST + r["a"] - EAST) < 1e-5 and abs(found[0][1] - r["b"]) < 1e-5


def test_bilinear_tiles_equal_a_loop(spark):
    rng = random.Random(4)
    cells = {(r, c): rng.uniform(0, 50) for r in range(70) for c in range(70) if rng.random() < 0.7}
    points = [(k, rng.uniform(-1.5, 71), rng.uniform(-1.5, 71)) for k in range(600)] + [(1000 + k, float(k), 31.0) for k in range(60)]
    held = spark.createDataFrame([("a", r, c, v) for (r, c), v in cells.items()] + [("b", 0, 0, 1.0), ("a", 5, 5, None)], "g string, row int, col int, v double")
    asked = spark.createDataFrame([("a", *p) for p in points], "g string, k long, fy double, fx double")
    got = {r["k"]: r["v"] for r in warp.gather(held.where("v IS NOT NULL"), asked, ["g"], ["k"], "v").collect()}
    want = {}
    for k, fy, fx in points:
        y, x = math.floor(fy), math.floor(fx)
        four = [((1 - abs(fy - r)) * (1 - abs(fx - c)), cells[r, c]) for r in (y, y + 1) for c in (x, x + 1) if (r, c) in cells]
        weight = sum(w for w, _ in four)
        if weight > 0:
            want[k] = sum(w * v for w, v in four) / weight
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


GRID = "region string, patch int, code int, left double, top double, res double, rows int, cols int"


def test_common_grids(spark):
    """In one system the overlap is known; other systems, grids apart and small overlaps."""
    grids = spark.createDataFrame([("a", 1, 32653, 1000.0, 9000.0, 50.0, 60, 80), ("a", 2, 32653, 90000.0, 9000.0, 50.0, 60, 60),
                                   ("a", 3, 32653, 4100.0, 9000.0, 50.0, 60, 60), ("b", 4, 32653, 1000.0, 9000.0, 50.0, 60, 60)], GRID)
    refs = spark.createDataFrame([("a", 32653, 0.0, 8050.0, 25.0, 200, 200)], GRID.replace("patch int, ", ""))
    found = [r.asDict() for r in warp.common_grids(grids, refs, ["region", "patch"], ["region"], 100.0).collect()]
    assert [r["patch"] for r in found] == [1]
    r = found[0]
    assert (r["width"], r["height"]) == (40, 20)
    assert abs(r["west"] - 1000) < 1e-5 and abs(r["north"] - 8050) < 1e-5 and abs(r["dx"] - 100) < 1e-6 and abs(r["dy"] - 2050 / 20) < 1e-6
    spots = warp.lattice(warp.common_grids(grids, refs, ["region", "patch"], ["region"], 100.0), ["region", "patch"]).collect()
    assert len(spots) == 800 and min(s["x"] for s in spots) - 1050 < 1e-5


def test_a_plane_stays_a_plane_across_zones(spark):
    """Values that grow evenly to the east come out as the common grid's own easting, whatever the zones."""
    grids = spark.createDataFrame([("a", 1, 32653, 770000.0, 3880000.0, 30.0, 64, 64)], GRID)
    refs = spark.createDataFrame([("a", 32654, 220000.0, 3884000.0, 800.0, 32, 32)], GRID.replace("patch int, ", ""))
    size = spark.range(64).selectExpr("int(id) AS row").crossJoin(spark.range(64).selectExpr("int(id) AS col"))
    centres = warp.cell_centres(size.crossJoin(grids))
    moved = reproject(centres.selectExpr("*", "32654 AS to"), "x", "y", "code", "to", "east", "north")
    mine = moved.selectExpr("region", "patch", "row", "col", "(east - 220000) / 1000 AS v")
    ref = size.where("row < 32 AND col < 32").selectExpr("'a' AS region", "row", "col", "(col + 0.5) * 0.8 AS w")
    pairs = warp.warped_pairs(mine, grids, ref, refs, "patch", "region", "v", "w").collect()
    assert len(pairs) > 300
    inner = [p for p in pairs if 1 < p["t_row"] < 17 and 1 < p["t_col"] < 17]
    assert inner and all(abs(p["v"] - p["w"]) < 2e-3 for p in inner)
