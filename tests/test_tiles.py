"""Windows and shifts over tiles with a margin, against plain loops; tiles are made so small that most windows cross them."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from understory.operators import alignment as A, neighbourhood as N, tiles


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 6)
    monkeypatch.setattr(A, "TILE", 6)
    monkeypatch.setattr(N, "TEXTURE_TILE", 5)


def scattered(rng, size=15, share=0.75, low=-1.0, high=1.0):
    return {(r, c): rng.uniform(low, high) for r in range(size) for c in range(size) if rng.random() < share}


def frame(spark, cells, extra=()):
    return spark.createDataFrame([("g", r, c, v) for (r, c), v in cells.items()] + list(extra), "g string, row int, col int, v double")


def around(cells, r, c, radius):
    return [v for (y, x), v in cells.items() if abs(y - r) <= radius and abs(x - c) <= radius]


@pytest.mark.parametrize("radius", [1, 2, 7])
def test_window_statistics(spark, small_tiles, radius):
    cells = scattered(random.Random(radius), low=-20, high=400)
    missing = [("g", 3, 40, None), ("g", 40, 3, float("nan"))]
    means = {(x.row, x.col): x.v_filtered for x in N.focal_mean(frame(spark, cells, missing), ["g"], ["v"], radius).collect()}
    assert means.pop((3, 40)) is None and means.pop((40, 3)) is None and means.keys() == cells.keys()
    speckle = {(x.row, x.col): x.v for x in N.gamma_map(frame(spark, cells, missing), ["g"], "v", 2 * radius + 1, 4.0).collect()}
    assert speckle.keys() == cells.keys()
    for at, v in cells.items():
        near = around(cells, *at, radius)
        m, s = np.mean(near), np.var(near)
        w = (m * m / s) / (m * m / s + 4.0) if s > 0 else 1.0
        assert means[at] == pytest.approx(m, abs=1e-9) and speckle[at] == pytest.approx(m * w + v * (1 - w), abs=1e-6)


def test_a_constant_and_a_lone_cell_stay(spark, small_tiles):
    cells = {(r, c): 7.1 for r in range(9) for c in range(9)} | {(30, 30): -3.3}
    got = {(x.row, x.col): x.v for x in N.gamma_map(frame(spark, cells), ["g"], "v", 5, 4.0).collect()}
    assert all(got[at] == pytest.approx(v, abs=1e-9) for at, v in cells.items())


def test_slopes_across_tiles(spark, small_tiles):
    cells = {(r, c): 3.0 * r + 4.0 * c for r in range(14) for c in range(14) if (r, c) != (7, 7)}
    got = {(x.row, x.col): x for x in N.slope_aspect(frame(spark, cells), ["g"], "v", 10.0).collect()}
    assert got.keys() == {(r, c) for r in range(1, 13) for c in range(1, 13) if max(abs(r - 7), abs(c - 7)) > 1}
    assert all(x.slope == pytest.approx(math.degrees(math.atan(0.5))) and x.v == cells[at] for at, x in got.items())


def textures_slowly(cells, r, c, half):
    levels = {at: int((v + 1) * 127.5) for at, v in cells.items()}
    per = []
    for dy, dx in N.GLCM_STEPS:
        counts = Counter()
        for (y, x), i in levels.items():
            j = levels.get((y + dy, x + dx))
            if j is not None and all(abs(p - r) <= half and abs(q - c) <= half for p, q in ((y, x), (y + dy, x + dx))):
                counts[i, j] += 1
                counts[j, i] += 1
        n = sum(counts.values())
        if n:
            p = {k: m / n for k, m in counts.items()}
            mu = sum(q * i for (i, _), q in p.items())
            var = sum(q * i * i for (i, _), q in p.items()) - mu * mu
            cov = sum(q * i * j for (i, j), q in p.items()) - mu * mu
            per.append([sum(q * q for q in p.values()), sum(q * (i - j) ** 2 for (i, j), q in p.items()), cov / var if var > 1e-12 else 0.0, var,
                        sum(q / (1 + (i - j) ** 2) for (i, j), q in p.items()), 2 * mu, -sum(q * math.log(q) for q in p.values()),
                        sum(q * (i - j) ** 2 for (i, j), q in p.items()) - sum(q * abs(i - j) for (i, j), q in p.items()) ** 2])
    return np.mean(per, axis=0) if per else None


@pytest.mark.parametrize("window", [3, 5])
def test_textures(spark, small_tiles, window):
    rng = random.Random(window)
    first, second = scattered(rng, 9), {at: round(v, 1) for at, v in scattered(rng, 9, 0.5).items()}
    rows = [("g", r, c, first.get((r, c)), second.get((r, c))) for r, c in sorted({*first, *second})] + [("g", 50, 50, 0.5, None)]
    df = spark.createDataFrame(rows, "g string, row int, col int, a double, b double")
    want = {}
    for band, cells in (("a", first | {(50, 50): 0.5}), ("b", second)):
        for at in cells:
            found = textures_slowly(cells, *at, window // 2)
            if found is not None:
                want[(*at, band)] = found
    got = {(x.row, x.col, x.band): [x[m] for m in N.GLCM_MEASURES] for x in N.glcm(df, ["g"], ["a", "b"], window).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    cell = {(x.row, x.col): x for x in N.band_textures(df, ["g"], ["a", "b"], window).collect()}
    assert cell.keys() == {k[:2] for k in want}
    for at, x in cell.items():
        both = np.array([v for k, v in want.items() if k[:2] == at])
        assert np.allclose([x[f"mean_{m}"] for m in N.GLCM_MEASURES], both.mean(axis=0), atol=1e-6)
        assert np.allclose([x[f"median_{m}"] for m in N.GLCM_MEASURES], np.median(both, axis=0), atol=1e-6)


@pytest.mark.parametrize("wrap", [False, True])
def test_shifts(spark, small_tiles, wrap):
    rng, size = random.Random(5), 14
    px = [(p, r, c, rng.choice([None, rng.uniform(-5, 130)]), rng.choice([None, rng.uniform(0, 60), rng.uniform(0, 60)]))
          for p in (1, 2) for r in range(size) for c in range(size)]
    df = spark.createDataFrame([*px, (3, 0, 0, None, None)], "patch_num int, row int, col int, rh double, pred double")
    shifts = A.square_shifts(2)
    got = {(x.patch_num, x.dx, x.dy): x for x in A.shift_sums(df, "rh", "pred", shifts, size, wrap, bound=9.0).collect()}
    preds = {(p, r, c): v for p, r, c, _, v in px if v is not None}
    want = {}
    for p, r, c, t, _ in px:
        for dx, dy in shifts if t is not None and 0 < t < 100 else []:
            y, x = (r + dy, c + dx) if not wrap else ((r + dy) % size, (c + dx) % size)
            if (p, y, x) in preds:
                d = min(abs(preds[p, y, x] - t), 9.0)
                row = want.setdefault((p, dx, dy), [0, 0.0, 0.0, 0.0])
                for k, part in enumerate((1, t, preds[p, y, x], 0.5 * d * d if d < 1 else d - 0.5)):
                    row[k] += part
    assert got.keys() == want.keys()
    assert all(np.allclose([got[k].n, got[k].target_sum, got[k].pred_sum, got[k].loss_sum], want[k]) for k in want)


def test_elevation_stack(spark, small_tiles):
    plane = {(r, c): 3.0 * r + 4.0 * c for r in range(8) for c in range(8)}
    first = frame(spark, plane).withColumnRenamed("v", "elevation")
    flat = frame(spark, {(0, 0): 5.0, (20, 20): 6.0}, [("g", 1, 1, None)]).withColumnRenamed("v", "elevation")
    found = N.elevation_stack({"SRTM": first, "GMTED": None, "AW3D30": flat}, ["g"], 10.0)
    assert found.columns == ["g", "row", "col", "SRTM_elevation", "SRTM_slope", "SRTM_aspect", "AW3D30_elevation"]
    rows = {(x.row, x.col): x for x in found.collect()}
    assert rows.keys() == {*plane, (20, 20)} and rows[0, 0].AW3D30_elevation == 5.0 and rows[20, 20].SRTM_elevation is None
    for (r, c), v in plane.items():
        x = rows[r, c]
        assert x.SRTM_elevation == v and (x.SRTM_slope is None) == (x.SRTM_aspect is None) == (not (0 < r < 7 and 0 < c < 7))
    for wrong in ({"SRTM": None}, {"other": first}):
        with pytest.raises(ValueError):
            N.elevation_stack(wrong, ["g"], 10.0)
