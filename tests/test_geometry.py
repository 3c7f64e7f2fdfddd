"""Boxes against concave and holed polygons, by brute force, and lattices dealt out in blocks."""

import random

import pytest

from understory.operators import geometry as G, grids as GR

L = [[[0.0, 0.0], [10.0, 0.0], [10.0, 4.0], [4.0, 4.0], [4.0, 10.0], [0.0, 10.0], [0.0, 0.0]]]
HOLED = [[[20.0, 0.0], [32.0, 1.0], [31.0, 12.0], [19.0, 11.0]], [[22.0, 3.0], [29.0, 3.0], [29.0, 9.0], [22.0, 9.0], [22.0, 3.0]]]
STAR = [[[40.0, 0.0], [43.0, 8.0], [50.0, 3.0], [44.0, 11.0], [49.0, 18.0], [41.0, 13.0], [36.0, 19.0], [38.0, 10.0], [33.0, 4.0], [39.0, 7.0]]]


def sides_of(rings):
    for ring in rings:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if a != b:
                yield a, b


def inside(rings, x, y):
    return sum((a[1] > y) != (b[1] > y) and x < a[0] + (b[0] - a[0]) * ((y - a[1]) / (b[1] - a[1])) for a, b in sides_of(rings)) % 2 == 1


def crosses(p, q, r, s):
    def turn(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def on(a, b, c):
        return turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])

    return (turn(p, q, r) * turn(p, q, s) < 0 and turn(r, s, p) * turn(r, s, q) < 0) or on(p, q, r) or on(p, q, s) or on(r, s, p) or on(r, s, q)


def meets(rings, box):
    x0, y0, x1, y1 = box
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    if any(x0 <= a[0] <= x1 and y0 <= a[1] <= y1 for a, _ in sides_of(rings)) or any(inside(rings, *c) for c in corners):
        return True
    return any(crosses(a, b, p, q) for a, b in sides_of(rings) for p, q in zip(corners, corners[1:] + corners[:1]))


@pytest.mark.parametrize("tile", [1.7, 5.0, 100.0])
def test_boxes_on_polygons(spark, tile):
    rng = random.Random(2)
    boxes = [(x, y, x + 1.5, y + 1.5) for x in range(-2, 53, 2) for y in range(-2, 20, 2)]
    boxes += [(5.0, 5.0, 6.0, 6.0), (23.0, 4.0, 28.0, 8.0), (1.0, 1.0, 2.0, 2.0), (-50.0, -50.0, 90.0, 90.0), (10.0, 4.0, 11.0, 5.0), (4.0, 4.0, 9.0, 9.0)]
    for _ in range(150):
        x, y = rng.uniform(-3, 52), rng.uniform(-3, 20)
        boxes.append((x, y, x + rng.uniform(0.1, 6), y + rng.uniform(0.1, 6)))
    polygons = {"l": L, "holed": HOLED, "star": STAR}
    df = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(boxes)], "id int, min_x double, min_y double, max_x double, max_y double")
    sides = G.edges(spark.createDataFrame(list(polygons.items()), "name string, rings array<array<array<double>>>"), ["name"])
    rows = [(r.id, r.name) for r in G.boxes_on_polygons(df, sides, "id", ["name"], tile).collect()]
    want = {(k, n) for k, b in enumerate(boxes) for n, rings in polygons.items() if meets(rings, b)}
    assert set(rows) == want and len(rows) == len(want)
    at = {b: k for k, b in enumerate(boxes)}
    assert (at[(5.0, 5.0, 6.0, 6.0)], "l") not in want and (at[(23.0, 4.0, 28.0, 8.0)], "holed") not in want


def test_a_lattice_is_dealt_out_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(GR, "BLOCK", 7)
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 95.0, 42.0), (2, 5.0, 5.0, 6.0, 6.0)], "b int, min_x double, min_y double, max_x double, max_y double")
    grid = GR.stride_grid(boxes, 12.0, 10.0)
    got = sorted((r.b, r.cell_no, r.min_x, r.min_y, r.max_x, r.max_y, r.bound_x) for r in grid.collect())
    want = [(1, i * 5 + j, 10.0 * i, 10.0 * j, 10.0 * i + 12, 10.0 * j + 12, 95.0) for i in range(10) for j in range(5)]
    assert got == [*want, (2, 0, 5.0, 5.0, 17.0, 17.0, 6.0)]
    used = grid.where("b = 1").selectExpr("spark_partition_id() AS p").distinct().count()
    assert used > 1
