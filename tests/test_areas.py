"""Areas beside point-by-point tests in exact fractions."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from furrow.operators import areas

SCHEMA = "area_id int, rings array<array<struct<x:double,y:double>>>"


def edges(rings):
    return [(ring[k - 1], ring[k]) for ring in rings for k in range(len(ring))]


def side(e, p):
    (x1, y1), (x2, y2) = e
    return (Fraction(x2) - Fraction(x1)) * (Fraction(p[1]) - Fraction(y1)) - (Fraction(y2) - Fraction(y1)) * (Fraction(p[0]) - Fraction(x1))


def within(rings, p):
    crossings = 0
    for e in edges(rings):
        (x1, y1), (x2, y2) = e
        if side(e, p) == 0 and min(x1, x2) <= p[0] <= max(x1, x2) and min(y1, y2) <= p[1] <= max(y1, y2):
            return True
        if (y1 > p[1]) != (y2 > p[1]):
            crossings += Fraction(p[0]) < Fraction(x1) + (Fraction(p[1]) - Fraction(y1)) * (Fraction(x2) - Fraction(x1)) / (Fraction(y2) - Fraction(y1))
    return crossings % 2 == 1


def shapes():
    draw = random.Random(3)
    found = [[[(draw.randint(-40, 40), draw.randint(-40, 40)) for _ in range(draw.randint(3, 7))]] for _ in range(25)]
    found += [[[(-30, -30), (30, -30), (30, 30), (-30, 30)], [(-10, -10), (10, -10), (10, 10), (-10, 10)]]]  # a hole
    found += [[[(0, 0), (0, 0), (0, 0)]], [[(5, 5), (9, 5)]], [[(1, 1)]], [[(-1000, -1000), (1000, -1000), (0, 2000)]], [[(0.25, 0.25), (0.5, 0.25), (0.375, 0.5), (0.25, 0.25)]]]
    return dict(enumerate(found))


@pytest.fixture(scope="module")
def found_areas(spark):
    rows = [(k, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for k, rings in shapes().items()]
    return spark.createDataFrame([*rows, (900, []), (901, None), (902, [[]]), (903, [None, [{"x": None, "y": 1.0}]])], SCHEMA)


@pytest.mark.parametrize("most", [areas.MOST_CELLS, 0])
def test_points_in_areas(spark, found_areas, monkeypatch, most):
    monkeypatch.setattr(areas, "MOST_CELLS", most)
    points = [(float(x), float(y)) for x in range(-42, 43, 3) for y in range(-42, 43, 3)] + [(0.25, 0.25), (0.375, 0.3), (7.0, 5.0), (1.0, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate(points)] + [(None, 1.0, -1), (1e300, 1.0, -2)], "x double, y double, area_id long").withColumnRenamed("area_id", "edges")
    got = [(r.area_id, r.edges) for r in areas.within_areas(df, found_areas).collect()]
    assert sorted(got) == sorted((k, n) for k, rings in shapes().items() for n, p in enumerate(points) if within(rings, p))


def test_cells_meet_no_point_outside_their_areas_neighbourhood(spark, found_areas):
    cells = areas.cover(found_areas).collect()
    assert len(cells) == len({(c.area_id, c.scale, c.cell_x, c.cell_y) for c in cells}) and {c.area_id for c in cells} == set(shapes())
    own = shapes()
    for c in cells[::7]:
        size = 2.0**c.scale
        corners = [((c.cell_x + i) * size, (c.cell_y + j) * size) for i in (0, 1) for j in (0, 1)]
        if c.whole:
            assert all(within(own[c.area_id], p) for p in corners)


def test_no_areas(spark, found_areas):
    points = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert areas.within_areas(points, found_areas.limit(0)).columns == ["area_id", "x", "y"]
    assert areas.within_areas(points, found_areas.filter("area_id >= 900")).count() == 0


def test_one_area(spark):
    rings = [[(0, 0), (8, 0), (0, 8)]]
    pixels = spark.range(100).select((F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"))
    assert {(r.x, r.y) for r in areas.clip_to_area(pixels, rings).collect()} == {(float(x), float(y)) for x in range(10) for y in range(10) if x + y <= 8}
    assert areas.clip_to_area(pixels, []).count() == 0
    boxes = {"inside": (1, 1, 2, 2), "corner": (8, -1, 9, 0), "beyond": (5, 5, 9, 9), "around": (-5, -5, 20, 20), "across": (3, -9, 4, 20), "touching": (4, 4, 6, 6), "apart": (20, 20, 30, 30)}
    scenes = spark.createDataFrame([(n, *map(float, b)) for n, b in boxes.items()], "scene_id string, west double, south double, east double, north double")
    assert {r.scene_id for r in areas.scenes_of_area(scenes, rings).collect()} == {"inside", "corner", "around", "across", "touching"}
