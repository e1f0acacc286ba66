"""Lines and polygons against every comparison."""

import math
import random
from collections import Counter

import pytest

from millrace.operators import geometry as G

POINTS = "id long, x double, y double"
SHAPES = "name string, v array<array<double>>"


def gap(x, y, ax, ay, bx, by):
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - ax - t * dx, y - ay - t * dy)


def holds(v, x, y):
    inside = False
    for (ax, ay), (bx, by) in zip(v, [v[-1], *v[:-1]], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def random_points(rng, n, clustered=True):
    rows = [(i, rng.uniform(-50, 150), rng.uniform(-50, 150)) for i in range(n)]
    rows += [(n + i, 10 + rng.random(), 10 + rng.random()) for i in range(n if clustered else 0)]  # one cell
    return rows + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1.0, float("inf")), (-4, 1e5, -1e5), (5, 33.0, 40.0), (5, 33.0, 40.0)]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(1)
    made = [(f"f{k}", [[rng.uniform(0, 100), rng.uniform(0, 100)] for _ in range(rng.randint(1, 5))]) for k in range(25)]
    return made + [("long", [[-40.0, 120.0], [140.0, 120.0]]), ("dot", [[5.0, 5.0], [5.0, 5.0]]), ("same", made[0][1]), ("empty", []), ("null", None), ("tall", [[120.0, -30.0], [120.0, 90.0]])]


@pytest.mark.parametrize("hot", [20_000, 7])
def test_nearest_line(spark, lines, hot, monkeypatch):
    monkeypatch.setattr(G, "HOT", hot)
    points = random_points(random.Random(2), 150)
    got = G.nearest_line(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, SHAPES), "x", "y", "name", "v", 5.0).collect()
    assert len(got) == len(points)
    for r in got:
        if r.id in (-1, -2, -3):
            assert (r.nearest_id, r.distance, r.within_buffer) == (None, None, None)
            continue
        best = min((gap(r.x, r.y, *a, *b), name) for name, v in lines for a, b in zip(v or [], (v or [])[1:], strict=False))
        assert (r.nearest_id, r.within_buffer) == (best[1], best[0] <= 5) and r.distance == pytest.approx(best[0], rel=1e-12, abs=1e-9)


@pytest.mark.parametrize("copy", [1e-4, 50.0, 1e6])
def test_nearest_of_long_lines(spark, monkeypatch, copy):
    """Lines that cross everything stand in small cells, by the number of points, not in cells as long as they are."""
    monkeypatch.setattr(G, "COPY", copy)
    rng = random.Random(8)
    crossing = [(f"c{k % 7}", [[rng.uniform(0, 100), rng.uniform(0, 100)] for _ in range(12)]) for k in range(6)]
    points = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(120)] + [(900, 250.0, -40.0), (901, -0.0, 0.0), (901, 0.0, -0.0)]
    got = G.nearest_line(spark.createDataFrame(points, POINTS), spark.createDataFrame(crossing, SHAPES), "x", "y", "name", "v", 1.0).collect()
    expected = [(i, *min((gap(x, y, *a, *b), name) for name, v in crossing for a, b in zip(v, v[1:], strict=False))) for i, x, y in points]
    assert sorted((r.id, r.nearest_id) for r in got) == sorted((i, name) for i, _, name in expected)
    assert [r.distance for r in sorted(got, key=lambda r: (r.id, r.distance))] == pytest.approx([d for _, d, _ in sorted(expected)], abs=1e-9)


def test_no_lines_and_no_points(spark):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0)], POINTS)
    for rows in ([], [("a", [[1.0, 2.0]]), ("b", [[None, 2.0], [3.0, 4.0]])]):
        none = spark.createDataFrame(rows, SHAPES)
        assert sorted(map(tuple, G.nearest_line(points, none, "x", "y", "name", "v", 1.0).select("id", "nearest_id", "distance", "within_buffer").collect())) == [(1, None, 0.0, False), (2, None, None, None)]
    line = spark.createDataFrame([("a", [[1.0, 1.0], [1.0, 1.0]])], SHAPES)
    assert G.nearest_line(points.limit(0), line, "x", "y", "name", "v", 1.0).collect() == []
    assert [r.distance for r in G.nearest_line(points.where("id = 1"), line, "x", "y", "name", "v", 1.0).collect()] == [0.0]
    with pytest.raises(ValueError):
        G.nearest_line(points, line, "x", "y", "name", "v", 0.0)


def star(rng, x, y, r, n):
    return [[x + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)] for i in range(n)]


@pytest.fixture(scope="module")
def fields():
    rng = random.Random(3)
    made = [(f"p{k}", star(rng, rng.uniform(0, 100), rng.uniform(0, 100), rng.choice([0.5, 5, 30, 80]), rng.choice([3, 7, 40]))) for k in range(20)]
    return made + [("square", [[0.0, 0.0], [0.0, 64.0], [64.0, 64.0], [64.0, 0.0]]), ("bow", [[0.0, 0.0], [50.0, 50.0], [50.0, 0.0], [0.0, 50.0]]), ("flat", [[0.0, 0.0], [9.0, 0.0], [20.0, 0.0]]), ("two", [[0.0, 0.0], [50.0, 50.0]]), ("none", []), ("null", None)]


def near(v, x, y, buffer):
    if len(v or []) < 3:
        return not v
    return holds(v, x, y) or min(gap(x, y, *a, *b) for a, b in zip(v, [*v[1:], v[0]], strict=True)) < buffer


@pytest.mark.parametrize("buffer,hot", [(0.0, 20_000), (3.0, 9), (25.0, 20_000)])
def test_polygons(spark, fields, buffer, hot, monkeypatch):
    monkeypatch.setattr(G, "HOT", hot)
    points = random_points(random.Random(4), 200)
    table, shapes = spark.createDataFrame(points, POINTS), spark.createDataFrame(fields, SHAPES)
    good = [p for p in points if p[0] not in (-1, -2, -3)]
    got = G.inside_polygons(table, shapes, "x", "y", "name", "v", buffer).select("id", "polygon_id").collect()
    assert Counter(map(tuple, got)) == Counter((i, name) for i, x, y in good for name, v in fields if len(v or []) >= 3 and near(v, x, y, buffer))
    names = [n for n, _ in fields] + ["unknown", None]
    asked = [(*p, names[k % len(names)]) for k, p in enumerate(points)]
    got = G.within_boundary(spark.createDataFrame(asked, POINTS + ", field string"), shapes, "x", "y", "field", "name", "v", buffer).select("id", "x", "field", "within_buffer")
    known = dict(fields)
    expected = Counter((i, repr(x), f, near(known[f], x, y, buffer) if f in known and i not in (-1, -2, -3) else None) for i, x, y, f in asked)
    assert Counter((r.id, repr(r.x), r.field, r.within_buffer) for r in got.collect()) == expected


def test_no_polygons(spark):
    points, none = spark.createDataFrame([(1, 1.0, 1.0)], POINTS), spark.createDataFrame([], SHAPES)
    assert G.inside_polygons(points, none, "x", "y", "name", "v").collect() == []
    assert G.inside_polygons(points.limit(0), spark.createDataFrame([("a", [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0]])], SHAPES), "x", "y", "name", "v").collect() == []
    with pytest.raises(ValueError):
        G.inside_polygons(points, none, "x", "y", "name", "v", -1.0)
