"""Polygon covers against the plain ray rule, distance joins on the whole sphere against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from test_geo import _hav
from wattpanel.operators import geo as G


def _ring(region, points):
    return [(region, *a, *b) for a, b in zip(points, points[1:] + points[:1])]


def _star(rng, region, cx, cy, n, snap):
    out = []
    for k in range(n):
        r = rng.uniform(0.2, 1.3)
        x, y = cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)
        out.append((round(x / snap) * snap, round(y / snap) * snap) if snap else (x, y))
    ring = [p for i, p in enumerate(out) if p != out[i - 1]]
    return _ring(region, ring)


def _plain(edges, x, y):
    odd = {}
    for g, x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd[g] = odd.get(g, 0) + 1
    inside = [g for g, n in odd.items() if n % 2]
    return (min(inside) if inside else None, len(inside))


@pytest.mark.parametrize("snap, cell", [(0, 0.25), (0.25, 0.25), (0.125, 0.5), (0, 3.0)])
def test_cover_equals_the_ray_rule(spark, snap, cell):
    rng = random.Random(int(100 * cell) + int(1000 * snap))
    edges = []
    for g in range(12):
        edges += _star(rng, g, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([3, 5, 9, 40]), snap)
    points = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(1500)]
    points += [(i * cell / 2, j * cell / 2) for i in range(-16, 17) for j in range(-16, 17) if abs(i * cell) < 9 and abs(j * cell) < 9]  # corners, centres, grid lines
    points = sorted(set(points))
    e = spark.createDataFrame(edges, "county long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame(points, "longitude double, latitude double")
    got = {(r.longitude, r.latitude): (r.county, r.n_regions) for r in G.point_in_polygon(p, e, cell).collect()}
    assert got == {q: _plain(edges, *q) for q in points}


def test_points_meet_only_edges_of_their_cell(spark):
    regions, side = 1000, 32
    boxes = [(g % side, g // side) for g in range(regions)]
    edges = [x for g, (a, b) in enumerate(boxes) for x in _ring(g, [(a + 0.03 + 0.02 * k, b + 0.03) for k in range(48)] + [(a + 0.97, b + 0.97), (a + 0.03, b + 0.97)])]
    e = spark.createDataFrame(edges, "county long, x1 double, y1 double, x2 double, y2 double")
    rng = random.Random(3)
    points = [(rng.uniform(0, side), rng.uniform(0, side)) for _ in range(4000)]
    p = spark.createDataFrame(points, "longitude double, latitude double")
    cells, cell_edges = G.polygon_cover(e, 0.125)
    most = cell_edges.groupBy("county", "_cx", "_cy").count().agg(F.max("count")).first()[0]
    assert most <= 12  # of the 50 edges of a region and the 1,600 of a row of regions
    inner = cells.filter("base and not _mixed").count()
    assert inner > 20 * regions
    got = {(r.longitude, r.latitude): r.county for r in G.point_in_polygon(p, e, 0.125).collect()}
    want = {}
    for x, y in points:
        near = [t for t in (int(x) + side * int(y),) if t < regions]
        want[x, y] = _plain([q for t in near for q in edges[50 * t: 50 * t + 50]], x, y)[0]
    assert got == want


def test_empty_points_and_edges(spark):
    e = spark.createDataFrame([], "county long, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1.0, 1.0)], "longitude double, latitude double")
    assert [tuple(r) for r in G.point_in_polygon(p, e).collect()] == [(1.0, 1.0, None, 0)]
    assert G.point_in_polygon(p.limit(0), e).collect() == []


@pytest.mark.parametrize("km", [40.0, 700.0, 9000.0])
def test_distance_join_on_the_whole_sphere(spark, km):
    rng = random.Random(int(km))

    def near(lat, lon):
        return (max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * km / 100)), (lon + rng.uniform(-1, 1) * km / 60 + 180) % 360 - 180)

    caps = [(89.99, 10.0), (-89.95, -170.0), (90.0, 0.0), (65.0, 179.95), (-17.0, -179.99), (0.0, 180.0), (0.0, -180.0), (45.0, 0.001), (12.0, 97.0), (89.0, -60.0)]
    caps += [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(6)]
    pts = [near(*c) for c in caps for _ in range(40)] + [(89.99, -170.0), (-89.95, 10.0), (65.0, -179.95), (0.0, 179.9), (90.0, 55.0)]
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(caps)], "county long, latitude double, longitude double")
    s = spark.createDataFrame(sorted(set(pts)), "latitude double, longitude double")
    got = sorted((r.county, round(r.dist, 6)) for r in G.stations_within_km(c, s, km, swap_axes=False).collect())
    want = sorted((i, round(d, 6)) for i, x in enumerate(caps) for q in set(pts) if (d := _hav(*x, *q)) < km)
    assert got == want
    assert any(abs(caps[i][1]) > 179 for i, _ in want)
