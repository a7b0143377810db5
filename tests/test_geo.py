import itertools
import math

from wattpanel.operators import geo as G


def _hav(lat1, lon1, lat2, lon2, r=G.EARTH_RADIUS_KM):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(a))


def test_grid_distance_join_equals_brute_force(spark):
    caps = [(i, 57.0 + 0.37 * i, 21.0 + 0.61 * i) for i in range(8)]
    pts = [(57.0 + 0.13 * a, 20.5 + 0.29 * b) for a, b in itertools.product(range(20), range(25))]
    c = spark.createDataFrame(caps, "county long, latitude double, longitude double")
    s = spark.createDataFrame(pts, "latitude double, longitude double")
    for swap in (False, True):
        got = {(r.county, round(r.latitude, 4), round(r.longitude, 4))
               for r in G.stations_within_km(c, s, 60.0, swap_axes=swap).collect()}
        want = set()
        for k, la, lo in caps:
            for pla, plo in pts:
                d = _hav(lo, la, plo, pla) if swap else _hav(la, lo, pla, plo)
                if d < 60.0:
                    want.add((k, round(float(__import__("numpy").float32(pla)), 4),
                              round(float(__import__("numpy").float32(plo)), 4)))
        assert got == want


def test_weights_sum_to_one_and_unknown(spark):
    near = spark.createDataFrame([(1, 1.0, 2.0, 10.0), (1, 1.5, 2.0, 30.0), (2, 1.0, 2.0, 5.0)],
                                 "county long, longitude float, latitude float, dist double")
    w = G.distance_weights(near).collect()
    assert abs(sum(r.weights for r in w if r.county == 1) - 1.0) < 1e-12
    assert [round(r.weights, 3) for r in w if r.county == 1 and r.dist == 30.0] == [0.75]
    inv = {r.dist: r.weights for r in G.distance_weights(near, "inverse").collect() if r.county == 1}
    assert inv[10.0] > inv[30.0]
    u = G.unknown_county_weights(near).collect()
    assert len(u) == 2 and all(r.county == 12 and r.weights == 0.5 for r in u)


def test_point_in_polygon_edges(spark):
    # unit square for county 1, triangle for county 2
    sq = [(1, 0.0, 0.0, 1.0, 0.0), (1, 1.0, 0.0, 1.0, 1.0), (1, 1.0, 1.0, 0.0, 1.0), (1, 0.0, 1.0, 0.0, 0.0)]
    tri = [(2, 2.0, 0.0, 3.0, 0.0), (2, 3.0, 0.0, 2.5, 1.0), (2, 2.5, 1.0, 2.0, 0.0)]
    edges = spark.createDataFrame(sq + tri, "county long, x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(0.5, 0.5), (2.5, 0.3), (5.0, 0.5), (1.5, 0.5)], "longitude double, latitude double")
    got = {(r.longitude, r.latitude): r.county for r in G.point_in_polygon(pts, edges, band=0.25).collect()}
    assert got == {(0.5, 0.5): 1, (2.5, 0.3): 2, (5.0, 0.5): None, (1.5, 0.5): None}


def test_weather_to_county_weighted_sum(spark):
    st = spark.createDataFrame([(1, 1.0, 2.0, 0.25), (1, 1.5, 2.0, 0.75)],
                               "county long, longitude float, latitude float, weights double")
    wx = spark.createDataFrame([(1, 1.0, 2.0, 4.0), (1, 1.5, 2.0, 8.0), (1, 9.0, 9.0, 100.0)],
                               "datetime int, longitude double, latitude double, x double")
    r = G.weather_to_county(wx, st, ["x"]).collect()
    assert len(r) == 1 and r[0].x == 7.0
