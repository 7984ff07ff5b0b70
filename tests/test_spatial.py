import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.geo import meant_position
from gleaner.operators import spatial
from gleaner.operators.spatial import points_in_regions, points_within
from tests.conftest import rows


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    x = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(x)))


def table(spark, points):
    return spark.createDataFrame([(i, a, b, "x") for i, (a, b) in points], "id long, lat double, lon double, code string")


@pytest.mark.parametrize("radius", [0.5, 3.0, 40.0])
@pytest.mark.parametrize("broadcast", [True, False])
def test_against_brute_force(spark, radius, broadcast):
    rng = random.Random(7)
    spread = radius / 60
    near = [(i, (46.9 + rng.gauss(0, spread), 7.4 + rng.gauss(0, spread))) for i in range(300)]
    near += [(1000 + i, (46.9, 7.4)) for i in range(40)]  # a hot cell
    near += [(2000, (89.999, 10.0)), (2001, (89.999, -170.0)), (2002, (0.0, 179.999)), (2003, (0.0, -179.999))]
    centers = near[:60] + near[-4:]
    want = sorted((i, j) for i, a in near for j, b in centers if km(a, b) <= radius)
    got = rows(points_within(table(spark, near), table(spark, centers), radius, max_broadcast_rows=10**6 if broadcast else 1, hot_rows=10**6 if broadcast else 15))
    assert got == want


def test_nulls_repeats_and_empty(spark):
    p = spark.createDataFrame([(1, 47.0, 8.0), (1, 47.0, 8.0), (2, None, 8.0), (3, float("nan"), 8.0), (None, 47.0, 8.0)], "id long, lat double, lon double")
    c = spark.createDataFrame([("a", 47.0, 8.0), ("a", 47.0, 8.001), ("b", None, None)], "id string, lat double, lon double")
    assert sorted(points_within(p, c, 1.0).collect(), key=str) == sorted([(1, "a"), (None, "a")], key=str)
    assert points_within(p.limit(0), c, 1.0).count() == 0 and points_within(p, c.limit(0), 1.0).count() == 0


def test_swapped_positions(spark):
    df = spark.createDataFrame([(47.0, 8.0), (8.0, 47.0), (0.0, 0.0), (47.0, None), (float("nan"), 8.0)], "a double, b double")
    lat, lon = meant_position(F.col("a"), F.col("b"), (45.7, 47.95, 5.8, 10.7))
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(47.0, 8.0), (47.0, 8.0), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("limit", [10**6, 1])
def test_regions(spark, limit):
    ring = [(46.0, 7.0), (46.0, 8.0), (47.0, 8.0), (46.4, 7.5), (47.0, 7.0)]
    regions = spark.createDataFrame([("m", [{"lat": a, "lon": b} for a, b in ring]), ("none", None), ("line", [{"lat": 1.0, "lon": 1.0}])], "region_id string, ring array<struct<lat:double,lon:double>>")
    pts = table(spark, [(1, (46.2, 7.5)), (2, (46.9, 7.5)), (3, (46.9, 7.05)), (4, (40.0, 7.5))])
    assert rows(points_in_regions(pts, regions, max_broadcast_rows=limit)) == [(1, "m"), (3, "m")]


def _in(ring, lat, lon):
    inside = False
    for (a, x), (b, y) in zip(ring, ring[1:] + ring[:1]):
        if (a > lat) != (b > lat) and lon < x + (lat - a) / (b - a) * (y - x):
            inside = not inside
    return inside


def test_cover_of_a_ring():
    import math
    import random

    rng = random.Random(4)
    star = [(47 + (0.9 if k % 2 else 0.3) * math.sin(math.pi * k / 6), 8 + (1.2 if k % 2 else 0.4) * math.cos(math.pi * k / 6)) for k in range(12)]
    world = [(-89.0, -179.0), (-89.0, 179.0), (89.0, 179.0), (89.0, -179.0)]
    for ring, bits, span in ((star, 12, 2), (world, 8, 90)):
        found = list(spatial.cover_ring(ring, bits, 8))
        assert all(lo >> 8 == hi >> 8 == b for b, lo, hi, _ in found) and len({(lo, hi) for _, lo, hi, _ in found}) == len(found)
        mid = (47, 8) if ring is star else (0, 0)
        for _ in range(600):
            lat, lon = mid[0] + rng.uniform(-span, span), mid[1] + rng.uniform(-2 * span, 2 * span)
            n = 1 << bits
            y, x = min(n - 1, int((lat + 90) / 180 * n)), min(n - 1, int((lon + 180) / 360 * n))
            code = int(spatial._interleave(np.array([x]), np.array([y]))[0])
            hits = [inner for _, lo, hi, inner in found if lo <= code <= hi]
            assert len(hits) <= 1 and (not _in(ring, lat, lon) or hits) and (hits != [True] or _in(ring, lat, lon))
    assert sum(inner for *_, inner in spatial.cover_ring(star, 12, 8)) > 0
    assert len(list(spatial.cover_ring(world, 14, 28))) < 200_000  # by the line, not by the 268 million cells


def test_regions_too_large_to_send(spark, monkeypatch):
    rings = [("a", [(46.0, 7.0), (46.0, 9.0), (48.0, 9.0), (48.0, 7.0)]), ("b", [(47.0, 8.0), (47.5, 8.5), (47.0, 9.0)]), ("n", None), ("x", [(None, 1.0), (1.0, 1.0), (2.0, 2.0)])]
    regions = spark.createDataFrame([(k, r) for k, r in rings], "k string, ring array<struct<lat:double,lon:double>>")
    points = spark.range(400).selectExpr("id", "46.5D + (id % 20) * 0.1D AS lat", "7.5D + floor(id / 20) * 0.1D AS lon")
    args = dict(region=("k", "ring"), out=("id", "k"))
    small = rows(spatial.points_in_regions(points, regions, **args))
    monkeypatch.setattr(spatial, "fits_broadcast", lambda *_: False)
    assert small == rows(spatial.points_in_regions(points, regions, max_broadcast_rows=0, hot_rows=50, **args))
    want = [(r.id, k) for r in points.collect() for k, ring in rings[:2] if _in(ring, r.lat, r.lon)]
    assert small == sorted(want)
