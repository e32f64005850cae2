import math
import random

import pytest

from railflow.operators import spatial


def _metres(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    s = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(a[2] - b[2]) / 2) ** 2
    return 2000 * 6378.137 * math.asin(math.sqrt(s))


def _points(kind):
    rng = random.Random(13)
    if kind == "spread":
        pts = [(rng.uniform(22, 23), rng.uniform(113, 115)) for _ in range(120)]
    elif kind == "clustered":  # most in one spot, the rest far away
        pts = [(22.5 + rng.random() * 1e-3, 114 + rng.random() * 1e-3) for _ in range(200)]
        pts += [(rng.uniform(-60, 70), rng.uniform(-20, 60)) for _ in range(40)]
    elif kind == "two cities":  # dense spots a few cells apart on the curve, and strays between them
        pts = [(c + rng.gauss(0, 1e-4), c + rng.gauss(0, 1e-4)) for c in (0.0, 45.0) for _ in range(120)] + [(rng.uniform(0, 45), rng.uniform(0, 45)) for _ in range(30)]
    elif kind == "one":
        pts = [(1.0, 2.0)]
    elif kind == "edges":  # across the date line and round a pole
        pts = [(rng.uniform(-20, -15), rng.choice([-1, 1]) * rng.uniform(179.5, 180)) for _ in range(60)]
        pts += [(rng.uniform(89.5, 90), rng.uniform(-180, 180)) for _ in range(40)] + [(-17.0, 180.0), (-17.0001, -180.0)]
    else:  # shared positions
        pts = [(22.0 + (i // 3) * 0.01, 114.0) for i in range(30)]
    return [(f"s{i:03d}", lat, lon) for i, (lat, lon) in enumerate(pts)]


@pytest.mark.parametrize("kind", ["spread", "clustered", "two cities", "edges", "shared"])
def test_nearest_station_equals_brute_force(spark, kind):
    pts = _points(kind)
    df = spark.createDataFrame(pts, "name string, lat double, lon double")
    got = {r["name"]: (r["nearest"], r["dist"]) for r in spatial.nearest_station(df).collect()}
    assert len(got) == len(pts)
    for p in pts:
        best = min(_metres(p, q) for q in pts if q[0] != p[0])
        assert got[p[0]][0] != p[0] and got[p[0]][1] == pytest.approx(best, abs=1e-6)


def test_few_stations(spark):
    empty = spark.createDataFrame([], "name string, lat double, lon double")
    assert spatial.nearest_station(empty).count() == 0
    one = spark.createDataFrame(_points("one"), "name string, lat double, lon double")
    assert spatial.nearest_station(one).count() == 0
    two = spark.createDataFrame([("a", 89.9, 10.0), ("b", -89.9, -170.0)], "name string, lat double, lon double")
    got = {r["name"]: (r["nearest"], r["dist"]) for r in spatial.nearest_station(two).collect()}
    assert {n: x for n, (x, _) in got.items()} == {"a": "b", "b": "a"} and got["a"][1] == pytest.approx(_metres(("a", 89.9, 10.0), ("b", -89.9, -170.0)))
