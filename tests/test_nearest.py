"""nearest() gives k neighbours at any distance, against brute force."""

import math
import random

from tests.duck import DATA, check
from tilth.operators import spatial
from tilth.plans import registry


def test_far_points_get_their_neighbours(spark):
    rnd = random.Random(4)
    points = [(rnd.choice("ab"), i, rnd.uniform(0, 20), rnd.uniform(0, 20)) for i in range(60)] + [("a", 100, 500.0, -900.0), ("b", 101, 5000.0, 1.0)]
    points += [("c", 200, 0.0, 0.0), ("c", 201, 300.0, 0.0), ("d", 300, 0.0, 0.0), ("a", 400, None, 0.0), ("a", 401, float("inf"), 0.0), (None, 402, 0.0, 0.0), (None, 403, 1.0, 0.0)]
    real = [p for p in points if p[0] and p[2] is not None and math.isfinite(p[2])]
    expected = {}
    for k, i, x, y in real:
        near = sorted((math.hypot(x - p[2], y - p[3]), p[1]) for p in real if p[0] == k and p[1] != i)[:3]
        expected |= {(i, rank + 1): other for rank, (_, other) in enumerate(near)}
    got = spatial.nearest(spark.createDataFrame(points, "k string, id long, x double, y double"), ["k"], 3, 2.0).collect()
    assert len(got) == len(expected) and {(r.id, r.rank): r.other for r in got} == expected


def test_query_equals_sql(spark):
    check(registry.QUERIES["nearest_points"](spark, str(DATA / "sf0.001")), registry.ORACLE_SQL["nearest_points"], "sf0.001")
