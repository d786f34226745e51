"""interval_or_nearest against brute force: held, else the nearest middle at any distance, ties to the first interval."""

import random

import pytest

from tests.duck import DATA, check
from tilth.operators import sequences
from tilth.plans import registry


@pytest.mark.parametrize("seed", range(3))
def test_points_outside_all_intervals_get_the_nearest(spark, seed):
    rnd = random.Random(seed)
    spans = [(k, i, a, a + 2 * rnd.randint(0, 6)) for i, (k, a) in enumerate((rnd.choice("ab"), rnd.choice([rnd.randint(0, 60), rnd.randint(900, 5000)])) for _ in range(25))]
    points = [(rnd.choice("abc"), i, rnd.randint(-500, 6000) if i % 3 else rnd.randint(0, 80)) for i in range(150)] + [("a", 900, None)]
    spans += [("d", 100, 0, 10), ("d", 101, 20, 30), ("d", 99, 20, 30), (None, 102, 0, 1), ("d", 103, None, None)]
    points += [("d", 901, 15), ("d", 902, 16), ("d", 903, 10**6), ("d", 904, -(10**6)), (None, 905, 0)]

    def expected(k, t):
        own = [s for s in spans if s[0] == k and k is not None and s[2] is not None]
        if not own or t is None:
            return None
        held = [s[1] for s in own if s[2] <= t <= s[3]]
        return min(held) if held else min((abs(t - (s[2] + s[3]) / 2), s[1]) for s in own)[1]

    frames = spark.createDataFrame(points, "k string, point long, s long"), spark.createDataFrame(spans, "k string, seq long, start long, end long")
    got = sequences.interval_or_nearest(*frames, ["k"], "s", 10).collect()
    assert len(got) == len(points)
    assert {r.point: r.held for r in got} == {p: expected(k, t) for k, p, t in points}


def test_query_equals_sql(spark):
    df = registry.QUERIES["interval_or_nearest"](spark, str(DATA / "sf0.01"))
    check(df, registry.ORACLE_SQL["interval_or_nearest"], "sf0.01")
