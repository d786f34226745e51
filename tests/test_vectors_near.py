"""The nearest rows of query vectors against brute force: copies, repeated ids, odd vectors, and many pairs in little time."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from tilth.operators import spatial


def brute(queries, rows, k):
    out = set()
    for q, a in queries:
        near = sorted((round(float(np.sqrt(sum((x - y) * (x - y) for x, y in zip(a, b, strict=True)))), 6), i) for i, b in rows if i != q)
        out |= {(q, i, d, n + 1) for n, (d, i) in enumerate(near[:k])}
    return out


def test_nearest_vectors_with_copies_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 5)).round(2)
    rows = [(i, base[i % 40].tolist()) for i in range(300)] + [(7, base[7].tolist()), (7, base[8].tolist()), (7, base[7].tolist())]
    # distances that only rounding puts level
    rows += [(400 + i, (base[3] + [1e-8 * (9 - i), 0, 0, 0, 0]).tolist()) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    queries = [r for r in rows if r[0] % 10 == 3]
    got = spatial.nearest_vectors(df.where("id % 10 = 3"), df, 8, block=7).collect()
    assert len(got) == 8 * len(queries) and {tuple(r) for r in got} == brute(queries, rows, 8)


def test_nearest_vectors_of_odd_vectors_are_compared_too(spark):
    rows = [(i, [float(i), 0.0]) for i in range(20)] + [(30, [1e200, 0.0]), (31, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query, r.id) for r in spatial.nearest_vectors(df.where("id in (0, 30)"), df, 30).collect()}
    assert {(0, 30), (0, 31), (30, 0), (30, 31)} <= got and len(got) == 2 * 21


def test_many_pairs_of_vectors_take_little_time(spark):
    # 8 million pairs; by expressions one took 17 microseconds
    rows = spark.range(4000).select("id", F.array(*(F.rand(i) for i in range(64))).alias("v"))
    start = time.perf_counter()
    assert spatial.nearest_vectors(rows.where("id % 2 = 0"), rows, 8).count() == 16_000
    assert time.perf_counter() - start < 60
