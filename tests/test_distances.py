"""Distances, opened shapes, rectangles, traced fields and camera patterns against plain loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tilth.operators import camera, distances


def frame(spark, rasters):
    parts = []
    for k, v in enumerate(rasters):
        r, c = np.nonzero(np.ones(v.shape))
        parts.append(pd.DataFrame({"raster": k, "row": r, "col": c, "v": v[r, c].astype(int)}))
    return spark.createDataFrame(pd.concat(parts))


def plain(hit):
    at = np.argwhere(hit)
    r, c = np.mgrid[0 : hit.shape[0], 0 : hit.shape[1]]
    return np.min([(r - a) ** 2 + (c - b) ** 2 for a, b in at], axis=0) if len(at) else np.full(hit.shape, np.nan)


def test_distance_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    rasters = [rng.random((13, 21)) < 0.03, rng.random((30, 7)) < 0.3, np.zeros((4, 5), bool)]
    got = {(r.raster, r.row, r.col): r.d2 for r in distances.distance(frame(spark, rasters), F.col("v") == 1).collect()}
    for k, hit in enumerate(rasters):
        want = plain(hit)
        assert all(got[k, *p] == want[p] or (got[k, *p] is None and np.isnan(want[p])) for p in np.ndindex(*hit.shape))


def test_opening_parts_a_neck(spark):
    shape = np.zeros((30, 50), bool)
    shape[4:26, 4:22] = shape[4:26, 28:46] = shape[13:16, 20:30] = True
    got = {(r.row, r.col) for r in distances.opened(frame(spark, [shape]), F.col("v") == 1, 1.0, 3.0).collect()}
    core = plain(~shape) > 16
    assert got == {p for p in np.ndindex(*shape.shape) if plain(core)[p] <= 9}
    assert not any(22 < c < 27 for _, c in got) and {c < 25 for _, c in got} == {True, False}


def test_opening_where_cells_are_missing(spark):
    """Tiles and their halos against all pairs, in rasters that lack cells: a missing cell is neither in the set nor outside it."""
    rng = np.random.default_rng(7)
    there = rng.random((37, 300)) < 0.8
    inside = there & (rng.random((37, 300)) < 0.99)
    r, c = np.nonzero(there)
    rows = pd.DataFrame({"raster": "a", "row": r - 9, "col": c, "v": inside[r, c].astype(int), "name": r * 1000 + c})
    got = distances.opened(spark.createDataFrame(rows), F.col("v") == 1, 1.5, 2.0).collect()
    core = there & (plain(there & ~inside) > 3.5**2)
    want = {(int(a) - 9, int(b)) for a, b in np.argwhere(there & (plain(core) <= 2.0**2))}
    assert {(x.row, x.col) for x in got} == want and len(got) == len(want) > 100
    named = distances.opened(spark.createDataFrame(rows), F.col("v") == 1, 1.5, 2.0, ("name",)).collect()
    assert {(x.row, x.col) for x in named} == want and all(x.name == (x.row + 9) * 1000 + x.col for x in named)
    none = distances.opened(spark.createDataFrame(rows), F.col("v") < 5, 1.5, 2.0)
    assert none.count() == len(rows)  # nothing is outside


def test_least_rectangle():
    rng = np.random.default_rng(4)
    for _ in range(20):
        p = rng.integers(0, 9, (int(rng.integers(3, 30)), 2)).astype(float)
        p = np.concatenate([p, p + [0, 1], p + [1, 0], p + [1, 1]])
        turned = np.radians(np.arange(0, 180, 0.05))
        areas = np.ptp(p @ np.array([np.cos(turned), np.sin(turned)]), axis=0) * np.ptp(p @ np.array([-np.sin(turned), np.cos(turned)]), axis=0)
        assert distances.least_rectangle(p) <= areas.min() + 1e-9 and distances.least_rectangle(p) == pytest.approx(areas.min(), rel=0.01)


def test_traced_fields(spark):
    """A square field, two parted by a neck (the larger is taken), one too small, and one of another crop."""
    classes = np.full((60, 120), 9)
    classes[5:35, 5:35] = classes[5:45, 45:65] = classes[5:30, 72:90] = 1
    classes[20:22, 64:73] = 1
    classes[50:55, 5:12] = 1
    classes[50:58, 60:110] = 3
    got = distances.traced_fields(frame(spark, [classes]), [1], 30.0).orderBy("col").collect()
    assert len(got) == 2 and all(r.purity == 1.0 and r.boxiness > 0.85 for r in got)
    assert [(round(r.row), round(r.col)) for r in got] == [(20, 20), (24, 54)]
    assert got[0].acres == pytest.approx(27 * 27 * 900 / 4046.856, rel=0.1)


def test_camera_pattern_comes_off(spark):
    """Warm spots that stay on the ground move through the picture and stay; the camera's bands go."""
    rng = np.random.default_rng(5)
    down, across = np.linspace(-1, 1, 6) ** 2, 0.3 * np.arange(7)
    rows = []
    for k in range(30):
        v = 20 + 0.1 * k + down[:, None] + across[None, :] + 0.02 * rng.normal(size=(6, 7))
        v[k % 6, k % 7] += 5
        rows += [(k, 2.0 * k, r, c, float(v[r, c])) for r in range(6) for c in range(7)]
    rows += [(99, 9000.0, r, 0, 1.0) for r in range(6)]  # too few frames in its slice
    pixels = spark.createDataFrame(rows, "frame int, seconds double, row long, col long, v double")
    got = camera.camera_pattern(pixels).toPandas()
    assert (got[got.frame == 99].v == 1.0).all()
    left = got[got.frame != 99].merge(pixels.toPandas(), on=["frame", "row", "col"], suffixes=("", "_was"))
    for k, part in left.groupby("frame"):
        spot = (part.row == k % 6) & (part.col == k % 7)
        assert part.v[~spot].std() < 0.1 and float(part.v[spot].iloc[0]) - part.v[~spot].mean() > 4.8
    leafy = pixels.where("frame != 99").withColumn("leaf", F.col("v") < 24.5)
    field = camera.flat_field(leafy, smooth_px=1, least_leaf=5)
    flat = camera.flattened(leafy, field).toPandas()
    assert flat.groupby("frame").v.quantile([0.1, 0.9]).unstack().diff(axis=1)[0.9].max() < 0.5
