"""Row phase fields and segments on synthetic fields whose rows are known."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tilth.operators import rows as R

CELL, SPACING = 0.1, 0.76


def field_of(shape, direction, moved, seed=0, noise=0.05):
    """Heights of rows a SPACING apart at `direction`, moved sideways by moved(across, along)."""
    rng = np.random.default_rng(seed)
    row, col = np.mgrid[0 : shape[0], 0 : shape[1]]
    x, y, t = (col + 0.5) * CELL, (row + 0.5) * CELL, math.radians(direction)
    across, along = y * math.cos(t) - x * math.sin(t), x * math.cos(t) + y * math.sin(t)
    h = 0.6 + 0.5 * np.cos(2 * np.pi * (across - moved(across, along)) / SPACING) + noise * rng.normal(size=shape)
    return h, across, along


def frames(spark, fields, directions, phase=0.0):
    parts = []
    for k, h in enumerate(fields):
        r, c = np.nonzero(~np.isnan(h))
        parts.append(pd.DataFrame({"raster": k, "row": r, "col": c, "v": h[r, c]}))
    pixels = spark.createDataFrame(pd.concat(parts)).selectExpr("int(raster) raster", "row", "col", "v")
    geometry = spark.createDataFrame([(k, SPACING, float(d), phase) for k, d in enumerate(directions)], "raster int, spacing_m double, direction_deg double, phase_m double")
    return pixels, geometry


@pytest.fixture(scope="module")
def fields(spark):
    """Straight rows; rows that drift along a plane, at 30 degrees and with a hole; a pass that does not meet; flat ground."""
    straight, *_ = field_of((150, 200), 0, lambda a, b: 0 * a)
    drifting, *_ = field_of((220, 220), 30, lambda a, b: 0.02 * b + 0.005 * a, 1)
    drifting[60:75, 80:100] = np.nan
    passes, *_ = field_of((260, 200), 0, lambda a, b: np.where(a > 12.9, 0.3, 0.0), 2)
    flat = np.full((120, 120), 0.6)
    pixels, geometry = frames(spark, [straight, drifting, passes, flat], [0, 30, 0, 0])
    found = R.phase_field(pixels, geometry, CELL, tile_rows=4).cache()
    return pixels, geometry, found


def test_straight_rows_keep_their_comb_and_flat_ground_has_none(fields):
    found = fields[2].collect()
    assert {(r.tracked, r.offset_m) for r in found if r.raster == 0} == {(False, 0.0)}
    assert not [r for r in found if r.raster == 3]
    assert all(r.tracked for r in found if r.raster in (1, 2))


def wrap(x):
    return (x + SPACING / 2) % SPACING - SPACING / 2


def test_field_follows_drift_and_pass_boundaries(fields):
    t = math.radians(30)
    across0 = min((r + 0.5) * CELL * math.cos(t) - (c + 0.5) * CELL * math.sin(t) for r in (0, 219) for c in (0, 219))
    along0 = 0.5 * CELL * (math.cos(t) + math.sin(t))
    wide = round(4 * SPACING / CELL) * CELL
    errors = []
    for r in fields[2].where("raster = 1").collect():
        a, b = across0 + (r.tile + 0.5) * wide, along0 + (r.strip + 0.5) * R.TILE_ALONG_M
        errors.append(abs(wrap(r.offset_m - 0.02 * b - 0.005 * a)))
    assert np.median(errors) < 0.02 and max(errors) < 0.08
    passes = {r.tile: r.offset_m for r in fields[2].where("raster = 2 and strip = 1").collect()}
    assert all(abs(wrap(passes[t] - (0.3 if (t + 0.5) * wide > 12.9 else 0.0))) < 0.08 for t in passes if abs((t + 0.5) * wide - 12.9) > wide / 2)


def test_tiles_equal_whole_strips(spark, fields):
    """Phases from tiles with halos are those of a running median over whole strips."""
    pixels, geometry, _ = fields
    got = {(r.strip, r.tile): r for r in R.tile_phases(pixels.where("raster = 2"), geometry, CELL, tile_rows=4).collect()}
    heights = pixels.where("raster = 2").toPandas().pivot(index="row", columns="col", values="v").to_numpy()
    half, width = round(R.STEP_ROWS * SPACING / CELL) // 2, round(4 * SPACING / CELL)
    place = np.arange(heights.shape[0])
    for strip in range(4):
        mean = heights[:, strip * 50 : strip * 50 + 50].mean(1)
        wide = np.pad(mean, half, mode="edge")
        d = mean - np.array([np.median(wide[i : i + 2 * half + 1]) for i in place])
        z = d * np.exp(2j * np.pi * (0.05 + (place + 0.5) * CELL) / SPACING)
        for tile in range(math.ceil(len(place) / width)):
            own = slice(tile * width, (tile + 1) * width)
            assert got[strip, tile].phase == pytest.approx(float(np.angle(z[own].sum())), abs=1e-6)
            assert got[strip, tile].weight == pytest.approx(50 * len(place[own]) * abs(z[own].sum()) / np.abs(d[own]).sum(), rel=1e-6) or got[strip, tile].weight == 0


def test_repeat_spacing(spark, fields):
    pixels, geometry, _ = fields
    got = {r.raster: r for r in R.repeat_spacing(pixels, geometry, CELL).collect()}
    assert set(got) == {0, 1, 2} and all(abs(r.spacing_m - SPACING) < 0.02 and r.correlation > 0.5 for k, r in got.items() if k < 2)


def test_segments_lie_on_rows(spark, fields):
    pixels, geometry, found = fields
    rows = R.segments(pixels, geometry, found, CELL, tile_rows=4).toPandas()
    assert set(rows.raster) == {0, 1, 2}
    straight = rows[rows.raster == 0]
    inside = straight[(straight.centre_m > SPACING / 2) & (straight.centre_m < 15 - SPACING / 2)]
    assert np.allclose(inside.area_m2, 2.0 * SPACING) and np.allclose(wrap(straight.centre_m), 0, atol=1e-9)
    assert sorted(straight.segment_index.unique()) == list(range(10)) and np.allclose(straight.start_m, 2.0 * straight.segment_index)
    assert straight.area_m2.sum() == pytest.approx(15 * 20, rel=0.02)  # all of the raster is covered
    passes = rows[rows.raster == 2]
    for low, high, moved in ((0.5, 9.0, 0.0), (17.0, 25.5, 0.3)):
        part = passes[(passes.centre_m > low) & (passes.centre_m < high)]
        assert len(part) > 50 and np.abs(wrap(part.centre_m - moved)).max() < 0.08
    drift = rows[rows.raster == 1]
    errors = [wrap(r.centre_m - 0.02 * (r.start_m + 1) - 0.005 * r.centre_m) for r in drift.itertuples()]
    assert np.abs(errors).max() < 0.1 and (drift.area_m2 <= 2.0 * SPACING + 1e-9).all() and drift.area_m2.min() >= 0.4 * SPACING
    shape = drift.iloc[0]["shape"]
    assert all(-1e-9 <= p["x"] <= 22 + 1e-9 and -1e-9 <= p["y"] <= 22 + 1e-9 for p in shape)


def test_clipped_areas(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)],)], "p array<struct<x:double,y:double>>")
    half = lambda a, b, c: F.array(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")))
    cut = R.clipped(F.col("p"), half(1.0, 1.0, 3.0))
    got = rows.select(R.area(F.col("p")).alias("whole"), R.area(cut).alias("cut"), R.area(R.clipped(F.col("p"), half(1.0, 0.0, -1.0))).alias("none")).first()
    assert (got.whole, got.cut, got.none) == (8.0, 4.0, 0.0)
