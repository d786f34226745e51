"""Gaussian levels and the ground around pixels against whole rasters in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tilth.operators import raster, scales


def frame(spark, v, name=0):
    r, c = np.mgrid[0 : v.shape[0], 0 : v.shape[1]]
    rows = [(name, int(a), int(b), None if np.isnan(x) else float(x)) for a, b, x in zip(r.ravel(), c.ravel(), v.ravel(), strict=True)]
    return spark.createDataFrame(rows, "raster long, row long, col long, v double")


def holed(shape, seed, share=0.2):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=shape)
    v[rng.random(shape) < share] = np.nan
    return v


def test_levels_do_not_depend_on_blocks(spark):
    pixels = frame(spark, holed((23, 31), 1))
    want = {(r.row, r.col): r.f for r in raster.focal(pixels, raster.gaussian(1.0)).collect()}
    for block in (6, 11, 256):
        got = scales.levels(pixels, [1.0, 1.5], block).collect()
        assert len(got) == 23 * 31
        assert all((want[r.row, r.col] is None and r.levels == [None, None]) or r.levels[0] == pytest.approx(want[r.row, r.col]) for r in got)
    assert scales.levels(pixels.where("false"), [1.0]).count() == 0


def plain_ground(v, block, percentile):
    high, wide = v.shape
    padded = np.pad(v, ((0, -high % block), (0, -wide % block)), mode="edge")
    n, m = padded.shape[0] // block, padded.shape[1] // block
    g = np.full((n, m), np.nan)
    for i, j in np.ndindex(n, m):
        part = padded[i * block : (i + 1) * block, j * block : (j + 1) * block]
        if (~np.isnan(part)).any():
            g[i, j] = np.nanpercentile(part, percentile)
    known = np.argwhere(~np.isnan(g))
    full = g.copy()
    for i, j in np.argwhere(np.isnan(g)):
        near = min(known, key=lambda k: ((k[0] - i) ** 2 + (k[1] - j) ** 2, *k))
        full[i, j] = g[tuple(near)]
    out = np.empty(v.shape)
    for r, c in np.ndindex(*v.shape):
        p, q = np.clip((r + 0.5) / block - 0.5, 0, n - 1), np.clip((c + 0.5) / block - 0.5, 0, m - 1)
        i, j = int(p), int(q)
        i2, j2, s, t = min(i + 1, n - 1), min(j + 1, m - 1), p - i, q - j
        out[r, c] = (1 - s) * ((1 - t) * full[i, j] + t * full[i, j2]) + s * ((1 - t) * full[i2, j] + t * full[i2, j2])
    return out


@pytest.mark.parametrize(("shape", "block"), [((17, 22), 4), ((12, 9), 3), ((5, 6), 1), ((7, 40), 3)])
def test_ground_around(spark, shape, block):
    v = holed(shape, block)
    v[: shape[0] // 2, : (3 * shape[1]) // 4] = np.nan  # whole blocks, some far from any other
    got = {(r.row, r.col): r.ground for r in scales.ground_around(frame(spark, v), block).collect()}
    want = plain_ground(v, block, 75.0)
    assert len(got) == v.size and all(got[p] == pytest.approx(want[p]) for p in np.ndindex(*shape))


def test_leaves_and_rasters_without_pixels(spark):
    v = np.full((12, 12), 30.0)
    v[4:6, 4:6], v[0, 0] = 25.0, np.nan
    both = frame(spark, v).union(frame(spark, np.full((4, 4), np.nan), 1))
    got = scales.leaves(both, 0.5, 3.0).toPandas()
    assert {(r.row, r.col) for r in got.itertuples() if r.leaf is True or r.leaf == 1} == {(4, 4), (4, 5), (5, 4), (5, 5)}
    assert got[got.raster == 1].ground.isna().all() and len(got) == 160
    assert pd.isna(got[(got.raster == 0) & (got.row == 0) & (got.col == 0)].leaf).all()
    with pytest.raises(ValueError, match="size"):
        scales.leaves(both, 0.0, 3.0)
