"""The watershed against a flood in one queue, and tops, smoothing and crowns against plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tilth.operators import watershed as W

FAR = 1 << 31


def frame(spark, rasters):
    rows = [(k, r, c, float(v)) for k, h in enumerate(rasters) for (r, c), v in np.ndenumerate(h) if not math.isnan(v)]
    return spark.createDataFrame(rows, "raster int, row long, col long, v double")


def flood(h, markers, least):
    """Pixels from the highest down; each goes to its highest neighbour, and groups that meet at it join unless both are marked."""
    cell = lambda p: p[0] * FAR + p[1]
    order = sorted((p for p in np.ndindex(*h.shape) if h[p] >= least), key=lambda p: (-h[p], cell(p)))
    place, group = {p: i for i, p in enumerate(order)}, {}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    label = {}
    for p in order:
        around = [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b)]
        done = sorted((q for q in around if q in group), key=place.get)
        group[p] = root(done[0]) if done else p
        label.setdefault(group[p], cell(p) if p in markers else None)
        for q in done:
            a, b = root(p), root(q)
            if a != b and not (label[a] is not None and label[b] is not None):
                group[b] = a
                label[a] = label[a] if label[a] is not None else label[b]
    return {p: label[root(p)] for p in order}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_watershed_equals_a_flood(spark, seed):
    rng = np.random.default_rng(seed)
    coarse = [rng.integers(0, 6, (14, 17)).astype(float), rng.random((11, 9)), np.kron(rng.random((4, 5)), np.ones((4, 3)))]
    expected, markers = {}, []
    for k, h in enumerate(coarse):
        # markers are some of the pixels that no neighbour precedes
        first = lambda p: all((-h[p], p[0] * FAR + p[1]) <= (-h[q], q[0] * FAR + q[1]) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= (q := (p[0] + a, p[1] + b))[0] < h.shape[0] and 0 <= q[1] < h.shape[1])  # noqa: B023, E731
        marked = [p for p in np.ndindex(*h.shape) if first(p) and rng.random() < 0.4 and h[p] >= 0.2]
        markers += [(k, p[0] * FAR + p[1]) for p in marked]
        expected |= {(k, *p): lab for p, lab in flood(h, set(marked), 0.2).items()}
    got = W.watershed(frame(spark, coarse), spark.createDataFrame(markers, "raster int, cell long"), 0.2).collect()
    assert {(r.raster, r.row, r.col): r.label for r in got} == expected
    assert len(set(expected.values())) > 3


def test_tops_and_smoothing(spark):
    rng = np.random.default_rng(7)
    h = np.round(rng.random((20, 15)), 1)
    h[3, 4] = np.nan
    got = {(r.cell // FAR, r.cell % FAR) for r in W.tops(frame(spark, [h]), 2).collect()}
    key = lambda p: (-h[p], p)
    near = lambda p: [q for q in np.ndindex(*h.shape) if abs(q[0] - p[0]) <= 2 and abs(q[1] - p[1]) <= 2 and not math.isnan(h[q])]
    assert got == {p for p in np.ndindex(*h.shape) if not math.isnan(h[p]) and min(near(p), key=key) == p}
    bell = np.exp(-np.arange(-4, 5) ** 2 / 2.0)
    known = ~np.isnan(h)
    pad = lambda x: np.pad(x, 4)
    blur = lambda x: sum(bell[i] * bell[j] * pad(x)[i : i + 20, j : j + 15] for i in range(9) for j in range(9))
    want = blur(np.where(known, h, 0)) / blur(known.astype(float))
    got = {(r.row, r.col): r.v for r in W.smooth(frame(spark, [h]), 1.0).collect()}
    assert all(got[p] == pytest.approx(want[p]) for p in np.ndindex(*h.shape) if known[p]) and (3, 4) not in got


def test_crowns_of_domes_and_gaps(spark):
    """A lattice of domes with some missing: one crown a dome, none in a gap, and its size near the dome's."""
    step, size, missing = 20, 6, {(1, 1), (2, 3)}
    y, x = np.mgrid[0:80, 0:100].astype(float)
    h = np.zeros((80, 100))
    for i in range(4):
        for j in range(5):
            if (i, j) not in missing:
                d = np.hypot(y - (10 + step * i), x - (10 + step * j))
                h = np.maximum(h, 3 * np.sqrt(np.clip(1 - (d / size) ** 2, 0, None)))
    got = W.tree_crowns(frame(spark, [h]), 0.1, apart_m=0.8).collect()
    centres = {(round((r.mid_row - 10) / step), round((r.mid_col - 10) / step)) for r in got}
    assert len(got) == 18 and not centres & missing
    assert all(math.pi * 0.6**2 <= r.area_m2 < math.pi * 0.75**2 and r.top_row == round(r.mid_row) for r in got)


@pytest.mark.parametrize("tile", [5, 8])
def test_tiles_change_nothing(spark, tile):
    """small tiles, whose edges cut crowns and passes, give what one tile for all gives."""
    rng = np.random.default_rng(5)
    fields = [np.round(rng.random((23, 31)) + np.linspace(0, 2, 31), 1), rng.random((9, 40))]
    pixels = frame(spark, fields)
    both = lambda made: [sorted(map(tuple, made(t).collect())) for t in (tile, 64)]
    small, whole = both(lambda t: W.smooth(pixels, 1.0, t))
    assert [r[:3] for r in small] == [r[:3] for r in whole] and [r[3] for r in small] == pytest.approx([r[3] for r in whole], abs=1e-12)
    small, whole = both(lambda t: W.tops(pixels, 2, t))
    assert small == whole and len(whole) > 20
    markers = W.tops(pixels, 3, 64)
    small, whole = both(lambda t: W.watershed(pixels, markers, 0.3, t))
    assert small == whole and len({r[4] for r in whole}) > 10


def test_windows_are_sent_once(spark):
    """a window of two axes takes one exchange of pixels, not one of a row for each place of each axis."""
    pixels = spark.range(400).selectExpr("0 as raster", "id div 20 as row", "id % 20 as col", "double(id) as v")
    for made in (W.smooth(pixels, 1.5), W.tops(pixels, 4)):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
