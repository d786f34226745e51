"""Photo positions against a dense solve, and on flights whose true placing is known."""

from __future__ import annotations

import numpy as np
import pytest

from tilth.operators import positions as P
from tilth.sources.shared import materialize

PHOTOS = "flight int, photo long, zx double, zy double, east double, north double"
TIES = "flight int, i long, j long, px double, py double, qx double, qy double"


def flight(seed, n, wide, noise, gps, spacing=30.0):
    """True z and t of photos on a grid, ties of neighbours and GPS places."""
    rng = np.random.default_rng(seed)
    t = np.array([spacing * complex(k % wide, k // wide) for k in range(n)])
    z = 1.1 * np.exp(1j * (0.3 + 0.05 * rng.normal(size=n)))
    ties = []
    for i in range(n):
        for j in (i + 1, i + wide, i + wide + 1, i + wide - 1, i + 2 * wide):
            if j < n and abs(i % wide - j % wide) <= 1:
                for _ in range(4):
                    g = (t[i] + t[j]) / 2 + spacing * complex(*(rng.random(2) - 0.5))
                    ties.append((i, j, (g - t[i]) / z[i] + noise * complex(*rng.normal(size=2)), (g - t[j]) / z[j] + noise * complex(*rng.normal(size=2))))
    return z, t, ties, t + gps * (rng.normal(size=n) + 1j * rng.normal(size=n))


def tables(spark, flights):
    photos = [(k, i, 1.0, 0.0, float(g.real) + 5e5, float(g.imag) + 2.9e6) for k, (_, _, _, gps) in enumerate(flights) for i, g in enumerate(gps)]
    ties = [(k, i, j, *map(float, (p.real, p.imag, q.real, q.imag))) for k, (_, _, ts, _) in enumerate(flights) for i, j, p, q in ts]
    return spark.createDataFrame(photos, PHOTOS), spark.createDataFrame(ties, TIES)


def test_equals_a_dense_solve(spark):
    z, t, ties, gps = flight(1, 6, 3, 0.05, 0.5)
    rows, rhs, held = [], [], 2
    start = {held: (1.0 + 0j, complex(gps[held]))}
    for i, j, p, q in ties:
        row, known = np.zeros(12, complex), 0j
        for k, a, b in ((i, p, 1), (j, -q, -1)):
            if k in start:
                known += a * start[k][0] + b * start[k][1]
            else:
                row[2 * k : 2 * k + 2] = a, b
        rows.append(row)
        rhs.append(-known)
    free = [c for c in range(12) if c // 2 != held]
    best = np.linalg.lstsq(np.array(rows)[:, free], np.array(rhs), rcond=None)[0]
    want = dict(zip(free, best))
    photos = spark.createDataFrame([(0, i, 1.0, 0.0, float(g.real), float(g.imag), i == held) for i, g in enumerate(gps)], "flight int, photo long, zx double, zy double, tx double, ty double, held boolean")
    _, tie_rows = tables(spark, [(z, t, ties, gps)])
    got = {r.photo: r for r in P.least_squares(photos, tie_rows).collect()}
    for k in range(6):
        if k != held:
            assert complex(got[k].zx, got[k].zy) == pytest.approx(want[2 * k], abs=1e-6) and complex(got[k].tx, got[k].ty) == pytest.approx(want[2 * k + 1], abs=1e-5)
    assert (got[held].tx, got[held].ty) == (gps[held].real, gps[held].imag)


def test_places_photos_and_leaves_out_false_ties(spark):
    """Noisy ties place photos within centimetres of each other, though GPS is metres off; a false pair goes; a lone photo keeps its place."""
    z, t, ties, gps = flight(3, 9, 3, 0.01, 0.3, spacing=60.0)
    shared = [(t[0] + t[5]) / 2 + complex(10 * k, -7 * k * (k - 2)) for k in range(4)]
    false = [(0, 5, (g - t[0]) / z[0], (g + 9 - t[5]) / z[5]) for g in shared]  # one of them moved by 9 m
    lone = (np.array([1.0 + 0j]), np.array([0j]), [], np.array([12.0 + 7j]))
    photos, tie_rows = tables(spark, [(z, t, ties + false, gps), lone])
    got = {(r.flight, r.photo): r for r in P.place(photos, tie_rows, tolerance=1e-8).collect()}
    at = np.array([complex(got[0, k].tx - 5e5, got[0, k].ty - 2.9e6) for k in range(9)])
    turn = np.array([complex(got[0, k].zx, got[0, k].zy) for k in range(9)])
    # up to the turn and size that GPS settles only so well, places are the true ones
    design = np.column_stack([t, np.ones(9)])
    (s, c), *_ = np.linalg.lstsq(design, at, rcond=None)
    assert abs(s - 1) < 0.02 and np.abs(s * t + c - at).max() < 0.1 and np.abs(turn / s - z).max() < 0.01
    assert {got[0, k].group for k in range(9)} == {0} and {got[0, k].basis for k in range(9)} == {"turn"}
    assert (got[1, 0].tx - 5e5, got[1, 0].ty - 2.9e6, got[1, 0].basis) == (pytest.approx(12), pytest.approx(7), "shift")


def test_photos_are_merged(spark):
    """photos and pairs, whose files are small, are merged rather than sent through the driver."""
    photos, ties = tables(spark, [flight(3, 6, 3, 0.05, 0.5)[:4]])
    sums = materialize(P.pair_sums(ties))
    vector = materialize(photos.selectExpr("flight", "photo", "zx", "zy", "east as tx", "north as ty"))
    assert "Broadcast" not in P._product(sums, vector)._jdf.queryExecution().executedPlan().toString()
