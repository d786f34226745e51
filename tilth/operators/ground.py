"""Relief of a field: curvature, flow, spots, and what lies on them; sharpness and discs of rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.raster import PIXEL, components

#: Fall in percent below which ground is level; relief in cm, area in m2 and share of the field that make a spot (fixed values).
LEVEL_PCT, SPOT_CM, SPOT_M2, SPOT_SHARE = 0.05, 4.0, 25.0, 0.005
#: Unit vectors of the sides that water can enter by (fixed values).
SIDES = {"N": (0.0, 1.0), "S": (0.0, -1.0), "E": (1.0, 0.0), "W": (-1.0, 0.0)}
#: Share of a patch that a spot must hold, and units under a patch from which it is judged (fixed values).
ON_SPOT, LEAST_UNITS = 0.3, 4
#: Sharpness below which a frame is always left out, and the share of frames left out at least (fixed values).
BLUR_FLOOR, BLUR_QUANTILE = 20.0, 0.15


def place_word(u: Column, v: Column) -> Column:
    """'north-east corner', 'south side' or 'middle', from shares of the way east and north."""
    ns = F.when(v > 2 / 3, "north").when(v < 1 / 3, "south")
    ew = F.when(u > 2 / 3, "east").when(u < 1 / 3, "west")
    both = ns.isNotNull() & ew.isNotNull()
    return F.when(both, F.concat(ns, F.lit("-"), ew, F.lit(" corner"))).when(ns.isNotNull() | ew.isNotNull(), F.concat(F.coalesce(ns, ew), F.lit(" side"))).otherwise("middle")


def flow_direction(axis_x: Column, axis_y: Column, grad_x: Column, grad_y: Column, side: Column, level_pct: float = LEVEL_PCT) -> Column:
    """Which way water runs: struct of x, y (unit vector), basis (given or slope) and contradiction.

    Along the rows, away from the side it enters by; downhill where no side is given or the rows run across
    it. Without rows straight from the side, or downhill. NULL where the ground is level.
    """
    of = lambda i: F.coalesce(*(F.when(side == k, v[i]) for k, v in SIDES.items()))
    sx, sy = of(0), of(1)
    steep = F.sqrt(grad_x * grad_x + grad_y * grad_y)
    fall = F.nullif(steep, F.lit(0.0))
    arrow = lambda x, y, basis, odd=False: F.struct(x.alias("x"), y.alias("y"), F.lit(basis).alias("basis"), F.lit(odd).alias("contradiction"))
    facing, down = axis_x * sx + axis_y * sy, axis_x * grad_x + axis_y * grad_y
    turn = lambda d: F.when(d, 1.0).otherwise(-1.0)
    no_rows = F.when(sx.isNotNull(), arrow(-sx, -sy, "given")).when(steep * 100 >= level_pct, arrow(-grad_x / fall, -grad_y / fall, "slope"))
    along = F.abs(facing) >= 0.5
    sign = turn(down <= 0)
    odd = sx.isNotNull() & ~along
    slope = F.when(F.abs(down) * 100 >= level_pct / 2, F.when(odd, arrow(axis_x * sign, axis_y * sign, "slope", True)).otherwise(arrow(axis_x * sign, axis_y * sign, "slope")))
    given = turn(facing < 0)
    return F.when(axis_x.isNull(), no_rows).when(F.coalesce(along, F.lit(False)), arrow(axis_x * given, axis_y * given, "given")).otherwise(slope)


def position_along(points: DataFrame, corners: DataFrame, keys: list[str], flow_x: Column, flow_y: Column) -> DataFrame:
    """points (x, y) with `along`: 0 at the head of the field (its corners) and 1 at the tail, along the flow."""
    s = F.col("x") * flow_x + F.col("y") * flow_y
    ends = corners.groupBy(*keys).agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    share = (s - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return points.join(ends, keys).withColumn("along", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))).drop("_lo", "_hi")


def curvature(cells: DataFrame, keys: list[str], plane: DataFrame) -> DataFrame:
    """kind (dome or bowl) and the coefficients q0 to q5 of the quadratic surface of each key, and how it departs from its plane.

    The normal equations' sums are one aggregate over the cells (x, y, z about the key's origin); the
    6 x 6 solve is a small helper on one row for each key. depth_cm is the spread (2 to 98 %) of the
    quadratic over the plane (a, b, c).
    """
    x, y, z = (F.col(c) for c in "xyz")
    terms = [F.lit(1.0), x, y, x * x, x * y, y * y]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    sums = cells.groupBy(*keys).agg(F.array(*(F.sum(terms[i] * terms[j]) for i, j in pairs)).alias("m"), F.array(*(F.sum(t * z) for t in terms)).alias("r"))

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, r: pd.Series) -> pd.Series:
        out = []
        for mm, rr in zip(m, r, strict=True):
            full = np.zeros((6, 6))
            for (i, j), v in zip(pairs, mm, strict=True):
                full[i, j] = full[j, i] = v
            out.append(np.linalg.lstsq(full, np.asarray(rr, float), rcond=None)[0])
        return pd.Series(out)

    fit = sums.select(*keys, solve("m", "r").alias("q"))
    q = lambda i: F.get("q", F.lit(i))
    extra = sum((q(i) * t for i, t in enumerate(terms)), F.lit(0.0)) - (F.col("a") + F.col("b") * x + F.col("c") * y)
    spread = cells.join(fit, keys).join(plane, keys).groupBy(*keys).agg(F.percentile_approx(extra * 100, [0.02, 0.98], 10_000).alias("e"), F.first("q").alias("q"))
    return spread.select(*keys, (F.get("e", F.lit(1)) - F.get("e", F.lit(0))).alias("depth_cm"), F.when(q(3) + q(5) < 0, "dome").otherwise("bowl").alias("kind"))


def find_spots(relief: DataFrame, cell_m2: float, level: float = SPOT_CM, least_m2: float = SPOT_M2, least_share: float = SPOT_SHARE) -> DataFrame:
    """Connected high and low patches of smoothed relief v in cm (raster, row, col): area, mean, peak, middle and label H1, L1, ... by area."""
    high, low = (relief.where(w).withColumn("raster", F.concat(F.lit(k), F.col("raster").cast("string"))) for k, w in (("H", F.col("v") >= level), ("L", F.col("v") <= -level)))
    labelled = components(high.union(low).select(*PIXEL))
    cells = labelled.withColumn("kind", F.left("raster", F.lit(1))).withColumn("of", F.substring("raster", 2, 40))
    values = relief.select(F.col("raster").cast("string").alias("of"), "row", "col", "v")
    spots = cells.join(values, ["of", "row", "col"]).groupBy("of", "kind", "label").agg(
        (F.count("*") * cell_m2).alias("area_m2"), F.avg("v").alias("mean_cm"), F.max_by("v", F.abs("v")).alias("peak_cm"), F.avg("row").alias("row"), F.avg("col").alias("col")
    )
    fields = values.where("v is not null").groupBy("of").agg((F.count("*") * cell_m2 * least_share).alias("least"))
    kept = spots.join(fields, "of").where((F.col("area_m2") >= least_m2) & (F.col("area_m2") >= F.col("least"))).drop("least")
    number = F.row_number().over(Window.partitionBy("of", "kind").orderBy(F.col("area_m2").desc(), "label"))
    return kept.withColumn("spot", F.concat("kind", number.cast("string")))


def patches_on_spots(patches: DataFrame, spots: DataFrame) -> DataFrame:
    """patch and the kind of the first spot that holds ON_SPOT of it, from cells of patches (patch, row, col) and spots (spot, kind, row, col)."""
    sizes = patches.groupBy("patch").agg(F.count("*").alias("n"))
    shared = patches.join(spots, ["row", "col"]).groupBy("patch", "spot", "kind").agg(F.count("*").alias("m"))
    held = shared.join(sizes, "patch").where(F.col("m") >= ON_SPOT * F.col("n")).groupBy("patch").agg(F.min_by("kind", "spot").alias("ground"))
    return sizes.select("patch").join(held, "patch", "left")


def patches_on_units(patches: DataFrame, units: DataFrame) -> DataFrame:
    """patch, n_units judged under it and the share of them flagged (NULL for fewer than LEAST_UNITS), from cells of units (unit, flag, row, col)."""
    judged = units.where(~F.col("flag").isin("EDGE", "NO_DATA"))
    under = patches.join(judged, ["row", "col"]).select("patch", "unit", "flag").distinct()
    counts = under.groupBy("patch").agg(F.count("*").alias("n_units"), F.count_if(F.col("flag").isin("STRESSED", "DEAD", "MISSING")).alias("bad"))
    rows = patches.select("patch").distinct().join(counts, "patch", "left").select("patch", F.coalesce("n_units", F.lit(0)).alias("n_units"), "bad")
    return rows.select("patch", "n_units", F.when(F.col("n_units") >= LEAST_UNITS, F.round(F.col("bad") / F.col("n_units"), 3)).alias("problem_share"))


def covered_share(first: DataFrame, ground: DataFrame, keys: list[str], above_m: float = 1.0) -> DataFrame:
    """Share of the cells where the first return was more than above_m over the ground; cells without either do not count."""
    rows = first.join(ground.withColumnRenamed("v", "g"), [*keys, "row", "col"])
    return rows.where("v is not null and g is not null").groupBy(*keys).agg((F.count_if(F.col("v") - F.col("g") > above_m) / F.count("*")).alias("share"))


def sharpness(pixels: DataFrame) -> DataFrame:
    """Variance of the Laplacian of each frame (raster, row, col, v); the edge is mirrored."""
    sent = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0)))))
    near = pixels.select("raster", "row", "col", "v", sent.alias("o")).select("raster", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "o", "v")
    side = lambda a, b: F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col("v")))
    four = near.groupBy(*PIXEL).agg(side(0, 1).alias("w"), side(0, -1).alias("e"), side(1, 0).alias("n"), side(-1, 0).alias("s"))
    c = lambda a, b: F.coalesce(a, b)
    lap = c("w", "e") + c("e", "w") + c("n", "s") + c("s", "n") - 4 * F.col("v")
    return pixels.join(four, PIXEL).groupBy("raster").agg(F.var_pop(lap).alias("sharpness"))


def sharp_frames(scores: DataFrame, quantile: float = BLUR_QUANTILE, absolute: float | None = None) -> DataFrame:
    """Frames (raster, sharpness) at or above the flight's cut: the given one, or a quantile of its scores and BLUR_FLOOR at least."""
    if absolute is not None:
        return scores.withColumn("cut", F.lit(float(absolute))).where("sharpness >= cut")
    cut = scores.agg(F.greatest(F.percentile("sharpness", F.lit(quantile)), F.lit(BLUR_FLOOR)).alias("cut"))
    return scores.crossJoin(F.broadcast(cut)).where("sharpness >= cut")


def disc_statistics(trees: DataFrame, pixels: DataFrame, radius: int, canopy: float, cell_m2: float) -> DataFrame:
    """For each tree (tree, row, col) of its disc of pixels (row, col, h, green): largest, mean, 90 % and canopy height, volume and greenness.

    Trees are sent to the cells of their disc, so the join is on the cell. Canopy values are added in ascending order:
    the last digit does not hang on the order of pixels, and a disc is never large.
    """
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    spread = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in disc)))
    cells = trees.select("tree", spread.alias("o"), "row", "col").select("tree", (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"))
    up = F.col("h") > canopy
    total = lambda value: F.aggregate(F.array_sort(F.collect_list(F.when(up, F.col(value)))), F.lit(0.0), lambda s, v: s + v)
    got = cells.join(pixels, ["row", "col"]).groupBy("tree").agg(
        F.max("h").alias("largest"), F.percentile("h", F.lit(0.9)).alias("p90"), F.avg("h").alias("mean"), F.avg(up.cast("double")).alias("cover"), (total("h") * cell_m2).alias("volume"),
        F.coalesce(total("green") / F.nullif(F.count(F.when(up, F.col("green"))), F.lit(0)), F.lit(0.0)).alias("canopy_green"), F.avg("green").alias("green"),
    )
    return trees.select("tree").join(got, "tree", "left").na.fill(0.0)


def to_grid(x: Column, y: Column, angle_deg: Column, origin_x: Column, origin_y: Column) -> tuple[Column, Column]:
    """Coordinates in a grid turned by the angle about the origin."""
    t, dx, dy = F.radians(angle_deg), x - origin_x, y - origin_y
    return dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)


def planting_grid(neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """angle and both spacings of each key's planting, from vectors (dx, dy) to near neighbours, by counts over half degrees.

    The vectors up to 1.15 times the 60 % quantile of their lengths count; their angles fold into a
    quarter turn, whose fullest degree gives the angle.
    """
    rows = neighbours.withColumn("d", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).where("d > 0")
    near = rows.groupBy(*keys).agg((F.percentile("d", F.lit(0.6)) * 1.15).alias("most"))
    rows = rows.join(near, keys).where("d <= most").withColumn("turn", F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(90.0)))
    degrees = rows.groupBy(*keys, F.floor("turn").alias("degree")).agg(F.count("*").alias("n")).groupBy(*keys).agg((F.max_by("degree", F.struct("n", -F.col("degree"))) + 0.5).alias("peak"))
    off = F.pmod(F.col("turn") - F.col("peak") + 45, F.lit(90.0)) - 45
    angle = rows.join(degrees, keys).where(F.abs(off) < 5).groupBy(*keys).agg(F.percentile("turn", F.lit(0.5)).alias("angle"))
    t = F.radians("angle")
    a, b = F.abs(F.col("dx") * F.cos(t) + F.col("dy") * F.sin(t)), F.abs(F.col("dy") * F.cos(t) - F.col("dx") * F.sin(t))
    sides = rows.join(angle, keys).withColumns({"a": a, "b": b}).groupBy(*keys, "angle").agg(
        F.percentile(F.when(F.col("a") > F.col("b"), F.col("a")), F.lit(0.5)).alias("along"), F.percentile(F.when(F.col("b") > F.col("a"), F.col("b")), F.lit(0.5)).alias("across"), F.percentile("d", F.lit(0.5)).alias("usual")
    )
    first = F.coalesce("along", "usual")
    return sides.select(*keys, "angle", first.alias("spacing_a"), F.coalesce(F.col("across"), first).alias("spacing_b"))
