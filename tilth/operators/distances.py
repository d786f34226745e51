"""Exact distances on rasters, shapes opened by a radius, and fields traced from a map of classes.

The Euclidean distance of a cell to the nearest cell of a set is found in two passes: along each row the nearest one
before and after, by windows; then along each column the lower envelope of the parabolas that the rows' distances
make. A row and a column are one key each, and no cell is compared with more than it needs. Where only distances up
to a radius matter, tiles with halos are worked on by themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators import raster as R
from tilth.operators.quantiles import beside
from tilth.sources.shared import materialize

#: Square metres of an acre, and the everyday size of a field in acres (fixed values).
SQ_M_PER_ACRE, USUAL_ACRES = 4046.8564224, 50.0


def _envelope(place: np.ndarray, height: np.ndarray, at: np.ndarray) -> np.ndarray:
    """min over k of (at - place[k])**2 + height[k], by the parabolas that are lowest somewhere."""
    kept, ends = [0], [-np.inf]
    for k in range(1, len(place)):
        while True:
            j = kept[-1]
            meet = ((height[k] + place[k] ** 2) - (height[j] + place[j] ** 2)) / (2.0 * (place[k] - place[j]))
            if meet > ends[-1]:
                break
            kept.pop()
            ends.pop()
        kept.append(k)
        ends.append(meet)
    k = np.array(kept)[np.searchsorted(ends, at, side="right") - 1]
    return (at - place[k]) ** 2 + height[k]


def distance(cells: DataFrame, inside: Column) -> DataFrame:
    """raster, row, col and d2: squared distance (in cells) to the nearest cell of the raster where `inside` holds; NULL where there is none."""
    rows = cells.select(*R.PIXEL, F.coalesce(inside, F.lit(False)).alias("hit"))
    order = Window.partitionBy("raster", "row").orderBy("col")
    mark = F.when(F.col("hit"), F.col("col"))
    before = F.col("col") - F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)) - F.col("col")
    flat = rows.select(*R.PIXEL, F.least(before, after).cast("double").alias("g"))

    def column(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row")
        at, g = part["row"].to_numpy(np.float64), part["g"].to_numpy(np.float64)
        some = ~np.isnan(g)
        d2 = _envelope(at[some], g[some] ** 2, at) if some.any() else np.full(len(at), np.nan)
        return pd.DataFrame({"raster": part["raster"], "row": part["row"], "col": part["col"], "d2": d2})

    kind = cells.schema["raster"].dataType.simpleString()
    got = flat.groupBy("raster", "col").applyInPandas(column, f"raster {kind}, row long, col long, d2 double")
    return got.select(*R.PIXEL, F.nanvl("d2", F.lit(None).cast("double")).alias("d2"))


def _near(hit: np.ndarray, most: int) -> np.ndarray:
    """Whether a cell of the grid is within a squared distance of one that is hit: rows at each distance, widened by what is left."""
    reach = math.isqrt(most)
    high, wide = hit.shape
    count = np.zeros((high, wide + 1), dtype=np.int64)
    np.cumsum(hit, axis=1, out=count[:, 1:])
    out = np.zeros_like(hit)
    for d in range(min(reach, high - 1) + 1):
        w = math.isqrt(most - d * d)
        ends = np.arange(wide)
        some = count[:, np.minimum(ends + w + 1, wide)] > count[:, np.maximum(ends - w, 0)]
        out[: high - d] |= some[d:]
        out[d:] |= some[: high - d]
    return out


def opened(cells: DataFrame, inside: Column, shrink: float, radius: float, more: tuple[str, ...] = ()) -> DataFrame:
    """The cells of a set (with more of their columns) further than shrink + radius (in cells) from any cell outside it, and those within `radius` of these: necks narrower than that are parted.

    What lies beyond the raster is not outside the set; give a border where it is. Only near cells decide, so tiles with halos are
    opened by themselves. A cell that stands twice is inside if one of its rows is.
    """
    far, near = math.floor((shrink + radius) ** 2), math.floor(radius**2)
    rows = cells.select(*R.PIXEL, *more, F.coalesce(inside, F.lit(False)).alias("_in")).where("raster is not null and row is not null and col is not null")

    def made(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        known, member = np.zeros((width, width), dtype=bool), np.zeros((width, width), dtype=bool)
        known[r, c] = True
        within = frame["_in"].to_numpy(dtype=bool)
        member[r[within], c[within]] = True
        core = known & ~_near(known & ~member, far)
        return frame.loc[own & _near(core, near)[r, c], [*R.PIXEL, *more]]

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_in").schema)
    return R.in_tiles(rows, math.isqrt(far) + math.isqrt(near), made, kept)


def least_rectangle(points: np.ndarray) -> float:
    """Area of the smallest rectangle, however turned, around points: one side lies along an edge of their hull."""
    points = np.unique(points, axis=0)
    points = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(p: np.ndarray) -> list:
        out: list = []
        for q in p:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        return out

    hull = np.array(chain(points)[:-1] + chain(points[::-1])[:-1])
    edge = np.roll(hull, -1, axis=0) - hull
    along = edge / np.hypot(edge[:, 0], edge[:, 1])[:, None]
    u, v = hull @ along.T, hull @ np.column_stack([-along[:, 1], along[:, 0]]).T
    return float((np.ptp(u, axis=0) * np.ptp(v, axis=0)).min())


def traced_fields(classes: DataFrame, codes: list[int], cell_m: float, inset_m: float = 45.0, neck_m: float = 80.0, least_acres: float = 15.0, most_acres: float = 250.0, least_purity: float = 0.9) -> DataFrame:
    """Fields of a crop in a map (raster, row, col, v: the class): raster, block, label, acres, purity, boxiness, row, col (middle) and score.

    Connected blocks of the crop's classes are shrunk inside their edges and opened by a radius; the largest part
    of each block is its field. purity is the share of its cells that are of the crop, boxiness its share of the
    smallest turned rectangle around it, and score is better for both and for an everyday size.
    """
    acres = lambda n: n * cell_m**2 / SQ_M_PER_ACRE
    crop = F.col("v").isin(*codes)
    blocks = materialize(R.components(classes.where(crop)).withColumnRenamed("label", "block"))
    large = blocks.groupBy("raster", "block").agg(F.count("*").alias("n")).where(acres(F.col("n")) >= least_acres)
    member = beside(blocks, large.select("raster", "block"), ["raster", "block"]).select(*R.PIXEL, "block", F.lit(True).alias("member"))
    # cells of the map and of its blocks stand side by side and meet in their tiles, without a join
    cells = classes.select(*R.PIXEL, F.lit(0).cast("long").alias("block"), F.lit(False).alias("member")).union(member)
    inner = materialize(opened(cells, F.col("member"), inset_m / cell_m, neck_m / cell_m, ("block", "member")).where("member"))
    parts = materialize(R.components(inner, ("block",)))
    sizes = parts.groupBy("raster", "block", "label").agg(F.count("*").alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col"))
    first = sizes.groupBy("raster", "block").agg(F.max_by(F.struct("label", "n", "row", "col"), F.struct("n", -F.col("label"))).alias("x")).select("raster", "block", "x.*")
    fits = first.withColumn("acres", acres(F.col("n"))).where(F.col("acres").between(least_acres, most_acres))
    own = materialize(beside(parts, fits.select("raster", "label"), ["raster", "label"]).select(*R.PIXEL, "label"))
    # joins of cells with cells are merged: their files are small, and a broadcast would go through the driver
    pure = own.join(classes.select(*R.PIXEL, crop.alias("crop")).hint("merge"), R.PIXEL).groupBy("raster", "label").agg(F.avg(F.col("crop").cast("double")).alias("purity"))
    # a hull's corners are the ends of rows
    rims = own.groupBy("raster", "label", "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))

    def rectangle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fields in batches:
            ends = [np.array([list(x) for x in rim], dtype=np.float64) for rim in fields["rim"]]
            corners = [np.concatenate([rim[:, [0, c]] + [dr, c - 1.0] for c in (1, 2) for dr in (0.0, 1.0)]) for rim in ends]
            yield fields[["raster", "label"]].assign(around=[least_rectangle(x) for x in corners])

    kind = classes.schema["raster"].dataType.simpleString()
    rim = F.collect_list(F.array(*(F.col(c).cast("long") for c in ("row", "c0", "c1"))))
    boxes = rims.groupBy("raster", "label").agg(rim.alias("rim")).mapInPandas(rectangle, f"raster {kind}, label long, around double")
    told = fits.join(pure, ["raster", "label"]).join(boxes, ["raster", "label"]).where(F.col("purity") >= least_purity)
    boxy = F.col("n") / F.col("around")
    usual = F.exp(-F.pow(F.log("acres") - math.log(USUAL_ACRES), F.lit(2.0)) / 2)
    return told.select("raster", "block", "label", "acres", "purity", boxy.alias("boxiness"), "row", "col", (2 * F.col("purity") + boxy + usual).alias("score"))
