"""Rasters as pixel tables (raster, row, col, v): zonal, focal and block operators, components, surfaces.

A focal operator sends each pixel to the cells that see it and aggregates there, so neighbours meet by
an equi-join on the cell whatever the raster's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.sources.shared import materialize

PIXEL = ["raster", "row", "col"]
#: Rows and columns of a tile.
TILE = 128


def zonal(pixels: DataFrame, zones: list[str], value: str, cover_above: float, cell_area: float) -> DataFrame:
    """Area, largest, mean, cover, volume and coverage of each zone."""
    v = F.col(value)
    return pixels.groupBy(*zones).agg(F.count("*").alias("n_pixels"), (F.count("*") * cell_area).alias("area"), F.max(v).alias("largest"), F.avg(v).alias("mean"), (F.count_if(v >= cover_above) / F.count("*")).alias("cover"), (F.sum(F.greatest(v, F.lit(0.0))) * cell_area).alias("volume"), (F.count(v) / F.count("*")).alias("coverage"))


def offsets(radius: int, weight=None) -> Column:
    """Kernel cells within a square of the radius with weight(dr, dc) above 0, as an array of structs."""
    weight = weight or (lambda dr, dc: 1.0)
    cells = [(dr, dc, float(weight(dr, dc))) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1)]
    return F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("w")) for dr, dc, w in cells if w > 0))


def gaussian(sigma: float, truncate: float = 4.0) -> Column:
    r = int(truncate * sigma + 0.5)
    return offsets(r, lambda a, b: math.exp(-(a * a + b * b) / (2 * sigma * sigma)))


def focal(pixels: DataFrame, kernel: Column, how: str = "mean") -> DataFrame:
    """Weighted mean, least or largest of the known neighbours of each cell; cells without a value keep NULL."""
    sent = pixels.where("v is not null").select("raster", "row", "col", "v", F.explode(kernel).alias("k")).select("raster", (F.col("row") + F.col("k.dr")).alias("row"), (F.col("col") + F.col("k.dc")).alias("col"), "v", "k.w")
    made = {"mean": F.sum(F.col("v") * F.col("w")) / F.sum("w"), "min": F.min("v"), "max": F.max("v")}[how]
    return pixels.join(sent.groupBy(*PIXEL).agg(made.alias("f")), PIXEL, "left").withColumn("f", F.when(F.col("v").isNotNull(), F.col("f")))


def in_tiles(pixels: DataFrame, halo: int, made: Callable, schema: str, tile: int = TILE) -> DataFrame:
    """Tiles of a raster one at a time: made(frame, r, c, own, width) gives the rows of a tile.

    A pixel goes to each tile whose halo holds it (few go to more than one). r and c are the places of the frame's pixels
    on a square of the given width, and own marks those of the tile itself.
    """
    tile = max(tile, halo, 1)
    width = tile + 2 * halo

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, c = (frame[a].to_numpy() - b * tile + halo for a, b in (("row", key[1]), ("col", key[2])))
        own = (r >= halo) & (r < halo + tile) & (c >= halo) & (c < halo + tile)
        return made(frame, r, c, own, width)

    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    sent = pixels.withColumn("tile_row", tiles("row")).withColumn("tile_col", tiles("col"))
    return sent.groupBy("raster", "tile_row", "tile_col").applyInPandas(one, schema)


def flood_order(frame: pd.DataFrame) -> np.ndarray:
    """The place of each pixel (v, cell) in the order of a flood: highest first, then by cell."""
    place = np.empty(len(frame), dtype=np.int64)
    place[np.lexsort((frame["cell"].to_numpy(), -frame["v"].to_numpy()))] = np.arange(len(frame))
    return place


def block_reduce(pixels: DataFrame, size: int) -> DataFrame:
    """Mean, count and coverage of square blocks."""
    return pixels.groupBy("raster", F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg(F.avg("v").alias("v"), F.count("v").alias("n"), (F.count("v") / (size * size)).alias("covered"))


def surface_height(top: DataFrame, ground: DataFrame, most: float) -> DataFrame:
    """Height of a surface above the ground, below 0 as 0, above `most` as `most`."""
    rows = top.join(ground.withColumnRenamed("v", "g"), PIXEL, "left")
    h = F.col("v") - F.col("g")
    return rows.select(*PIXEL, F.when(h.isNotNull(), F.least(F.greatest(h, F.lit(0.0)), F.lit(most))).alias("v"), (h < 0).alias("clamped"))


def first_of_each(grid: np.ndarray) -> np.ndarray:
    """For each cell of the grid that is set, the least place (row * width + col) of its 4-connected component; -1 elsewhere.

    Runs of cells in a row are numbered in order and joined to those below that they touch: the greater root takes the less.
    """
    high, width = grid.shape
    start = grid.copy()
    start[:, 1:] &= ~grid[:, :-1]
    run = np.cumsum(start.ravel()).reshape(high, width) - 1
    first = np.flatnonzero(start.ravel())
    touch = grid[:-1] & grid[1:]
    a, b = run[:-1][touch], run[1:][touch]
    root = np.arange(len(first))
    while len(a):
        low, top = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != top
        a, b = a[apart], b[apart]
        np.minimum.at(root, top[apart], low[apart])
        while not np.array_equal(root, after := root[root]):
            root = after
    out = np.full(grid.shape, -1, dtype=np.int64)
    out[grid] = first[root[run[grid]]]
    return out


def components(cells: DataFrame, more: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """4-connected components of cells (raster, row, col and more): label is the least cell key of the component.

    Tiles are labelled by themselves. What is joined over their edges are labels, not cells: labels spread to those they meet
    and jump along their own pointers, so rounds grow with the logarithm of the tiles that a component runs through; each
    round is written to the shared folder.
    """
    cells = cells.select(*PIXEL, *more).where("raster is not null and row is not null and col is not null")

    def made(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        grid = np.zeros((width, width), dtype=bool)
        grid[r, c] = True
        at = first_of_each(grid)[r, c]
        row0, col0 = int(frame["row"].iloc[0]) - int(r[0]), int(frame["col"].iloc[0]) - int(c[0])
        return frame[[*PIXEL, *more]].assign(label=(row0 + at // width) * (1 << 31) + col0 + at % width)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema)
    local = materialize(in_tiles(cells, 0, made, f"{kept}, label long", tile))

    def across(axis: str) -> DataFrame:
        place = F.pmod(F.col(axis), F.lit(tile))
        before = local.where(place == tile - 1).select(*PIXEL, F.col("label").alias("from")).withColumn(axis, F.col(axis) + 1)
        after = local.where(place == 0).select(*PIXEL, F.col("label").alias("to"))
        return before.join(after.hint("merge"), PIXEL).select("raster", "from", "to")

    met = across("row").union(across("col"))
    ends = F.explode(F.array(*(F.struct(F.col(a).alias("from"), F.col(b).alias("to")) for a, b in (("from", "to"), ("to", "from"), ("from", "from"), ("to", "to")))))
    edges = materialize(met.distinct().select("raster", ends.alias("e")).select("raster", "e.*").distinct())
    if edges.isEmpty():
        return local
    labels = edges.where(F.col("from") == F.col("to")).select("raster", F.col("from").alias("cell"), F.col("from").alias("label"))
    before = None
    while True:
        low = edges.join(labels.withColumnRenamed("cell", "to").hint("merge"), ["raster", "to"]).groupBy("raster", F.col("from").alias("cell")).agg(F.min("label").alias("label"))
        jump = low.select("raster", F.col("cell").alias("label"), F.col("label").alias("next"))
        labels = materialize(low.join(jump.hint("merge"), ["raster", "label"], "left").select("raster", "cell", F.least("label", F.coalesce("next", "label")).alias("label")))
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
    moved = labels.where("cell != label").select("raster", F.col("cell").alias("label"), F.col("label").alias("least"))
    return local.join(moved.hint("merge"), ["raster", "label"], "left").select(*PIXEL, *more, F.coalesce("least", "label").alias("label"))


def fill_small_holes(pixels: DataFrame, most: int, reach: int) -> DataFrame:
    """Holes of at most so many cells take the nearest known value within the reach (ties: least row, column)."""
    holes = components(pixels.where("v is null"))
    small = holes.join(holes.groupBy("raster", "label").count().where(F.col("count") <= most), ["raster", "label"], "left_semi")
    kernel = offsets(reach)
    near = small.select("raster", F.col("row").alias("r"), F.col("col").alias("c"), F.explode(kernel).alias("k")).select("raster", "r", "c", (F.col("r") + F.col("k.dr")).alias("row"), (F.col("c") + F.col("k.dc")).alias("col"), (F.col("k.dr") * F.col("k.dr") + F.col("k.dc") * F.col("k.dc")).alias("d"))
    found = near.join(pixels.where("v is not null"), PIXEL).groupBy("raster", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.min_by("v", F.struct("d", "row", "col")).alias("near"))
    return pixels.join(found, PIXEL, "left").select(*PIXEL, F.coalesce("v", "near").alias("v"), (F.col("v").isNull() & F.col("near").isNotNull()).alias("filled"))


def otsu(values: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Threshold that parts each key's values best in two, from a histogram."""
    ends = values.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    hist = values.join(ends, keys).withColumn("bin", F.least(F.floor((F.col(value) - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0)) * bins), F.lit(bins - 1))).groupBy(*keys, "bin", "a", "b").agg(F.count("*").alias("n"))
    centre = F.col("a") + (F.col("bin") + 0.5) * (F.col("b") - F.col("a")) / bins
    hist = hist.where("bin is not null").withColumn("x", centre)
    low = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    n0, s0, n, s = F.sum("n").over(low), F.sum(F.col("n") * F.col("x")).over(low), F.sum("n").over(every), F.sum(F.col("n") * F.col("x")).over(every)
    between = F.when(n0 < n, n0 * (n - n0) * F.pow(s0 / n0 - (s - s0) / F.nullif(n - n0, F.lit(0)), F.lit(2.0)))
    return hist.select(*keys, "bin", "x", between.alias("between")).where("between is not null").groupBy(*keys).agg(F.min_by("x", F.struct(-F.round("between", 6), F.col("bin"))).alias("threshold"))


def order_statistic(points: DataFrame, cell: list[str], value: str, percent: float) -> DataFrame:
    """The floor((n - 1) * percent / 100)-th smallest value of each cell."""
    w = Window.partitionBy(*cell)
    ranked = points.select(*cell, value, F.row_number().over(w.orderBy(value)).alias("rn"), F.count("*").over(w).alias("n"))
    return ranked.where(F.col("rn") == F.floor((F.col("n") - 1) * percent / 100) + 1).select(*cell, F.col(value).alias("low"), "n")


def voxel_volume(points: DataFrame, keys: list[str], size: float, ground: float) -> DataFrame:
    """Volume under the highest point of each column, in whole voxels."""
    tops = points.groupBy(*keys, F.floor(F.col("x") / size).alias("i"), F.floor(F.col("y") / size).alias("j")).agg(F.max("z").alias("top"))
    return tops.groupBy(*keys).agg((F.sum(F.ceil(F.greatest(F.col("top") - ground, F.lit(0.0)) / size)) * size**3).alias("volume"), F.count("*").alias("columns"))


def thin(points: DataFrame, keys: list[str], size: float) -> DataFrame:
    """One point of each cube: the nearest to its centre (ties: x, y, z)."""
    off = lambda c: F.pow(F.col(c) - (F.floor(F.col(c) / size) + 0.5) * size, F.lit(2.0))
    cube = [F.floor(F.col(c) / size).alias(f"c{c}") for c in "xyz"]
    out = points.withColumn("d", F.round(off("x") + off("y") + off("z"), 9)).groupBy(*keys, *cube).agg(F.min(F.struct("d", "x", "y", "z")).alias("p"))
    return out.select(*keys, "p.x", "p.y", "p.z")


def level_frames(shares: DataFrame, rounds: int = 6, anchor: float = 0.1) -> DataFrame:
    """Offsets of overlapping frames by alternating least squares on (frame, cell, n, s): cell means, then offsets."""
    shares = materialize(shares.select("frame", "cell", "n", "s"))
    offset = shares.select("frame").distinct().withColumn("o", F.lit(0.0))
    for _ in range(rounds):
        moved = shares.join(offset, "frame")
        cells = moved.groupBy("cell").agg((F.sum(F.col("s") - F.col("o") * F.col("n")) / F.sum("n")).alias("m"))
        rest = shares.join(cells, "cell").groupBy("frame").agg((F.sum(F.col("s") - F.col("m") * F.col("n")) / (F.sum("n") * (1 + anchor))).alias("o"))
        offset = materialize(rest)
    return offset
