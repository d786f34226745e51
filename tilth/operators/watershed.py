"""Watershed of marked tops on rasters as pixel tables (raster, row, col, v).

What a flood from the tops down would give is found without a queue. Pixels are in one strict order, highest
first and then by cell. Each pixel belongs to the basin of its first neighbour (flight.crowns: pointers that are
jumped), so the flood only has to say how basins without a marker join others: over their highest pass. Passes
between basins are few beside the pixels. In each round every group of basins without a marker takes its
first pass to another group, and chains of these are followed at once; the number of such groups halves
at least, so rounds grow with the logarithm of the longest run of unmarked basins.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators import raster as R
from tilth.operators.flight import crowns
from tilth.sources.shared import materialize, release


def _cell() -> Column:
    return F.col("row") * F.lit(1 << 31) + F.col("col")


def _kept(pixels: DataFrame, more: str) -> str:
    """The schema of the pixels' keys and more."""
    return ", ".join(f"{c} {pixels.schema[c].dataType.simpleString()}" for c in R.PIXEL) + ", " + more


def _spread(grid: np.ndarray, reach: int, made: Callable) -> np.ndarray:
    """made() of the 2 * reach + 1 neighbours in each direction of both axes, one after the other; the rim of `reach` is not made."""
    for axis in (0, 1):
        moved = np.moveaxis(grid, axis, 0)
        n = len(moved) - 2 * reach
        part = made([moved[reach + d : reach + d + n] for d in range(-reach, reach + 1)])
        grid = np.moveaxis(part, 0, axis)
    return grid


def smooth(pixels: DataFrame, sigma: float, tile: int = R.TILE) -> DataFrame:
    """Gaussian mean of the known pixels by two passes in a tile, one for each axis; unknown pixels stay so."""
    reach = int(4 * sigma + 0.5)
    bell = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]

    def made(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        known = frame["known"].to_numpy(dtype=bool)
        total, count = np.zeros((width, width)), np.zeros((width, width))
        total[r[known], c[known]], count[r[known], c[known]] = frame["v"].to_numpy(dtype=float)[known], 1.0
        blur = lambda grid: _spread(grid, reach, lambda parts: sum(w * p for w, p in zip(bell, parts, strict=True)))
        at = r[own] - reach, c[own] - reach
        out = frame.loc[own, [*R.PIXEL, "known"]].copy()
        with np.errstate(invalid="ignore", divide="ignore"):
            out["v"] = blur(total)[at] / blur(count)[at]
        return out

    cells = pixels.select(*R.PIXEL, F.col("v").cast("double").alias("v"), F.col("v").isNotNull().alias("known"))
    got = R.in_tiles(cells, reach, made, _kept(pixels, "known boolean, v double"), tile)
    return got.select(*R.PIXEL, F.when(F.col("known"), F.col("v")).alias("v"))


def tops(pixels: DataFrame, apart: int, tile: int = R.TILE) -> DataFrame:
    """raster, cell of the pixels that come first within `apart` rows and columns around them."""

    def made(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        place = R.flood_order(frame)
        grid = np.full((width, width), len(frame))
        grid[r, c] = place
        first = _spread(grid, apart, np.minimum.reduce)
        return frame.loc[own, ["raster", "cell"]][first[r[own] - apart, c[own] - apart] == place[own]]

    known = pixels.where("v is not null").select(*R.PIXEL, F.col("v").cast("double").alias("v"), _cell().alias("cell"))
    return R.in_tiles(known, apart, made, f"raster {pixels.schema['raster'].dataType.simpleString()}, cell long", tile)


def passes(pixels: DataFrame, basins: DataFrame, tile: int = R.TILE) -> DataFrame:
    """raster, a, b, way: neighbouring basins both ways, with their first pass in the order of the flood."""

    def made(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        place, v, cell, crown = R.flood_order(frame), frame["v"].to_numpy(), frame["cell"].to_numpy(), frame["crown"].to_numpy()
        grid = np.full((width + 2, width + 2), -1)
        grid[r + 1, c + 1] = np.arange(len(frame))
        here = np.flatnonzero(own)
        there = [grid[r[own] + 1 + a, c[own] + 1 + b] for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))]
        one, two = np.tile(here, 4), np.concatenate(there)
        met = (two >= 0) & (crown[one] != crown[two])
        one, two = one[met], two[met]
        swap = place[one] > place[two]
        high, low = np.where(swap, two, one), np.where(swap, one, two)
        a, b = np.minimum(crown[one], crown[two]), np.maximum(crown[one], crown[two])
        order = np.lexsort((place[high], place[low], b, a))
        high, low, a, b = high[order], low[order], a[order], b[order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        high, low = high[first], low[first]
        key = frame["raster"].iloc[:1].repeat(len(low)).reset_index(drop=True)
        return pd.DataFrame({"raster": key, "a": a[first], "b": b[first], "low_v": -v[low], "low_c": cell[low], "high_v": -v[high], "high_c": cell[high]})

    cells = basins.select(*R.PIXEL, "v", "crown", _cell().alias("cell"))
    schema = f"raster {basins.schema['raster'].dataType.simpleString()}, a long, b long, low_v double, low_c long, high_v double, high_c long"
    place = lambda p: F.struct(F.col(f"{p}_v").alias("v"), F.col(f"{p}_c").alias("c"))
    met = R.in_tiles(cells, 1, made, schema, tile)
    pairs = materialize(met.groupBy("raster", "a", "b").agg(F.min(F.struct(place("low").alias("low"), place("high").alias("high"))).alias("way")))
    return pairs.union(pairs.select("raster", F.col("b").alias("a"), F.col("a").alias("b"), "way"))


def joined(basins: DataFrame, ways: DataFrame, markers: DataFrame) -> DataFrame:
    """raster, crown (a basin) and label (the marker's cell; NULL where no marker is reached).

    A group is named by its least basin until it has a marker, then by the marker's basin.
    """
    names = basins.select("raster", "crown").distinct()
    marked = markers.select("raster", F.col("cell").alias("crown"), F.lit(True).alias("marked"))
    groups = materialize(names.join(marked.hint("merge"), ["raster", "crown"], "left").select("raster", "crown", F.col("crown").alias("group"), F.coalesce("marked", F.lit(False)).alias("marked")))
    ways = materialize(ways)
    while True:
        side = lambda c: groups.select("raster", F.col("crown").alias(c), F.col("group").alias(f"g{c}"), F.col("marked").alias(f"m{c}"))  # noqa: B023, E731
        out = ways.join(side("a").hint("merge"), ["raster", "a"]).where("not ma").join(side("b").hint("merge"), ["raster", "b"]).where("ga != gb")
        first = materialize(out.groupBy("raster", F.col("ga").alias("group")).agg(F.min(F.struct("way", "gb", "mb")).alias("x")).select("raster", "group", F.col("x.gb").alias("to"), F.col("x.mb").alias("ends")))
        if first.isEmpty():
            last = groups.select("raster", "crown", F.when(F.col("marked"), F.col("group")).alias("label"))
            release(first, ways)
            return last
        # two groups that take the same pass both ways: the lesser is the root
        back = first.select("raster", F.col("group").alias("to"), F.col("to").alias("group"), F.lit(True).alias("mutual"))
        rooted = first.join(back.hint("merge"), ["raster", "group", "to"], "left")
        root = F.coalesce("mutual", F.lit(False)) & (F.col("group") < F.col("to"))
        links = materialize(rooted.select("raster", "group", F.when(root, F.col("group")).otherwise(F.col("to")).alias("to"), (F.col("ends") & ~root).alias("ends")))
        release(first)
        while True:  # follow chains to their roots or markers
            jump = links.select("raster", F.col("group").alias("to"), F.col("to").alias("next"), F.col("ends").alias("next_ends"))
            both = links.join(jump.hint("merge"), ["raster", "to"], "left")
            more = ~F.col("ends") & F.col("next").isNotNull() & (F.col("next") != F.col("to"))
            after = materialize(both.select("raster", "group", F.when(more, F.col("next")).otherwise(F.col("to")).alias("to"), F.when(more, F.col("next_ends")).otherwise(F.col("ends")).alias("ends"), more.alias("moved")))
            still = after.where("moved").isEmpty()
            release(links)
            links = after
            if still:
                break
        new = groups.join(links.select("raster", "group", "to", "ends").hint("merge"), ["raster", "group"], "left")
        after = materialize(new.select("raster", "crown", F.coalesce("to", "group").alias("group"), (F.col("marked") | F.coalesce("ends", F.lit(False))).alias("marked")))
        release(links, groups)
        groups = after


def watershed(pixels: DataFrame, markers: DataFrame, least: float, tile: int = R.TILE) -> DataFrame:
    """raster, row, col, v and label: of each pixel of at least `least`, the marker (raster, cell) whose flood reaches it first; NULL where none does."""
    basins = materialize(crowns(pixels, least, tile))
    found = joined(basins, passes(pixels, basins, tile), markers)
    return basins.join(found.hint("merge"), ["raster", "crown"]).select("raster", "row", "col", "v", "label")


def tree_crowns(heights: DataFrame, cell_m: float, least_m: float = 0.5, apart_m: float = 1.5, smooth_m: float = 0.15, least_cells: int = 4) -> DataFrame:
    """raster, label, top_row, top_col, height (smoothed, at the top), n_cells, area_m2 and the crown's box and middle.

    Heights are smoothed first; tops are at least apart_m from each other, and crowns of fewer than least_cells go.
    """
    canopy = materialize(smooth(heights, max(smooth_m / cell_m, 0.5)).where(F.col("v") >= least_m))
    found = watershed(canopy, tops(canopy, max(int(round(apart_m / cell_m)), 1)), least_m).where("label is not null")
    shapes = found.groupBy("raster", "label").agg(
        F.max("v").alias("height"), F.count("*").alias("n_cells"), (F.count("*") * cell_m**2).alias("area_m2"),
        F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.avg("row").alias("mid_row"), F.avg("col").alias("mid_col"),
    )
    top = F.col("label")
    return shapes.where(F.col("n_cells") >= least_cells).withColumns({"top_row": F.shiftright(top, 31), "top_col": top % F.lit(1 << 31)})
