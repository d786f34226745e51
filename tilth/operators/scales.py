"""Rasters at several scales: Gaussian levels on blocks with halos, and the ground around every pixel from coarse blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.operators.raster import PIXEL
from tilth.operators.spatial import nearest_within
from tilth.sources.shared import materialize

#: Percentile of a block that is its ground, and degrees by which leaves are colder than the ground around them (fixed values).
GROUND_PERCENTILE, LEAF_COLDER = 75.0, 3.0


def _radius(sigma: float) -> int:
    return int(4 * sigma + 0.5)


def _blur(grid: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian (cut off at four sigma) along both axes, one after the other; nothing beyond the grid."""
    r = _radius(sigma)
    for axis in (0, 1):
        moved = np.moveaxis(grid, axis, 0)
        wide = np.pad(moved, ((r, r), (0, 0)))
        taps = (np.exp(-(d * d) / (2 * sigma * sigma)) * wide[r + d : r + d + len(moved)] for d in range(-r, r + 1))
        grid = np.moveaxis(sum(taps), 0, axis)
    return grid


def levels(pixels: DataFrame, sigmas: list[float], block: int = 256) -> DataFrame:
    """raster, row, col, v and levels: v smoothed by each sigma, over the known pixels only; NULL where v is NULL or NaN.

    A pixel goes to each block whose halo holds it (few pixels go to more than one), and a task smooths one block at a
    time along rows and columns, so that results do not depend on the blocks. Repeated pixels weigh each.
    """
    halo = max(map(_radius, sigmas))
    block = max(block, halo, 1)
    width = block + 2 * halo

    def smooth(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r, c = (frame[a].to_numpy() - b * block + halo for a, b in (("row", key[1]), ("col", key[2])))
        v = frame["v"].to_numpy(dtype=float, na_value=np.nan)
        known = ~np.isnan(v)
        total, count = np.zeros((width, width)), np.zeros((width, width))
        np.add.at(total, (r[known], c[known]), v[known])
        np.add.at(count, (r[known], c[known]), 1.0)
        own = (r >= halo) & (r < halo + block) & (c >= halo) & (c < halo + block)
        out = frame.loc[own, [*PIXEL, "v"]].copy()
        at = r[own], c[own]
        with np.errstate(invalid="ignore", divide="ignore"):
            made = np.array([_blur(total, s)[at] / _blur(count, s)[at] for s in sigmas]).T
        out["levels"] = pd.Series([list(x) if k else [None] * len(sigmas) for x, k in zip(made, known[own], strict=True)], index=out.index, dtype=object)
        return out

    blocks = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / block), F.floor((F.col(c) + halo) / block)))
    cells = pixels.select(F.col("raster").cast("long").alias("raster"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))
    sent = cells.withColumn("block_row", blocks("row")).withColumn("block_col", blocks("col"))
    return sent.groupBy("raster", "block_row", "block_col").applyInPandas(smooth, "raster long, row long, col long, v double, levels array<double>")


def _filled(blocks: DataFrame) -> DataFrame:
    """Blocks (raster, i, j, g) whose g is NULL take that of the nearest other (ties: least i, then j); rasters without any stay as they are."""
    placed = materialize(blocks.withColumns({"id": F.col("i") * F.lit(1 << 31) + F.col("j"), "x": F.col("i").cast("double"), "y": F.col("j").cast("double")}))
    known = placed.where("g is not null")
    left = materialize(placed.where("g is null").join(known.select("raster").distinct(), "raster", "left_semi"))
    found, cell = [], 2.0
    while not left.isEmpty():
        got = materialize(nearest_within(known, ["raster"], 1, cell, left).select("raster", "id", "other"))
        found.append(got)
        left = materialize(left.join(got, ["raster", "id"], "left_anti"))
        cell *= 4
    if not found:
        return placed.select("raster", "i", "j", "g")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    lent = pairs.join(known.select("raster", F.col("id").alias("other"), F.col("g").alias("near")), ["raster", "other"]).select("raster", "id", "near")
    return placed.join(lent, ["raster", "id"], "left").select("raster", "i", "j", F.coalesce("g", "near").alias("g"))


def ground_around(pixels: DataFrame, block: int, percentile: float = GROUND_PERCENTILE) -> DataFrame:
    """raster, row, col, v and ground: a high percentile of each square block, carried linearly between the blocks' middles.

    Rows and columns count from 0. Blocks that the raster's end cuts are filled up with copies of its last row and column;
    NULL and NaN are no pixels, and blocks without any take the nearest block's ground. Rasters without any have NULL.
    """
    size = pixels.groupBy("raster").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    size = materialize(size.withColumns({f"n_{c}": F.ceil((F.col(f"last_{c}") + 1) / block) for c in ("row", "col")}))
    sized = pixels.select(*PIXEL, "v").join(size, "raster")
    copies = F.lit(1)
    for c in ("row", "col"):
        copies = copies * F.when(F.col(c) == F.col(f"last_{c}"), F.col(f"n_{c}") * block - F.col(c)).otherwise(1)
    whole = sized.select("raster", F.floor(F.col("row") / block).alias("block_row"), F.floor(F.col("col") / block).alias("block_col"), "v", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    ground = exact_quantiles(whole, ["raster", "block_row", "block_col"], "v", [percentile / 100])
    ground = ground.select("raster", F.col("block_row").alias("i"), F.col("block_col").alias("j"), F.get("q", F.lit(0)).alias("g"))
    every = size.select("raster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_row") - 1)).alias("i"), "n_col").select("raster", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_col") - 1)).alias("j"))
    blocks = _filled(every.join(ground, ["raster", "i", "j"], "left"))
    # the four blocks around a pixel stand in one row, so that pixels meet them once
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1))))
    spread = blocks.withColumn("o", corner).select("raster", (F.col("i") - F.col("o.a")).alias("i"), (F.col("j") - F.col("o.b")).alias("j"), "o", "g")
    around = spread.groupBy("raster", "i", "j").agg(*(F.max(F.when((F.col("o.a") == a) & (F.col("o.b") == b), F.col("g"))).alias(f"g{a}{b}") for a in (0, 1) for b in (0, 1)))
    place = lambda c: F.least(F.greatest((F.col(c) + 0.5) / block - 0.5, F.lit(0.0)), F.col(f"n_{c}") - 1.0)
    met = sized.withColumns({"p": place("row"), "q": place("col")}).withColumns({"i": F.floor("p"), "j": F.floor("q")}).join(around, ["raster", "i", "j"])
    s, t = F.col("p") - F.col("i"), F.col("q") - F.col("j")
    g = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    made = (1 - s) * ((1 - t) * F.col("g00") + t * g("g01")) + s * ((1 - t) * g("g10") + t * g("g11"))
    return met.select(*PIXEL, "v", made.alias("ground"))


def leaves(pixels: DataFrame, pixel_m: float, window_m: float, colder: float = LEAF_COLDER) -> DataFrame:
    """ground_around() with leaf: whether a pixel is so much colder than the ground around it; NULL where nothing is known."""
    if pixel_m <= 0:
        raise ValueError("pixels must have a size")
    return ground_around(pixels, max(3, round(window_m / pixel_m))).withColumn("leaf", F.col("ground") - F.col("v") >= colder)
