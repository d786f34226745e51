"""Flights: surveys, colour squares, rows of plants, crowns, mosaics and warm patches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.functions import geo
from tilth.operators import raster
from tilth.sources.shared import materialize, release


def survey(shots: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, bounds, spacings, altitude spread and duration of flights from shots (seq, ts, lon, lat, alt)."""
    w = Window.partitionBy(*keys).orderBy("ts", "seq")
    step = geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    rows = shots.withColumn("step", step)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_images"), F.count("lon").alias("n_gps"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"),
        F.avg("step").alias("mean_step"), F.percentile("step", F.lit(0.5)).alias("median_step"), ((F.max("alt") - F.min("alt")) / F.abs(F.avg("alt"))).alias("altitude_spread"), (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("seconds"),
    )


def colour_squares(pixels: DataFrame, size: int, leaf: float) -> DataFrame:
    """Squares of pixels (raster, row, col, exg): leaf share, leaf greenness and verdict against the raster's median and MAD."""
    sq = pixels.groupBy("raster", F.floor(F.col("row") / size).alias("row"), F.floor(F.col("col") / size).alias("col")).agg((F.count("exg") / (size * size)).alias("covered"), F.avg(F.when(F.col("exg").isNotNull(), (F.col("exg") > leaf).cast("int"))).alias("leaf"), F.avg(F.when(F.col("exg") > leaf, F.col("exg"))).alias("green"))
    ok = sq.where("covered >= 0.5")
    med = ok.groupBy("raster").agg(F.percentile("leaf", F.lit(0.5)).alias("m_leaf"), F.percentile("green", F.lit(0.5)).alias("m_green"))
    rows = ok.join(med, "raster")
    mad = rows.groupBy("raster").agg((F.percentile(F.abs(F.col("green") - F.col("m_green")), F.lit(0.5)) * 1.4826).alias("mad"))
    flag = F.when(F.col("leaf") < 0.25 * F.col("m_leaf"), "MISSING").when(F.col("leaf") < 0.6 * F.col("m_leaf"), "WEAK").when(F.col("green") < F.col("m_green") - 3 * F.col("mad"), "PALE").otherwise("OK")
    return rows.join(mad, "raster").select("raster", "row", "col", "leaf", "green", flag.alias("flag"))


def row_gaps(points: DataFrame, keys: list[str], least: int = 10, most: int = 3) -> DataFrame:
    """Missing plants between neighbours of a row (along): at most `most` where the step is a multiple of the median."""
    w = Window.partitionBy(*keys).orderBy("along")
    rows = points.withColumn("next", F.lead("along").over(w)).withColumn("step", F.col("next") - F.col("along"))
    usual = rows.groupBy(*keys).agg(F.percentile("step", F.lit(0.5)).alias("usual"), F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("usual") > 0))
    gaps = rows.join(usual, keys).withColumn("missing", (F.round(F.col("step") / F.col("usual")) - 1).cast("int")).where(F.col("missing").between(1, most))
    return gaps.select(*keys, F.explode(F.sequence(F.lit(1), F.col("missing"))).alias("i"), "along", "step", "missing").select(*keys, (F.col("along") + F.col("step") * F.col("i") / (F.col("missing") + 1)).alias("at"))


def row_labels(points: DataFrame, keys: list[str], gap: float = 1.5) -> DataFrame:
    """Rows across a direction: a new row where the step across is wider than the gap."""
    w = Window.partitionBy(*keys).orderBy("across", "id")
    new = F.when(F.col("across") - F.lag("across").over(w) <= gap, 0).otherwise(1)
    return points.withColumn("_new", new).withColumn("row", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def row_direction(points: DataFrame, keys: list[str], step_deg: float = 1.0, bin_m: float = 0.5) -> DataFrame:
    """The direction in which points fall into the sharpest rows: largest sum of squared bin counts."""
    angles = F.sequence(F.lit(0), F.lit(int(180 / step_deg) - 1))
    rows = points.select(*keys, "x", "y", F.explode(angles).alias("a")).withColumn("t", F.radians(F.col("a") * step_deg))
    bins = rows.groupBy(*keys, "a", F.floor((F.col("x") * F.cos("t") + F.col("y") * F.sin("t")) / bin_m).alias("bin")).agg(F.count("*").alias("n"))
    sharp = bins.groupBy(*keys, "a").agg(F.sum(F.col("n") * F.col("n")).alias("s"))
    return sharp.groupBy(*keys).agg(F.min_by("a", F.struct(-F.col("s"), F.col("a"))).alias("a")).select(*keys, (F.col("a") * step_deg).alias("direction"))


def row_geometry(tiles: DataFrame, least_m: float, most_m: float) -> DataFrame:
    """Row spacing and direction of square tiles (tile, cell_m, n, v: array of n * n heights) by the strongest frequency."""

    def peak(batches):
        for pdf in batches:
            out = []
            for tile, cell, n, v in zip(pdf["tile"], pdf["cell_m"], pdf["n"], pdf["v"], strict=True):
                z = np.nan_to_num(np.asarray(v, float).reshape(n, n))
                power = np.abs(np.fft.fft2((z - z.mean()) * np.outer(np.hanning(n), np.hanning(n)))) ** 2
                fy, fx = np.meshgrid(np.fft.fftfreq(n, cell), np.fft.fftfreq(n, cell), indexing="ij")
                f = np.hypot(fx, fy)
                band = (f >= 1 / most_m) & (f <= 1 / least_m)
                if not band.any() or power[band].max() <= 0:
                    out.append((tile, None, None, 0.0))
                    continue
                k = int(np.argmax(np.where(band, power, -1)))
                strength = power.ravel()[k] / max(np.percentile(power[band], 99), 1e-12)
                out.append((tile, 1 / f.ravel()[k], float(np.degrees(np.arctan2(fy.ravel()[k], fx.ravel()[k])) % 180), float(strength)))
            yield pd.DataFrame(out, columns=["tile", "spacing_m", "across_deg", "strength"])

    return tiles.select("tile", "cell_m", "n", "v").mapInPandas(peak, "tile long, spacing_m double, across_deg double, strength double")


def crowns(pixels: DataFrame, least: float, tile: int = raster.TILE) -> DataFrame:
    """Crowns of a height raster: each pixel follows its highest neighbour up to a top.

    Pixels are cells of at least the given height; ties go to the least cell key. Paths are followed tile by tile; only
    those that leave their tile are followed between tiles, by pointers at the tiles' edges that are jumped.
    """
    high = pixels.where(F.col("v") >= least).select("raster", "row", "col", F.col("v").cast("double").alias("v"), (F.col("row") * F.lit(1 << 31) + F.col("col")).alias("cell"))

    def follow(frame: pd.DataFrame, r: np.ndarray, c: np.ndarray, own: np.ndarray, width: int) -> pd.DataFrame:
        n = len(frame)
        place = raster.flood_order(frame)
        grid = np.full((width + 2, width + 2), n)
        grid[r + 1, c + 1] = place
        first = np.minimum.reduce([grid[r + 1 + a, c + 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)])
        at = np.empty(n, dtype=np.int64)
        at[place] = np.arange(n)
        to = np.where(own, at[first], np.arange(n))  # pixels of the halo end a path here
        while not np.array_equal(to, after := to[to]):
            to = after
        out = frame.loc[own, ["raster", "row", "col", "cell", "v"]].copy()
        out["top"], out["leaves"] = frame["cell"].to_numpy()[to[own]], ~own[to[own]]
        return out

    kinds = {f.name: f.dataType.simpleString() for f in high.schema}
    schema = f"raster {kinds['raster']}, row {kinds['row']}, col {kinds['col']}, cell long, v double, top long, leaves boolean"
    pointers = materialize(raster.in_tiles(high, 1, follow, schema, tile))
    edge = F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)
    links = materialize(pointers.where(edge).select("raster", "cell", "top", "leaves"))
    while not links.where("leaves").isEmpty():
        jump = links.select("raster", F.col("cell").alias("top"), F.col("top").alias("next"), F.col("leaves").alias("next_leaves"))
        gone = links.where("leaves").join(jump.hint("merge"), ["raster", "top"]).select("raster", "cell", F.col("next").alias("top"), F.col("next_leaves").alias("leaves"))
        after = materialize(links.where("not leaves").union(gone))
        release(links)
        links = after
    ends = links.select("raster", F.col("cell").alias("top"), F.col("top").alias("crown"))
    beyond = pointers.where("leaves").join(ends.hint("merge"), ["raster", "top"])
    return pointers.where("not leaves").select("raster", "row", "col", F.col("top").alias("crown"), "v").union(beyond.select("raster", "row", "col", "crown", "v"))


def paint(photos: DataFrame, cells: DataFrame, reach: float) -> DataFrame:
    """For each cell (i, j, x, y) the photo whose middle is nearest within its reach; the first photo wins ties."""
    # of photos at one place only the first can win, so pairs are bounded by places
    places = photos.groupBy("px", "py").agg(F.min("photo").alias("photo"))
    spread = places.withColumn("gi", F.explode(F.sequence(F.floor((F.col("px") - reach) / reach), F.floor((F.col("px") + reach) / reach)))).withColumn("gj", F.explode(F.sequence(F.floor((F.col("py") - reach) / reach), F.floor((F.col("py") + reach) / reach))))
    placed = cells.withColumn("gi", F.floor(F.col("x") / reach)).withColumn("gj", F.floor(F.col("y") / reach))
    d = F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0)))
    seen = placed.join(spread, ["gi", "gj"]).withColumn("d", F.round(d, 9)).where(F.col("d") <= reach)
    return seen.groupBy("i", "j").agg(F.min_by("photo", F.struct("d", "photo")).alias("photo"), F.min("d").alias("d"))


def warm_patches(pixels: DataFrame, cell_m: float, warm_z: float = 2.0, least_c: float = 1.0, least_m2: float = 25.0, least_share: float = 0.002) -> DataFrame:
    """Patches of cells warmer than the raster's median by 2 robust spreads and 1 degree, of a least size, largest first."""
    stats = pixels.where("v is not null").groupBy("raster").agg(F.count("*").alias("n")).join(exact_quantiles(pixels, ["raster"], "v", [0.25, 0.5, 0.75]), "raster")
    rows = pixels.join(stats, "raster").withColumn("above", F.col("v") - F.get("q", F.lit(1))).withColumn("spread", (F.get("q", F.lit(2)) - F.get("q", F.lit(0))) / 1.349)
    warm = materialize(rows.where(F.col("above") >= F.greatest(F.lit(least_c), warm_z * F.col("spread"))).select("raster", "row", "col", "v", "above", "n"))
    labels = raster.components(warm.select("raster", "row", "col"))
    patches = warm.join(labels, ["raster", "row", "col"]).groupBy("raster", "label").agg(F.count("*").alias("cells"), F.avg("v").alias("mean"), F.max("v").alias("peak"), F.avg("above").alias("above"), F.max("n").alias("n"))
    sized = patches.withColumn("area", F.col("cells") * cell_m * cell_m).where((F.col("area") >= least_m2) & (F.col("cells") >= least_share * F.col("n")))
    rank = F.row_number().over(Window.partitionBy("raster").orderBy(F.round(F.col("area") * F.col("above"), 9).desc(), "label"))
    return sized.select("raster", rank.alias("rank"), "area", "mean", "peak", "above", "cells")
