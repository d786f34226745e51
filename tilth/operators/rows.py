"""Planted rows on a height raster: where they repeat, where they sit from tile to tile, and their segments.

Pixels are (raster, row, col, v); geometry is a row for each raster: spacing_m, direction_deg (of the rows, x to
the right and y down) and phase_m (where one ridge lies across them). Lengths are metres in that frame.

The raster is cut into strips along the rows and these into tiles of some rows' width. Heights become profiles
(mean height by strip and place across) in one aggregate that combines before its shuffle; profiles are a small
part of the pixels. A tile is worked on with a halo of its neighbours' profiles, sent to it by an equi-join on
tile keys, so every tile of every raster is a group of its own. What then ties tiles together (unwrapping, the
plane, the bands of rows) are windows and aggregates over one row a tile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.sources.shared import materialize, release

#: Tile length along the rows and width in rows; least share of a tile's pixels and of its signal in phase (fixed values).
TILE_ALONG_M, TILE_ROWS, LEAST_PIXELS, LEAST_COHERENCE = 5.0, 8, 0.25, 0.05
#: Width in rows of the running median that is taken off a profile; drift in rows from which rows are followed (fixed values).
STEP_ROWS, LEAST_DRIFT = 2.5, 0.15
#: Correlation and prominence of a repeat, and pairs of pixels behind a lag beside those of lag 0 (fixed values).
LEAST_REPEAT, LEAST_PROMINENCE, LEAST_PAIRS = 0.10, 0.10, 0.25


def framed(pixels: DataFrame, geometry: DataFrame, cell_m: float) -> DataFrame:
    """Known pixels with their geometry and metres across and along the rows."""
    x, y, turn = (F.col("col") + 0.5) * cell_m, (F.col("row") + 0.5) * cell_m, F.radians("direction_deg")
    known = pixels.where(F.col("v").isNotNull() & ~F.isnan("v")).join(geometry, "raster")
    return known.withColumns({"across": y * F.cos(turn) - x * F.sin(turn), "along": x * F.cos(turn) + y * F.sin(turn)})


def profiles(pixels: DataFrame, geometry: DataFrame, cell_m: float, strip_m: float) -> DataFrame:
    """raster, strip, bin (a cell wide), n and s (pixels and their sum), and the frame's starts across0 and along0."""
    rows = framed(pixels, geometry, cell_m)
    start = rows.groupBy("raster").agg(F.min("across").alias("across0"), F.min("along").alias("along0"))
    placed = rows.join(start, "raster")
    step = lambda c, size: F.floor((F.col(c) - F.col(f"{c}0")) / size + 1e-6)  # noqa: E731  whole cells apart are so despite rounding
    strip, bin_ = step("along", strip_m), step("across", cell_m)
    keys = [c for c in geometry.columns if c != "raster"]
    return placed.groupBy("raster", strip.alias("strip"), bin_.alias("bin")).agg(F.count("*").alias("n"), F.sum("v").alias("s"), *(F.first(c).alias(c) for c in [*keys, "across0", "along0"]))


def repeat_spacing(pixels: DataFrame, geometry: DataFrame, cell_m: float, least_m: float = 0.3, most_m: float = 3.0, strip_m: float = 5.0) -> DataFrame:
    """raster, spacing_m and correlation of the smallest lag at which heights repeat across the rows; rasters without one are left out.

    Each profile loses what varies more slowly than the widest spacing; products of places a lag apart meet by an
    equi-join on the place, and are summed over all strips.
    """
    cells = materialize(profiles(pixels, geometry.select("raster", "direction_deg"), cell_m, strip_m).select("raster", "strip", "bin", "n", (F.col("s") / F.col("n")).alias("h")))
    sigma, most = max(1.0, most_m / 2 / cell_m), math.floor(most_m / cell_m) + 1
    reach = int(4 * sigma + 0.5)
    bell = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2 * sigma * sigma))).alias("w")) for d in range(-reach, reach + 1)))
    sent = cells.select("raster", "strip", "h", "bin", F.explode(bell).alias("k")).groupBy("raster", "strip", (F.col("bin") + F.col("k.d")).alias("bin")).agg((F.sum(F.col("h") * F.col("k.w")) / F.sum("k.w")).alias("slow"))
    # places meet places: merged, as their files are small and a broadcast would go through the driver
    detail = materialize(cells.join(sent.hint("merge"), ["raster", "strip", "bin"]).select("raster", "strip", "bin", (F.col("h") - F.col("slow")).alias("x"), "h"))
    lagged = detail.select("raster", "strip", F.col("x").alias("y"), F.col("bin").alias("from"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("lag"))
    lagged = lagged.select("raster", "strip", "lag", "y", (F.col("from") + F.col("lag")).alias("bin"))
    sums = detail.join(lagged.hint("merge"), ["raster", "strip", "bin"]).groupBy("raster", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count("*").alias("pairs"), F.sum(F.col("h") * F.col("h")).alias("hh"))
    zero = sums.where("lag = 0 and xy > 1e-9 * greatest(hh, 1e-12)").select("raster", F.col("xy").alias("xy0"), F.col("pairs").alias("pairs0"))
    acf = sums.join(zero, "raster").withColumn("r", F.col("xy") / F.col("pairs") / (F.col("xy0") / F.col("pairs0")))
    by_lag = Window.partitionBy("raster").orderBy("lag")
    least_before = F.min(F.when(F.col("lag") > 0, F.col("r"))).over(by_lag.rowsBetween(Window.unboundedPreceding, -1))
    thin = F.max(F.when(F.col("pairs") < LEAST_PAIRS * F.col("pairs0"), 1)).over(by_lag.rowsBetween(Window.unboundedPreceding, 1))
    rows = acf.withColumns({"a": F.lag("r").over(by_lag), "c": F.lead("r").over(by_lag), "low": least_before, "thin": thin})
    peak = (F.col("r") >= LEAST_REPEAT) & (F.col("r") > F.col("a")) & (F.col("r") >= F.col("c")) & (F.col("r") - F.col("low") >= LEAST_PROMINENCE) & F.col("thin").isNull()
    bend = F.col("a") - 2 * F.col("r") + F.col("c")
    off = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.coalesce(F.try_divide(0.5 * (F.col("a") - F.col("c")), bend), F.lit(0.0))))
    fit = rows.where(peak & F.col("lag").between(max(1, math.ceil(least_m / cell_m)), math.floor(most_m / cell_m)))
    return fit.groupBy("raster").agg(F.min(F.struct("lag", ((F.col("lag") + off) * cell_m).alias("spacing_m"), F.col("r").alias("correlation"))).alias("x")).select("raster", "x.spacing_m", "x.correlation")


def _running_median(height: np.ndarray, half: int) -> np.ndarray:
    wide = np.pad(height, half, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1), axis=1)


def tile_phases(pixels: DataFrame, geometry: DataFrame, cell_m: float, tile_m: float = TILE_ALONG_M, tile_rows: int = TILE_ROWS) -> DataFrame:
    """raster, strip, tile, phase (radians) and weight (0 where rows do not show) of every tile with pixels.

    The phase is that of a profile's component at the row spacing, after a running median is taken off: a
    median follows steps, so plot edges and alleys leave nothing behind.
    """
    cells = profiles(pixels, geometry.select("raster", "spacing_m", "direction_deg"), cell_m, tile_m)
    bins = F.greatest(F.lit(1), F.round(tile_rows * F.col("spacing_m") / cell_m).cast("int"))
    half = F.greatest(F.lit(1), F.floor(F.round(STEP_ROWS * F.col("spacing_m") / cell_m) / 2).cast("int"))
    cells = cells.withColumns({"bins": bins, "half": half, "own": F.floor(F.col("bin") / bins)})
    # a cell goes to its tile and to those whose halo it is in
    reach = F.ceil(F.col("half") / F.col("bins"))
    sent = cells.withColumn("tile", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    near = sent.where((F.col("bin") >= F.col("tile") * F.col("bins") - F.col("half")) & (F.col("bin") < (F.col("tile") + 1) * F.col("bins") + F.col("half")))

    def phase(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        raster, strip, tile = key
        part = part.sort_values("bin")
        width, reach, spacing, across0 = int(part.bins.iloc[0]), int(part.half.iloc[0]), part.spacing_m.iloc[0], part.across0.iloc[0]
        first, last = int(part.bin.iloc[0]), int(part.bin.iloc[-1])
        place = part.bin.to_numpy() - first
        known = np.full(last - first + 1, -1)
        known[place] = np.arange(len(part))
        mean = (part.s / part.n).to_numpy()
        # unknown places take the nearest known height, for the median only
        where = np.flatnonzero(known >= 0)
        every = np.arange(len(known))
        right = np.searchsorted(where, every).clip(0, len(where) - 1)
        left = (right - 1).clip(0)
        nearest = np.where(np.abs(where[right] - every) < np.abs(every - where[left]), where[right], where[left])
        filled = mean[known[nearest]]
        detail = filled - _running_median(filled, reach)
        detail[np.abs(detail) <= 1e-9 * np.abs(filled)] = 0  # rounding of flat ground shows no rows
        own = (part.bin >= tile * width) & (part.bin < (tile + 1) * width)
        n, d = part.n[own].to_numpy(), detail[place[own.to_numpy()]]
        z = (n * d * np.exp(2j * np.pi * (across0 + (part.bin[own].to_numpy() + 0.5) * cell_m) / spacing)).sum()
        strength = np.abs(z) / max(np.abs(n * d).sum(), 1e-12)
        shown = n.sum() >= LEAST_PIXELS * width * tile_m / cell_m and strength >= LEAST_COHERENCE
        return pd.DataFrame({"raster": [raster], "strip": [strip], "tile": [tile], "phase": [float(np.angle(z))], "weight": [float(strength * n.sum()) if shown else 0.0]}) if len(n) else pd.DataFrame({"raster": [], "strip": [], "tile": [], "phase": [], "weight": []})

    kind = pixels.schema["raster"].dataType.simpleString()
    return near.groupBy("raster", "strip", "tile").applyInPandas(phase, f"raster {kind}, strip long, tile long, phase double, weight double")


def unwrapped(tiles: DataFrame) -> DataFrame:
    """Shown tiles (weight above 0) with phases that do not jump: across each strip, then from strip to strip by the median step."""
    turn = 2 * math.pi
    turns = lambda x: F.bround(x / turn)
    shown = tiles.where("weight > 0")
    across = Window.partitionBy("raster", "strip").orderBy("tile")
    step = turns(F.col("phase") - F.lag("phase").over(across))
    flat = shown.withColumn("step", step).withColumn("phase", F.col("phase") - turn * F.coalesce(F.sum("step").over(across), F.lit(0.0))).drop("step")
    flat = materialize(flat)
    # a strip is laid beside the shown strip before it, over the tiles that both have (or, sharing none, over all)
    strips = flat.select("raster", "strip").distinct().withColumn("before", F.lag("strip").over(Window.partitionBy("raster").orderBy("strip")))
    own = flat.join(strips, ["raster", "strip"])
    prior = flat.select("raster", F.col("strip").alias("before"), "tile", F.col("phase").alias("was"))
    steps = own.join(prior, ["raster", "before", "tile"]).groupBy("raster", "strip").agg(F.percentile(F.col("phase") - F.col("was"), F.lit(0.5)).alias("m"))
    along = Window.partitionBy("raster").orderBy("strip")
    shift = strips.join(steps, ["raster", "strip"], "left").withColumn("k", F.coalesce(F.sum(turns(F.col("m"))).over(along), F.lit(0.0)))
    return flat.join(shift.select("raster", "strip", "k"), ["raster", "strip"]).withColumn("phase", F.col("phase") - turn * F.col("k")).drop("k")


def _plane(rows: DataFrame) -> DataFrame:
    """raster and a, b, c of the weighted least-squares plane z = a + b * tile + c * strip; flat in a direction without spread."""
    w, u, v, z = (F.col(c) for c in ("w", "tile", "strip", "z"))
    n = F.sum(w)
    mean = lambda x: F.sum(w * x) / n
    cov = lambda x, y: mean(x * y) - mean(x) * mean(y)
    sums = rows.where("w > 0").groupBy("raster").agg(mean(u).alias("mu"), mean(v).alias("mv"), mean(z).alias("mz"), cov(u, u).alias("uu"), cov(v, v).alias("vv"), cov(u, v).alias("uv"), cov(u, z).alias("uz"), cov(v, z).alias("vz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    full = det > 1e-9 * F.greatest(F.col("uu") * F.col("vv"), F.lit(1e-9))
    alone = lambda xx, xz: F.when(F.col(xx) > 1e-9, F.col(xz) / F.col(xx)).otherwise(0.0)
    b = F.when(full, (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det).otherwise(alone("uu", "uz"))
    c = F.when(full, (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det).otherwise(F.when(F.col("uu") > 1e-9, 0.0).otherwise(alone("vv", "vz")))
    return sums.withColumns({"b": b, "c": c}).select("raster", (F.col("mz") - F.col("b") * F.col("mu") - F.col("c") * F.col("mv")).alias("a"), "b", "c")


def phase_field(pixels: DataFrame, geometry: DataFrame, cell_m: float, tile_m: float = TILE_ALONG_M, tile_rows: int = TILE_ROWS, rounds: int = 3) -> DataFrame:
    """raster, strip, tile, offset_m (of a ridge, unwrapped) and tracked for each tile between a raster's ends.

    Single tiles are noisy. Kept is what rows do: a plane fitted to all tiles, of which those far off are left out
    in further rounds, and one median residual for each band of tiles along the rows. Where the rows wander
    by less than LEAST_DRIFT of a spacing about the straight comb of phase_m, that comb is given (tracked false);
    rasters without a tile that shows rows have none.
    """
    tiles = materialize(tile_phases(pixels, geometry, cell_m, tile_m, tile_rows))
    scale = F.col("spacing_m") / (2 * math.pi)
    shown = materialize(unwrapped(tiles).join(geometry.select("raster", "spacing_m", "phase_m"), "raster").select("raster", "strip", "tile", "spacing_m", "phase_m", F.col("weight").alias("w0"), F.col("weight").alias("w"), (F.col("phase") * scale).alias("z")))
    rows, plane = shown, None
    for turn in range(rounds):
        plane = _plane(rows)
        if turn + 1 == rounds:
            break
        off = shown.join(plane, "raster").withColumn("r", F.abs(F.col("z") - F.col("a") - F.col("b") * F.col("tile") - F.col("c") * F.col("strip")))
        off = materialize(off.select(*shown.columns, "r"))
        spread = exact_quantiles(off, ["raster"], "r", [0.5]).select("raster", (1.4826 * F.get("q", F.lit(0)) + 1e-6).alias("spread"))
        rows = materialize(off.join(spread, "raster").withColumn("w", F.when(F.col("r") <= 2.5 * F.col("spread"), F.col("w0")).otherwise(0.0)).select(*shown.columns))
    plane = materialize(plane)
    left = shown.join(plane, "raster").withColumn("r", F.col("z") - F.col("a") - F.col("b") * F.col("tile") - F.col("c") * F.col("strip"))
    bands = exact_quantiles(left, ["raster", "tile"], "r", [0.5]).join(left.groupBy("raster", "tile").agg(F.count("*").alias("k")), ["raster", "tile"])
    bands = materialize(bands.select("raster", "tile", F.when(F.col("k") >= 3, F.get("q", F.lit(0))).otherwise(0.0).alias("band")))
    ends = tiles.groupBy("raster").agg(F.max("strip").alias("strips"), F.max("tile").alias("tiles"))
    whole = ends.join(plane, "raster").join(geometry.select("raster", "spacing_m", "phase_m"), "raster").withColumn("strip", F.explode(F.sequence(F.lit(0), "strips"))).withColumn("tile", F.explode(F.sequence(F.lit(0), "tiles")))
    offset = F.col("a") + F.col("b") * F.col("tile") + F.col("c") * F.col("strip") + F.coalesce("band", F.lit(0.0))
    half = F.col("spacing_m") / 2
    model = materialize(whole.join(bands, ["raster", "tile"], "left").withColumn("offset_m", offset).withColumn("apart", F.abs(F.pmod(F.col("offset_m") - F.col("phase_m") + half, F.col("spacing_m")) - half)))
    drift = exact_quantiles(model, ["raster"], "apart", [0.9]).select("raster", F.get("q", F.lit(0)).alias("drift"))
    tracked = F.col("drift") >= LEAST_DRIFT * F.col("spacing_m")
    out = materialize(model.join(drift, "raster").select("raster", "strip", "tile", F.when(tracked, F.col("offset_m")).otherwise(F.col("phase_m")).alias("offset_m"), tracked.alias("tracked")))
    release(tiles, shown, plane, bands, model)
    return out


def _at(rows: DataFrame, field: DataFrame, across: Column, along: Column, cell_m: float, tile_m: float) -> DataFrame:
    """rows (with raster, spacing_m, across0, along0, strips, tiles, tile_w) with the field's offset, bilinear between tile middles."""
    clamp = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.col(most).cast("double")))
    placed = rows.withColumns({"fi": clamp((along - F.col("along0")) / tile_m - 0.5, "strips"), "fj": clamp((across - F.col("across0")) / F.col("tile_w") - 0.5, "tiles")})
    placed = placed.withColumns({"strip": F.floor("fi"), "tile": F.floor("fj")})
    got = placed.join(corners(field), ["raster", "strip", "tile"])
    i, j = F.col("fi") - F.col("strip"), F.col("fj") - F.col("tile")
    mean = (1 - i) * ((1 - j) * F.col("o00") + j * F.col("o01")) + i * ((1 - j) * F.col("o10") + j * F.col("o11"))
    return got.withColumn("offset", mean).select(*rows.columns, "offset")


def corners(field: DataFrame) -> DataFrame:
    """Each tile's offset and those of its neighbours after it, or its own at the ends."""
    after = lambda w, d: F.lead("offset_m", d).over(w)
    own = field.withColumn("right", after(Window.partitionBy("raster", "strip").orderBy("tile"), 1))
    down = own.select("raster", (F.col("strip") - 1).alias("strip"), "tile", F.col("offset_m").alias("d0"), F.col("right").alias("d1"))
    both = own.join(down, ["raster", "strip", "tile"], "left")
    o01 = F.coalesce("right", "offset_m")
    return both.select("raster", "strip", "tile", F.col("offset_m").alias("o00"), o01.alias("o01"), F.coalesce("d0", "offset_m").alias("o10"), F.coalesce("d1", "d0", o01).alias("o11"))


def clipped(shape: Column, halves: Column) -> Column:
    """A convex polygon (array of x, y) where a * x + b * y <= c for all halves (array of a, b, c): each edge gives its start, if inside, and where it crosses."""

    def cut(points: Column, h: Column) -> Column:
        side = lambda p: h["a"] * p["x"] + h["b"] * p["y"] - h["c"]

        def edge(p: Column, i: Column) -> Column:
            q = F.get(points, F.pmod(i + 1, F.size(points)))
            t = side(p) / (side(p) - side(q))
            cross = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            return F.array_compact(F.array(F.when(side(p) <= 0, p), F.when((side(p) <= 0) != (side(q) <= 0), cross)))

        return F.flatten(F.transform(points, edge))

    return F.aggregate(halves, shape, cut)


def area(shape: Column) -> Column:
    """Area of a polygon (array of x, y)."""
    n = F.size(shape)
    turns = F.transform(shape, lambda p, i: p["x"] * F.get(shape, F.pmod(i + 1, n))["y"] - F.get(shape, F.pmod(i + 1, n))["x"] * p["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x)) / 2


def segments(pixels: DataFrame, geometry: DataFrame, field: DataFrame, cell_m: float, segment_m: float = 2.0, width_m: float | None = None, tile_m: float = TILE_ALONG_M, tile_rows: int = TILE_ROWS) -> DataFrame:
    """raster, row_index, segment_index, centre_m (across the rows), start_m (along them), area_m2 and shape of row segments.

    Rows follow the field: a segment's middle is moved by the offset there, twice, as the offset changes slowly
    across the rows. Segments are clipped to the raster, and those with less than a fifth of their area in it go.
    """
    box = pixels.groupBy("raster").agg(((F.max("row") + 1) * cell_m).alias("y1"), ((F.max("col") + 1) * cell_m).alias("x1"))
    turn = F.radians("direction_deg")
    base = framed(pixels, geometry.select("raster", "direction_deg"), cell_m).groupBy("raster").agg(F.min("across").alias("across0"), F.min("along").alias("along0"))
    range_ = field.groupBy("raster").agg(F.min("offset_m").alias("lo"), F.max("offset_m").alias("hi"), F.max("strip").alias("strips"), F.max("tile").alias("tiles"))
    frame = box.join(geometry, "raster").join(base, "raster").join(range_, "raster").withColumns({"ux": F.cos(turn), "uy": F.sin(turn)})
    frame = frame.withColumn("tile_w", F.greatest(F.lit(1), F.round(tile_rows * F.col("spacing_m") / cell_m)) * cell_m)
    # the raster's corners in the frame of the rows
    ends = lambda x, y: F.array(F.lit(0.0), x, y, x + y)
    across, along = ends(-F.col("x1") * F.col("uy"), F.col("y1") * F.col("ux")), ends(F.col("x1") * F.col("ux"), F.col("y1") * F.col("uy"))
    first = F.floor((F.array_min(across) - F.col("hi")) / F.col("spacing_m"))
    last = F.ceil((F.array_max(across) - F.col("lo")) / F.col("spacing_m"))
    count = F.greatest(F.lit(1), F.floor((F.array_max(along) - F.array_min(along)) / segment_m))
    wide = frame.withColumns({"first": first, "k": F.sequence(first, last), "along_min": F.array_min(along), "segment_index": F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)})
    each = wide.withColumn("k", F.explode("k")).withColumn("segment_index", F.explode("segment_index")).withColumn("start_m", F.col("along_min") + F.col("segment_index") * segment_m)
    width = F.lit(width_m) if width_m else F.col("spacing_m")
    rows = each.withColumn("width", width).withColumn("centre_m", F.col("phase_m") + F.col("k") * F.col("spacing_m"))
    for _ in range(2):
        moved = _at(rows, field, F.col("centre_m"), F.col("start_m") + segment_m / 2, cell_m, tile_m)
        rows = moved.withColumn("centre_m", F.col("offset") + F.col("k") * F.col("spacing_m")).drop("offset")
    u, v = (F.col("ux"), F.col("uy")), (-F.col("uy"), F.col("ux"))
    corner = lambda s, d: F.struct((u[0] * s + v[0] * d).alias("x"), (u[1] * s + v[1] * d).alias("y"))
    s0, s1, d0, d1 = F.col("start_m"), F.col("start_m") + segment_m, F.col("centre_m") - F.col("width") / 2, F.col("centre_m") + F.col("width") / 2
    rows = rows.withColumn("shape", F.array(corner(s0, d0), corner(s1, d0), corner(s1, d1), corner(s0, d1)))
    half = lambda a, b, c: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c.alias("c"))
    inside = F.array(half(-1.0, 0.0, F.lit(0.0)), half(1.0, 0.0, F.col("x1")), half(0.0, -1.0, F.lit(0.0)), half(0.0, 1.0, F.col("y1")))
    rows = rows.withColumn("shape", clipped(F.col("shape"), inside))
    sized = rows.withColumn("area_m2", area(F.col("shape"))).where(F.col("area_m2") >= 0.2 * segment_m * F.col("width"))
    return sized.select("raster", (F.col("k") - F.col("first")).alias("row_index"), "segment_index", "centre_m", "start_m", "area_m2", "shape")
