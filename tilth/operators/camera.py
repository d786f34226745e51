"""What a camera adds to each of its frames, from pixel tables (frame, row, col, v) with the frames' seconds.

Crop and ground move through the picture while the camera's own pattern stays, so over many frames a place of the
picture tells the camera. Patterns are a profile down and one across the picture; per slice of time they are
medians of medians (camera_pattern) or smoothed means over leaves (flat_field), in grouped aggregates by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.operators.quantiles import exact_quantiles
from tilth.sources.shared import materialize

#: Frames that a slice of time needs for a pattern, its seconds, and the same for flat fields (fixed values).
LEAST_FRAMES, SLICE_S, LEAST_FLAT, FLAT_S, LEAST_LEAF = 20, 300.0, 3, 300.0, 500


def _median(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(rows, keys, value, [0.5]).select(*keys, F.get("q", F.lit(0)).alias(name))


def camera_pattern(pixels: DataFrame, slice_s: float = SLICE_S, least: int = LEAST_FRAMES) -> DataFrame:
    """frame, row, col, v without the camera's pattern, and pattern, for pixels (frame, seconds, row, col, v).

    Frames of a slice of time lose its pattern: of each place's median over the frames (less each frame's own median)
    the median down the picture by row, and of what is left across it by column. Slices of fewer than
    `least` frames, and frames that are not of the commonest size, are left as they are.
    """
    pixels = pixels.withColumn("slot", F.floor(F.col("seconds") / slice_s))
    frames = materialize(pixels.groupBy("frame", "slot").agg(F.max("row").alias("rows"), F.max("col").alias("cols")))
    size = frames.groupBy("rows", "cols").agg(F.count("*").alias("n")).agg(F.max_by(F.struct("rows", "cols"), F.struct("n", "rows", "cols")).alias("s"))
    usual = frames.join(size, (F.col("rows") == F.col("s.rows")) & (F.col("cols") == F.col("s.cols"))).select("frame", "slot")
    enough = usual.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("slot")
    member = materialize(usual.join(enough, "slot"))
    rows = pixels.join(member, ["frame", "slot"])
    middle = _median(rows, ["frame"], "v", "middle")
    places = materialize(_median(rows.join(middle, "frame").withColumn("x", F.col("v") - F.col("middle")), ["slot", "row", "col"], "x", "p"))
    down = materialize(_median(places, ["slot", "row"], "p", "down"))
    across = materialize(_median(places.join(down, ["slot", "row"]).withColumn("x", F.col("p") - F.col("down")), ["slot", "col"], "x", "across"))
    marked = pixels.join(member.withColumn("in_slice", F.lit(True)), ["frame", "slot"], "left").join(down, ["slot", "row"], "left").join(across, ["slot", "col"], "left")
    pattern = F.when(F.col("in_slice"), F.coalesce(F.col("down") + F.col("across"), F.lit(0.0))).otherwise(0.0)
    return marked.select("frame", "row", "col", (F.col("v") - pattern).alias("v"), pattern.alias("pattern"))


def _profile(rows: DataFrame, axis: str, window: int) -> DataFrame:
    """slot, axis and the smoothed profile of the residuals' means, less its own median; every place of the picture has a value."""
    by_frame = rows.groupBy("slot", "frame", axis).agg(F.avg(F.when(F.col("leaf"), F.col("x"))).alias("m"))
    mean = by_frame.groupBy("slot", axis).agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("m"))
    # a moving average whose ends repeat: places beyond an end count as the end's
    half = window // 2
    order = Window.partitionBy("slot").orderBy(axis)
    whole = Window.partitionBy("slot")
    near = order.rowsBetween(-half, half)
    ends = mean.withColumns({"k": F.row_number().over(order), "n": F.count("*").over(whole), "first": F.first("m").over(order), "last": F.last("m").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "sum": F.sum("m").over(near)})
    before, after = F.greatest(F.lit(0), half - F.col("k") + 1), F.greatest(F.lit(0), F.col("k") + half - F.col("n"))
    smooth = ends.withColumn("s", (F.col("sum") + before * F.col("first") + after * F.col("last")) / (2 * half + 1))
    middle = _median(smooth, ["slot"], "s", "middle")
    return smooth.join(middle, "slot").select("slot", axis, (F.col("s") - F.col("middle")).alias("s"))


def flat_field(pixels: DataFrame, slice_s: float = FLAT_S, smooth_px: int = 9, least_leaf: int = LEAST_LEAF, least: int = LEAST_FLAT) -> DataFrame:
    """slot, seconds (the median of its frames), axis ('row' or 'col'), place and value of the camera's uneven view.

    pixels are (frame, seconds, row, col, v, leaf). Each frame's leaves are compared with their median, and the
    differences averaged along rows and columns over the frames of a slice of time; places of a frame without
    leaves count as no difference. Frames of fewer than least_leaf leaf pixels and slices of fewer than `least` frames
    take no part.
    """
    leaves = pixels.where(F.col("leaf") & F.col("v").isNotNull())
    known = leaves.groupBy("frame").agg(F.count("*").alias("n")).where(F.col("n") >= least_leaf)
    middle = _median(leaves.join(known, "frame", "left_semi"), ["frame"], "v", "middle")
    used = materialize(pixels.join(middle, "frame").select("frame", "seconds", "row", "col", F.floor(F.col("seconds") / slice_s).alias("slot"), (F.col("leaf") & F.col("v").isNotNull()).alias("leaf"), (F.col("v") - F.col("middle")).alias("x")))
    slots = used.select("slot", "frame", "seconds").distinct()
    enough = slots.groupBy("slot").agg(F.count("*").alias("n"), F.percentile("seconds", F.lit(0.5)).alias("seconds")).where(F.col("n") >= least).select("slot", "seconds")
    rows = used.drop("seconds").join(enough.select("slot"), "slot", "left_semi")
    window = max(1, smooth_px | 1)
    both = [_profile(rows, axis, window).select("slot", F.lit(axis).alias("axis"), F.col(axis).alias("place"), F.col("s").alias("value")) for axis in ("row", "col")]
    return both[0].union(both[1]).join(enough, "slot").select("slot", "seconds", "axis", "place", "value")


def flattened(pixels: DataFrame, field: DataFrame) -> DataFrame:
    """frame, row, col, v less a flat_field() at each frame's second, linear between slices and constant beyond them; v as it is where a field has no slice.

    The slices before and after a frame are found once a frame, by a window over slices and frames in order of time.
    """
    slots = field.select("slot", "seconds").distinct().select(F.lit(None).cast("long").alias("frame"), "seconds", "slot")
    frames = pixels.select("frame", "seconds").distinct().select(F.col("frame").cast("long").alias("frame"), "seconds", F.lit(None).cast("long").alias("slot"))
    order = Window.orderBy("seconds", F.col("slot").isNull())  # one row a frame and slice, not pixels
    mark = F.when(F.col("slot").isNotNull(), F.struct("slot", "seconds"))
    timed = slots.unionByName(frames)
    timed = timed.withColumn("a", F.last(mark, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("z", F.first(mark, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where("frame is not null")
    a, z = F.coalesce("a", "z"), F.coalesce("z", "a")
    share = F.coalesce(F.try_divide(F.col("seconds") - a["seconds"], z["seconds"] - a["seconds"]), F.lit(0.0))
    timed = timed.select("frame", a["slot"].alias("sa"), z["slot"].alias("sz"), F.greatest(F.lit(0.0), share).alias("t"))
    out = pixels.join(timed, "frame")
    total = F.lit(0.0)
    for axis in ("row", "col"):
        for side, w in (("sa", 1 - F.col("t")), ("sz", F.col("t"))):
            name = f"{axis}_{side}"
            out = out.join(field.where(F.col("axis") == axis).select(F.col("slot").alias(side), F.col("place").alias(axis), F.col("value").alias(name)), [side, axis], "left")
            total = total + w * F.coalesce(name, F.lit(0.0))
    return out.select("frame", "row", "col", (F.col("v") - total).alias("v"))
