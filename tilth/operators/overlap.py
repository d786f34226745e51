"""Polygons against pixels, points and one another, on cells: exact on the grid, whatever the shapes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilth.functions.geo import in_ring
from tilth.operators.quantiles import beside
from tilth.sources.shared import materialize

#: Ids of a box that are sent as one list (about), and pairs of ids (met by cells, alike or not) that are work for a task.
LISTED, MET = 64, 1 << 24
#: Groups that the lists of a cell are dealt in at most, and tasks of pairs at most.
MOST_GROUPS, MOST_TASKS = 32, 4096


def cells_of(shapes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Cells (i, j) whose centre is inside each shape (ring); a shape without any takes its middle cell."""
    box = shapes.select(*keys, "ring", *(F.expr(f"{f}(transform(ring, p -> p.{c}))").alias(f"{n}_{c}") for c in "xy" for f, n in (("array_min", "lo"), ("array_max", "hi"))))
    line = lambda c: F.sequence(F.floor(F.col(f"lo_{c}") / cell), F.floor(F.col(f"hi_{c}") / cell))
    grid = box.withColumn("i", F.explode(line("x"))).withColumn("j", F.explode(line("y")))
    inside = in_ring((F.col("i") + 0.5) * cell, (F.col("j") + 0.5) * cell, F.col("ring"))
    hit = grid.where(inside).select(*keys, "i", "j")
    middle = box.join(hit.select(*keys).distinct(), keys, "left_anti").select(*keys, F.floor((F.col("lo_x") + F.col("hi_x")) / 2 / cell).alias("i"), F.floor((F.col("lo_y") + F.col("hi_y")) / 2 / cell).alias("j"))
    return hit.unionByName(middle)


def label_points(points: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """The last shape (by unit) that holds each point: candidates by cell of the shape's box, then exact."""
    box = shapes.select("unit", "ring", *(F.expr(f"{f}(transform(ring, p -> p.{c}))").alias(f"{n}_{c}") for c in "xy" for f, n in (("array_min", "lo"), ("array_max", "hi"))))
    line = lambda c: F.sequence(F.floor(F.col(f"lo_{c}") / cell), F.floor(F.col(f"hi_{c}") / cell))
    spread = box.withColumn("i", F.explode(line("x"))).withColumn("j", F.explode(line("y"))).select("unit", "ring", "i", "j")
    placed = points.withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell))
    found = placed.join(spread, ["i", "j"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).groupBy("id").agg(F.max("unit").alias("unit"))
    return points.join(found, "id", "left")


def overlap_shares(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Shares of each left shape (a) that right shapes (b) cover."""
    a, b = cells_of(left, ["a"], cell), cells_of(right, ["b"], cell)
    size = a.groupBy("a").agg(F.count("*").alias("n"))
    shared = a.join(b, ["i", "j"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.join(size, "a").select("a", "b", (F.col("shared") / F.col("n")).alias("share"))


def assign_blocks(units: DataFrame, blocks: DataFrame, cell: float, least: float = 0.1) -> DataFrame:
    """Pieces of units in blocks, those under `least` dropped; the names of split units get their block."""
    pieces = overlap_shares(units, blocks, cell).where(F.col("share") >= least)
    n = F.count("*").over(Window.partitionBy("a"))
    return pieces.select(F.when(n > 1, F.concat_ws("@", F.col("a").cast("string"), F.col("b").cast("string"))).otherwise(F.col("a").cast("string")).alias("unit"), "a", "b", "share")


def resample(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bilinear values of a raster (row, col, v) at target points (id, y, x in its cells); unknown neighbours are left out."""
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)))
    r, c = F.floor(F.col("y") - 0.5), F.floor(F.col("x") - 0.5)
    near = target.select("id", (F.col("y") - 0.5 - r).alias("fy"), (F.col("x") - 0.5 - c).alias("fx"), r.alias("r"), c.alias("c"), F.explode(corners).alias("k"))
    w = F.when(F.col("k.a") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("k.b") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    rows = near.select("id", (F.col("r") + F.col("k.a")).alias("row"), (F.col("c") + F.col("k.b")).alias("col"), w.alias("w"))
    got = rows.join(source.where("v is not null").select("row", "col", "v"), ["row", "col"]).groupBy("id").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("v"))
    return target.join(got, "id", "left")


def box_pairs(boxes: DataFrame, cell: float, least: float, digits: int | None = None) -> DataFrame:
    """Pairs of boxes (id, x0, y0, x1, y1) whose overlap is at least a share of the smaller; meeting by cells.

    Equal boxes are one shape, whose ids go about in lists: lists meet, and pairs of ids are told only as they are read, so
    that they are never shuffled. The share is rounded to digits, if any, once for two lists.
    """
    corners = ["x0", "y0", "x1", "y1"]
    boxes = boxes.where("id is not null and x1 > x0 and y1 > y0").select("id", *corners)
    lists = boxes.groupBy(*corners).agg(F.ceil(F.count("*") / LISTED).alias("lists"))
    dealt = beside(boxes, lists, corners).withColumn("part", F.pmod(F.xxhash64("id"), "lists"))
    shapes = materialize(dealt.groupBy(*corners, "part").agg(F.collect_list("id").alias("ids")).drop("part").withColumn("list", F.monotonically_increasing_id()))
    line = lambda c: F.sequence(F.floor(F.col(f"{c}0") / cell), F.floor(F.col(f"{c}1") / cell))
    spread = shapes.withColumn("i", F.explode(line("x"))).withColumn("j", F.explode(line("y")))
    # the lists of a cell are dealt in groups, and two groups are one key: a full cell is work for many tasks
    met = spread.groupBy("i", "j").agg(F.pow(F.sum(F.size("ids")), F.lit(2.0)).alias("met")).agg(F.max("met"), F.sum("met")).first()
    groups = min(max(math.ceil(math.sqrt((met[0] or 0) / (4 * MET))), 1), MOST_GROUPS)
    tasks = min(1 + math.ceil((met[1] or 0) / (2 * MET)), MOST_TASKS)
    keys, own = ["i", "j", "g", "h"], F.pmod(F.xxhash64("list"), F.lit(groups))
    left = spread.withColumn("g", own).withColumn("h", F.explode(F.sequence("g", F.lit(groups - 1).cast("long"))))
    right = spread.withColumn("h", own).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), "h")))
    other = right.select(*keys, *(F.col(c).alias(f"o_{c}") for c in ("list", *corners, "ids")))
    # a number of tasks that is told is kept: by their bytes lists would be few tasks
    both = left.repartition(tasks, *keys).join(other.repartition(tasks, *keys).hint("merge"), keys)
    # a pair of lists meets in the cell of its overlap's low corner only
    low = lambda c: F.floor(F.greatest(f"{c}0", f"o_{c}0") / cell)
    pairs = both.where(((F.col("g") < F.col("h")) | (F.col("list") <= F.col("o_list"))) & (F.col("i") == low("x")) & (F.col("j") == low("y")))
    wide = F.least("x1", "o_x1") - F.greatest("x0", "o_x0")
    high = F.least("y1", "o_y1") - F.greatest("y0", "o_y0")
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    share = wide * high / F.least(area(""), area("o_"))
    alike = pairs.where((wide > 0) & (high > 0) & (share >= least)).withColumn("share", share if digits is None else F.round(share, digits))
    ids = alike.select("list", "o_list", "share", "o_ids", F.explode("ids").alias("id")).select("list", "o_list", "share", "id", F.explode("o_ids").alias("o_id"))
    # within one list each pair comes in both orders
    return ids.where((F.col("id") < F.col("o_id")) | ((F.col("id") > F.col("o_id")) & (F.col("list") != F.col("o_list")))).select(F.least("id", "o_id").alias("id"), F.greatest("id", "o_id").alias("other"), "share")
