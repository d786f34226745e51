"""Queries of rows and crowns on a field whose heights come from the orders: one cell each, 60 cells a row."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import camera, distances, rows, scales, watershed
from tilth.sources.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Cells in a raster's row, rows in a raster, metres of a cell, and the spacing of planted rows.
WIDE, LONG, CELL, SPACING = 60, 400, 0.1, 0.8


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    line = F.floor(key / WIDE)
    return table(spark, sf_dir, "orders").select(F.floor(line / LONG).alias("raster"), (line % LONG).alias("row"), (key % WIDE).cast("long").alias("col"), (F.col("o_totalprice") / 1e5).alias("price"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows along the raster's rows, which drift sideways and do not meet at 20 metres; prices roughen them."""
    y, x = (F.col("row") + 0.5) * CELL, (F.col("col") + 0.5) * CELL
    moved = 0.02 * x + F.when(y > 20, 0.3).otherwise(0.0)
    wave = F.cos((y - moved) * (2 * math.pi / SPACING))
    return _cells(spark, sf_dir).select("raster", "row", "col", (0.6 + 0.5 * wave + 0.02 * F.col("price")).alias("v"))


def geometry(pixels: DataFrame) -> DataFrame:
    return pixels.select("raster").distinct().withColumns({"spacing_m": F.lit(SPACING), "direction_deg": F.lit(0.0), "phase_m": F.lit(0.0)})


@query()
def row_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = heights(spark, sf_dir)
    return rows.repeat_spacing(pixels, geometry(pixels), CELL)


@query()
def row_phase_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = heights(spark, sf_dir)
    return rows.phase_field(pixels, geometry(pixels), CELL, tile_rows=2)


@query()
def row_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = heights(spark, sf_dir)
    known = geometry(pixels)
    found = rows.segments(pixels, known, rows.phase_field(pixels, known, CELL, tile_rows=2), CELL, tile_rows=2)
    return found.select("raster", "row_index", "segment_index", F.round("centre_m", 6).alias("centre_m"), F.round("start_m", 6).alias("start_m"), F.round("area_m2", 6).alias("area_m2"), F.size("shape").alias("corners"))


@query()
def watershed_crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowns of the smoothed prices."""
    field = _cells(spark, sf_dir).select("raster", "row", "col", F.col("price").alias("v"))
    return watershed.tree_crowns(field, CELL, least_m=2.3, apart_m=0.4)


@query(f"""WITH c AS (SELECT o_orderkey // {WIDE * LONG} AS raster, o_orderkey // {WIDE} % {LONG} AS row, o_orderkey % {WIDE} AS col, o_totalprice > 450000 AS hit FROM orders)
SELECT a.raster, a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col))::DOUBLE AS d2
FROM c a LEFT JOIN c b ON a.raster = b.raster AND b.hit GROUP BY ALL""")
def distance_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distance of each order's cell to the nearest of a high price."""
    return distances.distance(_cells(spark, sf_dir), F.col("price") > 4.5)


@query()
def traced_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of class 1 in a map of blocks of 25 by 20 cells of 30 metres, in which orders of a small price are of another class."""
    block = (F.floor(F.col("row") / 25) + F.floor(F.col("col") / 20)) % 2
    classes = _cells(spark, sf_dir).select("raster", "row", "col", F.when(F.col("price") < 0.015, 5).when(block == 0, 1).otherwise(2).alias("v"))
    got = distances.traced_fields(classes, [1], 30.0)
    return got.select("raster", "block", "label", *(F.round(c, 6).alias(c) for c in ("acres", "purity", "boxiness", "row", "col", "score")))


#: Vectors as frames of 8 by 8 pixels, one every two seconds, from a camera that is warmer below and to the right.
_FRAMES = """f AS (SELECT vec_id AS frame, 2.0 * vec_id AS seconds, i // 8 AS row, i % 8 AS col, 20.0 + x + (i // 8) * 0.125 + (i % 8) * (i % 8) * 0.0625 AS v
 FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    row, col = F.floor(F.col("i") / 8), F.col("i") % 8
    v = 20.0 + F.col("x").cast("double") + row * 0.125 + col * col * 0.0625
    return rows_.select(F.col("vec_id").alias("frame"), (2.0 * F.col("vec_id")).alias("seconds"), row.cast("long").alias("row"), col.cast("long").alias("col"), v.alias("v"))


@query(f"""WITH {_FRAMES}, s AS (SELECT *, floor(seconds / 300.0) AS slot, v - median(v) OVER (PARTITION BY frame) AS x FROM f), n AS (SELECT slot FROM s GROUP BY slot HAVING count(DISTINCT frame) >= 20),
p AS (SELECT slot, row, col, median(x) AS p FROM s JOIN n USING (slot) GROUP BY ALL), d AS (SELECT slot, row, median(p) AS down FROM p GROUP BY ALL),
a AS (SELECT slot, col, median(p - down) AS across FROM p JOIN d USING (slot, row) GROUP BY ALL)
SELECT frame, row, col, round(v - coalesce(down + across, 0), 6) AS v, round(coalesce(down + across, 0), 6) AS pattern FROM s LEFT JOIN d USING (slot, row) LEFT JOIN a USING (slot, col)""")
def camera_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = camera.camera_pattern(frames(spark, sf_dir))
    return got.select("frame", "row", "col", F.round("v", 6).alias("v"), F.round("pattern", 6).alias("pattern"))


@query(f"""WITH {_FRAMES}, l AS (SELECT *, v < 21.5 AS leaf, floor(seconds / 300.0) AS slot FROM f), m AS (SELECT frame, median(v) AS middle FROM l WHERE leaf GROUP BY frame HAVING count(*) >= 20),
u AS (SELECT l.*, v - middle AS x FROM l JOIN m USING (frame)), n AS (SELECT slot, median(seconds) AS moment FROM (SELECT DISTINCT slot, frame, seconds FROM u) GROUP BY slot HAVING count(*) >= 3),
b AS (SELECT slot, frame, 'row' AS axis, row AS place, coalesce(avg(x) FILTER (WHERE leaf), 0) AS m FROM u GROUP BY ALL UNION ALL SELECT slot, frame, 'col', col, coalesce(avg(x) FILTER (WHERE leaf), 0) FROM u GROUP BY ALL),
c AS (SELECT slot, axis, place, avg(m) AS m FROM b GROUP BY ALL),
s AS (SELECT c.slot, c.axis, c.place, avg(e.m) AS s FROM c, unnest([-1, 0, 1]) AS o(o) JOIN c e ON e.slot = c.slot AND e.axis = c.axis AND e.place = least(greatest(c.place + o, 0), 7) GROUP BY ALL)
SELECT slot, moment AS seconds, axis, place, round(s - median(s) OVER (PARTITION BY slot, axis), 6) AS value FROM s JOIN n USING (slot)""")
def flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = frames(spark, sf_dir).withColumn("leaf", F.col("v") < 21.5)
    got = camera.flat_field(rows_, smooth_px=3, least_leaf=20)
    return got.select(F.col("slot").cast("double").alias("slot"), "seconds", "axis", "place", F.round("value", 6).alias("value"))


@query(f"""WITH c AS (SELECT o_orderkey // {WIDE * LONG} AS raster, o_orderkey // {WIDE} % {LONG} AS row, o_orderkey % {WIDE} AS col, o_totalprice / 1e5 AS v FROM orders),
o AS (SELECT a, b FROM range(-8, 9) x(a), range(-8, 9) y(b)),
s AS (SELECT raster, row + a AS row, col + b AS col, v, exp(-(a * a + b * b) / 8.0) AS w2, CASE WHEN abs(a) <= 4 AND abs(b) <= 4 THEN exp(-(a * a + b * b) / 2.0) ELSE 0 END AS w1 FROM c, o),
g AS (SELECT raster, row, col, sum(v * w1) / sum(w1) AS fine, sum(v * w2) / sum(w2) AS coarse FROM s SEMI JOIN c USING (raster, row, col) GROUP BY ALL)
SELECT raster, row, col, round(fine, 6) AS fine, round(coarse, 6) AS coarse, round(fine - coarse, 6) AS band FROM g""")
def price_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices smoothed by one and by two cells, and what lies between the two, on blocks of 32 cells."""
    got = scales.levels(_cells(spark, sf_dir).withColumnRenamed("price", "v"), [1.0, 2.0], block=32)
    fine, coarse = F.get("levels", F.lit(0)), F.get("levels", F.lit(1))
    return got.select("raster", "row", "col", F.round(fine, 6).alias("fine"), F.round(coarse, 6).alias("coarse"), F.round(fine - coarse, 6).alias("band"))


@query(f"""WITH {_FRAMES}, p AS (SELECT *, unnest(range(CASE WHEN row = 7 THEN 2 ELSE 1 END * CASE WHEN col = 7 THEN 2 ELSE 1 END)) AS copy FROM f),
b AS (SELECT frame, row // 3 AS i, col // 3 AS j, quantile_cont(v, 0.75) AS g FROM p GROUP BY ALL),
u AS (SELECT frame, row, col, v, least(greatest((row + 0.5) / 3 - 0.5, 0), 2) AS y, least(greatest((col + 0.5) / 3 - 0.5, 0), 2) AS x FROM f),
m AS (SELECT u.frame, row, col, any_value(v) AS v, sum(g * (1 - abs(y - i)) * (1 - abs(x - j))) AS ground FROM u JOIN b ON u.frame = b.frame AND abs(y - i) < 1 AND abs(x - j) < 1 GROUP BY ALL)
SELECT frame, row, col, round(ground, 6) AS ground, ground - v >= 1 AS leaf FROM m""")
def frame_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of each frame that are a degree colder than the ground around them, by blocks of three pixels."""
    cells = frames(spark, sf_dir).withColumnRenamed("frame", "raster")
    got = scales.leaves(cells, 1.0, 3.0, 1.0)
    return got.select(F.col("raster").alias("frame"), "row", "col", F.round("ground", 6).alias("ground"), "leaf")
