"""Relief, patches, sharpness and discs over the test tables: embeddings are frames, parts cells of a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import ground as G
from tilth.operators import spatial
from tilth.sources.shared import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: A part is a cell: its size the column, its key modulo 40 the row; parts of one cell are averaged.
_CELLS = "c AS (SELECT p_partkey % 40 AS row, CAST(p_size AS BIGINT) AS col, round(avg(p_retailprice), 4) AS price FROM part GROUP BY 1, 2)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("row"), F.col("p_size").cast("long").alias("col")).agg(F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey, s_acctbal, (s_suppkey % 101) / 100.0 AS u, (s_suppkey % 67) / 66.0 AS v FROM supplier)
SELECT s_suppkey, CASE WHEN u > 2.0 / 3 THEN CASE WHEN v > 2.0 / 3 THEN 'north-east corner' WHEN v < 1.0 / 3 THEN 'south-east corner' ELSE 'east side' END
 WHEN u < 1.0 / 3 THEN CASE WHEN v > 2.0 / 3 THEN 'north-west corner' WHEN v < 1.0 / 3 THEN 'south-west corner' ELSE 'west side' END WHEN v > 2.0 / 3 THEN 'north side' WHEN v < 1.0 / 3 THEN 'south side' ELSE 'middle' END AS place FROM p""")
def place_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", G.place_word((k % 101) / 100.0, (k % 67) / 66.0).alias("place"))


@query("""WITH p AS (SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN cos(radians(c_nationkey * 7.3)) END AS ax, CASE WHEN c_nationkey % 3 > 0 THEN sin(radians(c_nationkey * 7.3)) END AS ay, c_acctbal / 1e7 AS gx, (c_custkey % 11 - 5) / 10000.0 AS gy,
 CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'FURNITURE' THEN 1.0 END AS sx, CASE c_mktsegment WHEN 'BUILDING' THEN 1.0 WHEN 'FURNITURE' THEN 0.0 END AS sy FROM customer),
q AS (SELECT *, sqrt(gx * gx + gy * gy) AS steep, ax * sx + ay * sy AS facing, ax * gx + ay * gy AS down FROM p)
SELECT c_custkey, round(CASE WHEN ax IS NULL THEN CASE WHEN sx IS NOT NULL THEN -sx WHEN steep * 100 >= 0.05 THEN -gx / steep END WHEN abs(facing) >= 0.5 THEN CASE WHEN facing < 0 THEN ax ELSE -ax END
 WHEN abs(down) * 100 >= 0.025 THEN CASE WHEN down > 0 THEN -ax ELSE ax END END, 6) + 0.0 AS x,
 CASE WHEN ax IS NULL THEN CASE WHEN sx IS NOT NULL THEN 'given' WHEN steep * 100 >= 0.05 THEN 'slope' END WHEN abs(facing) >= 0.5 THEN 'given' WHEN abs(down) * 100 >= 0.025 THEN 'slope' END AS basis FROM q""")
def flow_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's figures stand for a field's rows, slope and entry side."""
    c, n = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    t = F.radians(F.when(n % 3 > 0, n * 7.3))
    side = F.when(F.col("c_mktsegment") == "BUILDING", "N").when(F.col("c_mktsegment") == "FURNITURE", "E")
    f = G.flow_direction(F.cos(t), F.sin(t), F.col("c_acctbal") / 1e7, (F.col("c_custkey") % 11 - 5) / 10000.0, side)
    return c.select("c_custkey", f.alias("f")).select("c_custkey", (F.round("f.x", 6) + 0.0).alias("x"), F.col("f.basis").alias("basis"))


@query("""WITH p AS (SELECT p_brand, p_partkey, 0.6::DOUBLE * p_size + 0.8::DOUBLE * (p_partkey % 40) AS s, p_size BETWEEN 5 AND 45 AS corner FROM part), e AS (SELECT p_brand, min(s) AS lo, max(s) AS hi FROM p WHERE corner GROUP BY 1)
SELECT p_brand, p_partkey, round(least(greatest((s - lo) / greatest(hi - lo, 1e-9), 0.0), 1.0), 9) AS along FROM p JOIN e USING (p_brand)""")
def position_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places along a flow of (0.6, 0.8) between the parts of middling size."""
    points = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    got = G.position_along(points, points.where("x between 5 and 45"), ["p_brand"], F.lit(0.6), F.lit(0.8))
    return got.select("p_brand", "p_partkey", F.round("along", 9).alias("along"))


_PX = "px AS (SELECT label AS raster, CAST(vec_id AS BIGINT) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("raster"), F.col("vec_id").cast("long").alias("row"), F.posexplode("embedding").alias("col", "v")).select("raster", "row", F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))


@query(f"""WITH {_PX}, n AS (SELECT p.*, w.v AS w, e.v AS e, u.v AS u, d.v AS d FROM px p LEFT JOIN px w ON w.raster = p.raster AND w.row = p.row AND w.col = p.col - 1 LEFT JOIN px e ON e.raster = p.raster AND e.row = p.row AND e.col = p.col + 1
 LEFT JOIN px u ON u.raster = p.raster AND u.row = p.row - 1 AND u.col = p.col LEFT JOIN px d ON d.raster = p.raster AND d.row = p.row + 1 AND d.col = p.col)
SELECT raster, round(var_pop(coalesce(w, e) + coalesce(e, w) + coalesce(u, d) + coalesce(d, u) - 4 * v), 6) AS sharpness FROM n GROUP BY 1""")
def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sharpness(pixels(spark, sf_dir)).select("raster", F.round("sharpness", 6).alias("sharpness"))


@query("""WITH s AS (SELECT l_suppkey AS raster, round(var_pop(l_quantity), 6) AS sharpness FROM lineitem GROUP BY 1), c AS (SELECT greatest(quantile_cont(sharpness, 0.15), 20.0) AS cut FROM s) SELECT raster, sharpness FROM s, c WHERE sharpness >= cut""")
def sharp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames kept by the cut; the spread of a supplier's quantities stands for a frame's sharpness."""
    scores = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("raster")).agg(F.round(F.var_pop("l_quantity"), 6).alias("sharpness"))
    return G.sharp_frames(scores).select("raster", "sharpness")


@query(f"""WITH {_CELLS}, t AS (SELECT s_suppkey AS tree, s_suppkey % 40 AS row, s_suppkey * 7 % 50 + 1 AS col FROM supplier),
j AS (SELECT tree, price / 100 AS h, price % 10 AS green FROM t JOIN c ON pow(c.row - t.row, 2) + pow(c.col - t.col, 2) <= 9)
SELECT t.tree, round(coalesce(max(h), 0), 4) AS largest, round(coalesce(quantile_cont(h, 0.9), 0), 4) AS p90, round(coalesce(avg(CASE WHEN h > 9.5 THEN 1.0 ELSE 0.0 END), 0), 4) AS cover, round(coalesce(sum(h) FILTER (WHERE h > 9.5), 0) * 0.25, 3) AS volume,
 round(coalesce(avg(green) FILTER (WHERE h > 9.5), 0), 4) AS canopy_green FROM t LEFT JOIN j ON j.tree = t.tree GROUP BY t.tree""")
def disc_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    trees = table(spark, sf_dir, "supplier").select(k.alias("tree"), (k % 40).alias("row"), (k * 7 % 50 + 1).alias("col"))
    px = cells(spark, sf_dir).select("row", "col", (F.col("price") / 100).alias("h"), (F.col("price") % 10).alias("green"))
    got = G.disc_statistics(trees, px, 3, 9.5, 0.25)
    return got.select("tree", *(F.round(c, 4).alias(c) for c in ("largest", "p90", "cover")), F.round("volume", 3).alias("volume"), F.round("canopy_green", 4).alias("canopy_green"))


_PATCHES = f"""{_CELLS}, p AS (SELECT DISTINCT p_brand AS patch, p_partkey % 40 AS row, CAST(p_size AS BIGINT) AS col FROM part), s AS (SELECT (col // 10) AS spot, CASE WHEN (col // 10) % 2 = 0 THEN 'high' ELSE 'low' END AS kind, row, col FROM c WHERE price > 1000)"""


@query(f"""WITH {_PATCHES}, n AS (SELECT patch, count(*) AS n FROM p GROUP BY 1), m AS (SELECT patch, spot, kind, count(*) AS m FROM p JOIN s USING (row, col) GROUP BY ALL),
h AS (SELECT patch, arg_min(kind, spot) AS ground FROM m JOIN n USING (patch) WHERE m >= 0.3 * n GROUP BY 1) SELECT n.patch, ground FROM n LEFT JOIN h ON h.patch = n.patch""")
def patches_on_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are patches of cells; stripes of dear cells are spots."""
    patches = table(spark, sf_dir, "part").select(F.col("p_brand").alias("patch"), (F.col("p_partkey") % 40).alias("row"), F.col("p_size").cast("long").alias("col")).distinct()
    stripe = F.floor(F.col("col") / 10)
    spots = cells(spark, sf_dir).where("price > 1000").select(stripe.alias("spot"), F.when(stripe % 2 == 0, "high").otherwise("low").alias("kind"), "row", "col")
    return G.patches_on_spots(patches, spots)


@query(f"""WITH {_CELLS}, p AS (SELECT DISTINCT p_brand AS patch, p_partkey % 40 AS row, CAST(p_size AS BIGINT) AS col FROM part),
u AS (SELECT row * 10 + col // 5 AS unit, CASE row % 4 WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'STRESSED' WHEN 2 THEN 'DEAD' ELSE 'EDGE' END AS flag, row, col FROM c), x AS (SELECT DISTINCT patch, unit, flag FROM p JOIN u USING (row, col) WHERE flag <> 'EDGE'),
n AS (SELECT patch, count(*) AS n, count(*) FILTER (WHERE flag IN ('STRESSED', 'DEAD')) AS b FROM x GROUP BY 1)
SELECT DISTINCT p.patch, coalesce(n, 0) AS n_units, CASE WHEN n >= 4 THEN round(b / n, 3) END AS problem_share FROM p LEFT JOIN n ON n.patch = p.patch""")
def patches_on_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = table(spark, sf_dir, "part").select(F.col("p_brand").alias("patch"), (F.col("p_partkey") % 40).alias("row"), F.col("p_size").cast("long").alias("col")).distinct()
    flag = F.element_at(F.array(*map(F.lit, ("HEALTHY", "STRESSED", "DEAD", "EDGE"))), (F.col("row") % 4 + 1).cast("int"))
    units = cells(spark, sf_dir).select((F.col("row") * 10 + F.floor(F.col("col") / 5)).alias("unit"), flag.alias("flag"), "row", "col")
    return G.patches_on_units(patches, units)


@query(f"""WITH {_CELLS} SELECT col % 5 AS k, round(avg(CASE WHEN price / 100 - (8 + row / 20.0) > 1 THEN 1.0 ELSE 0.0 END), 6) AS share FROM c GROUP BY 1""")
def covered_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumn("k", F.col("col") % 5)
    first, below = c.select("k", "row", "col", (F.col("price") / 100).alias("v")), c.select("k", "row", "col", (8 + F.col("row") / 20.0).alias("v"))
    return G.covered_share(first, below, ["k"]).withColumn("share", F.round("share", 6))


@query()
def relief_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High and low patches of the frames' values, ten times as cm; tested against a plain labelling."""
    relief = pixels(spark, sf_dir).withColumn("v", F.col("v") * 100)
    return G.find_spots(relief, 1.0, 10.0, 3.0, 0.0)


@query()
def ground_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bowl or dome of prices over quantity and discount by return flag; tested against numpy."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_extendedprice") / 1e5).alias("z"))
    return G.curvature(rows, ["l_returnflag"], spatial.plane_sums(rows, ["l_returnflag"]).drop("n"))


@query()
def planting_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle and spacings of each brand's parts, from their nearest four; tested against a known grid."""
    points = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    near = spatial.nearest(points, ["p_brand"], 4, 4.0)
    at = lambda i, x, y: points.select("p_brand", F.col("id").alias(i), F.col("x").alias(x), F.col("y").alias(y))
    pairs = near.join(at("id", "x1", "y1").hint("merge"), ["p_brand", "id"]).join(at("other", "x2", "y2").hint("merge"), ["p_brand", "other"])
    return G.planting_grid(pairs.select("p_brand", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy")), ["p_brand"])
