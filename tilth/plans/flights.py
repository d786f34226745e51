"""Flights, squares, overlaps, verdict rules and nets over the test tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions import verdicts as V
from tilth.operators import flight, nets, overlap, positions
from tilth.plans.field import _PIX, pixels
from tilth.sources.shared import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH p AS (SELECT user_id AS flight, event_id, ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE -98 + value / 100 END AS lon, CASE WHEN event_id % 9 = 0 THEN NULL ELSE 26 + (event_id % 100) / 100.0 END AS lat, 30 + value / 10 AS alt FROM events),
l AS (SELECT *, 2 * 6371000 * asin(sqrt(least(pow(sin(radians(lat - lag(lat) OVER w) / 2), 2) + cos(radians(lag(lat) OVER w)) * cos(radians(lat)) * pow(sin(radians(lon - lag(lon) OVER w) / 2), 2), 1))) AS step FROM p WINDOW w AS (PARTITION BY flight ORDER BY ts, event_id))
SELECT flight, count(*) AS n_images, count(lon) AS n_gps, round(min(lon), 6) AS west, round(max(lat), 6) AS north, round(avg(step), 3) AS mean_step, round(quantile_cont(step, 0.5), 3) AS median_step, round((max(alt) - min(alt)) / abs(avg(alt)), 6) AS altitude_spread FROM l GROUP BY flight""")
def flight_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    shots = table(spark, sf_dir, "events").select(F.col("user_id").alias("flight"), i.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.when(i % 9 != 0, F.col("value") / 100 - 98).alias("lon"), F.when(i % 9 != 0, F.lit(26) + (i % 100) / 100.0).alias("lat"), (F.lit(30) + F.col("value") / 10).alias("alt"))
    out = flight.survey(shots, ["flight"])
    return out.select("flight", "n_images", "n_gps", *(F.round(c, d).alias(c) for c, d in (("west", 6), ("north", 6), ("mean_step", 3), ("median_step", 3), ("altitude_spread", 6))))


@query(f"""WITH {_PIX}, sq AS (SELECT raster, row // 8 AS row, col // 8 AS col, count(v) / 64 AS covered, avg(CAST(v > 0.05 AS INTEGER)) AS leaf, avg(v) FILTER (WHERE v > 0.05) AS green FROM px GROUP BY 1, 2, 3), ok AS (SELECT * FROM sq WHERE covered >= 0.5),
m AS (SELECT raster, quantile_cont(leaf, 0.5) AS ml, quantile_cont(green, 0.5) AS mg FROM ok GROUP BY 1), d AS (SELECT raster, quantile_cont(abs(green - mg), 0.5) * 1.4826 AS mad FROM ok JOIN m USING (raster) GROUP BY 1)
SELECT raster, row, col, round(leaf, 6) AS leaf, CASE WHEN leaf < 0.25 * ml THEN 'MISSING' WHEN leaf < 0.6 * ml THEN 'WEAK' WHEN green < mg - 3 * mad THEN 'PALE' ELSE 'OK' END AS flag FROM ok JOIN m USING (raster) JOIN d USING (raster)""")
def colour_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight.colour_squares(pixels(spark, sf_dir).withColumnRenamed("v", "exg"), 8, 0.05).select("raster", "row", "col", F.round("leaf", 6).alias("leaf"), "flag")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS row, CAST(l_quantity AS DOUBLE) AS along FROM lineitem), s AS (SELECT *, lead(along) OVER (PARTITION BY row ORDER BY along) - along AS step FROM p),
u AS (SELECT row, quantile_cont(step, 0.5) AS usual FROM s GROUP BY 1 HAVING count(*) >= 10), g AS (SELECT row, along, step, CAST(round(step / usual) - 1 AS INTEGER) AS missing FROM s JOIN u USING (row) WHERE usual > 0)
SELECT row, round(along + step * i / (missing + 1), 6) AS at FROM g, unnest(range(1, missing + 1)) AS t(i) WHERE missing BETWEEN 1 AND 3""")
def row_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items; parts are rows, as suppliers would have every quantity."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("row"), F.col("l_quantity").alias("along")).distinct()
    return flight.row_gaps(rows, ["row"]).withColumn("at", F.round("at", 6))


@query("""WITH p AS (SELECT p_brand, p_partkey AS id, p_size + (p_partkey % 10) / 10.0 AS across FROM part), n AS (SELECT *, CASE WHEN across - lag(across) OVER (PARTITION BY p_brand ORDER BY across, id) <= 1.0 THEN 0 ELSE 1 END AS new FROM p)
SELECT p_brand, id, CAST(sum(new) OVER (PARTITION BY p_brand ORDER BY across, id) AS BIGINT) AS row FROM n""")
def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_size") + (F.col("p_partkey") % 10) / 10.0).alias("across"))
    return flight.row_labels(rows, ["p_brand"], 1.0).select("p_brand", "id", "row")


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 4 <> 0 AS sat, s_suppkey % 3 <> 0 AS drone, s_acctbal > 5000 AS alarm, (s_suppkey % 50) / 100.0 AS share FROM supplier)
SELECT s_suppkey, CASE WHEN NOT sat AND NOT drone THEN 'no data' WHEN NOT drone THEN CASE WHEN alarm THEN 'satellite only: fly it' ELSE 'satellite only' END WHEN NOT sat THEN 'drone only' WHEN alarm AND share >= 0.15 THEN 'both see trouble' WHEN alarm THEN 'satellite alone sees trouble' WHEN share >= 0.15 THEN 'drone alone sees trouble' ELSE 'both see none' END AS verdict,
 CASE WHEN s_suppkey <= 100 THEN 4 WHEN s_suppkey <= 250 THEN 8 WHEN s_suppkey <= 500 THEN 16 WHEN s_suppkey <= 1500 THEN 32 ELSE 64 END AS memory_gb FROM s""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", V.agreement(k % 4 != 0, k % 3 != 0, F.col("s_acctbal") > 5000, (k % 50) / 100.0, 0.15).alias("verdict"), V.memory_needed(k).alias("memory_gb"))


@query("""WITH o AS (SELECT c_custkey, count(o_orderkey) AS n, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS g, avg(o_totalprice) / 500000 AS ov, stddev_pop(o_totalprice) / 1000000 AS alt FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT c_custkey, concat_ws('; ', CASE WHEN n < 12 THEN 'only ' || n || ' images' END, CASE WHEN g < n THEN (n - g) || ' images without position' END, CASE WHEN ov IS NULL THEN 'overlap unknown' WHEN ov < 0.7 THEN 'too little overlap' END, CASE WHEN alt > 0.15 THEN 'uneven altitude' END) AS warnings FROM o""")
def survey_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("g"), (F.avg("o_totalprice") / 500000).alias("ov"), (F.stddev_pop("o_totalprice") / 1000000).alias("alt"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").na.fill(0, ["n", "g"])
    return rows.select("c_custkey", F.array_join(V.survey_warnings(F.col("n"), F.col("g"), F.col("ov"), F.col("alt")), "; ").alias("warnings"))


@query("""WITH e AS (SELECT event_id, value / 20 AS above, value * 5 AS area, value / 200 AS compact, (['high', 'low', 'level', NULL])[event_id % 4 + 1] AS ground, CASE WHEN event_id % 5 > 0 THEN event_id % 7 END AS days, CASE WHEN event_id % 3 > 0 THEN value / 100 END AS problem FROM events),
p AS (SELECT event_id, CASE WHEN above >= 3 THEN 2 WHEN above >= 2 THEN 1 ELSE -1 END + CASE WHEN area >= 200 THEN 1 ELSE 0 END + CASE WHEN compact >= 0.35 THEN 1 WHEN compact <= 0.15 THEN -1 ELSE 0 END + CASE ground WHEN 'high' THEN -2 WHEN 'low' THEN -1 WHEN 'level' THEN 2 ELSE 0 END + CASE WHEN days IS NULL THEN 0 WHEN days >= 3 THEN 2 ELSE -2 END + CASE WHEN problem IS NULL THEN 0 WHEN problem > greatest(0.1::DOUBLE, 1.5::DOUBLE * 0.3::DOUBLE) THEN 2 WHEN problem <= 0.3 THEN -1 ELSE 0 END AS points FROM e)
SELECT event_id, round(greatest(0.10, least(0.85, 1 / (1 + exp(-(points - 3) / 1.6::DOUBLE)))), 2) AS chance FROM p""")
def patch_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    ground = F.get(F.array(F.lit("high"), F.lit("low"), F.lit("level"), F.lit(None).cast("string")), (i % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", V.patch_chance(v / 20, v * 5, v / 200, ground, F.when(i % 5 > 0, i % 7), F.when(i % 3 > 0, v / 100), F.lit(0.3)).alias("chance"))


_STAGES = "['planted', 'emergence', 'three_leaf', 'four_leaf', 'five_leaf', 'panicle_initiation', 'flag_leaf', 'boot', 'heading', 'flowering', 'soft_dough', 'hard_dough', 'black_layer']"


@query(f"""WITH e AS (SELECT event_id, value, CAST(event_id % 13 AS INTEGER) AS r FROM events) SELECT event_id, ({_STAGES})[r + 1] AS stage, CASE WHEN r >= 12 THEN 'harvest' WHEN value >= CASE WHEN r >= 8 THEN 30 ELSE 20 END THEN 'above' WHEN value >= CASE WHEN r >= 8 THEN 25 ELSE 15 END THEN 'near' ELSE 'below' END AS verdict FROM e""")
def aphid_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.get(F.array(F.lit("planted"), *(F.lit(s[0]) for s in V.STAGES)), (F.col("event_id") % 13).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", stage.alias("stage"), V.aphid_verdict(F.col("value"), stage).alias("verdict"))


@query("""WITH b AS (SELECT p_partkey AS id, p_size AS x0, p_partkey % 37 AS y0, p_size + 3 + p_partkey % 4 AS x1, p_partkey % 37 + 2 + p_partkey % 5 AS y1 FROM part),
p AS (SELECT a.id, b.id AS other, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS w, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS h, least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) AS area FROM b a JOIN b ON a.id < b.id)
SELECT id, other, round(w * h / area, 6) AS share FROM p WHERE w > 0 AND h > 0 AND w * h / area >= 0.3""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "part").selectExpr("p_partkey as id", "double(p_size) as x0", "double(p_partkey % 37) as y0", "double(p_size + 3 + p_partkey % 4) as x1", "double(p_partkey % 37 + 2 + p_partkey % 5) as y1")
    return overlap.box_pairs(b, 6.0, 0.3, digits=6)


@query(f"""WITH {_PIX}, t AS (SELECT row * 64 + col AS id, (row % 50) + 0.3 AS y, col + 0.6 AS x FROM px), s AS (SELECT row, col, avg(v) AS v FROM (SELECT row % 50 AS row, col, v FROM px) GROUP BY 1, 2),
n AS (SELECT t.id, s.v, (1 - abs(t.y - 0.5 - s.row)) * (1 - abs(t.x - 0.5 - s.col)) AS w FROM t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b) JOIN s ON s.row = CAST(floor(t.y - 0.5) AS BIGINT) + o.a AND s.col = CAST(floor(t.x - 0.5) AS BIGINT) + o.b)
SELECT t.id, round(sum(w * v) / sum(w), 6) AS v FROM t LEFT JOIN n ON n.id = t.id GROUP BY t.id""")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels(spark, sf_dir)
    source = px.groupBy((F.col("row") % 50).alias("row"), "col").agg(F.avg("v").alias("v"))
    target = px.select((F.col("row") * 64 + F.col("col")).alias("id"), ((F.col("row") % 50) + 0.3).alias("y"), (F.col("col") + 0.6).alias("x"))
    return overlap.resample(source, target).select("id", F.round("v", 6).alias("v"))


@query("""WITH c AS (SELECT p_size AS i, p_partkey % 40 AS j FROM part GROUP BY 1, 2), f AS (SELECT s_suppkey AS photo, s_suppkey % 50 AS px, s_suppkey * 7 % 40 AS py FROM supplier),
d AS (SELECT i, j, photo, round(sqrt(pow(i - px, 2) + pow(j - py, 2)), 9) AS d FROM c, f) SELECT i, j, arg_min(photo, {'d': d, 'p': photo}) AS photo, round(min(d), 6) AS d FROM d WHERE d <= 8 GROUP BY i, j""")
def paint(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr("p_size as i", "p_partkey % 40 as j", "double(p_size) as x", "double(p_partkey % 40) as y").distinct()
    photos = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as photo", "double(s_suppkey % 50) as px", "double(s_suppkey * 7 % 40) as py")
    return flight.paint(photos, cells, 8.0).withColumn("d", F.round("d", 6))


@query()
def warm_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight.warm_patches(pixels(spark, sf_dir).withColumn("v", F.col("v") * 20), 2.0, warm_z=1.0, least_m2=8.0, least_share=0.0)


@query()
def crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flight.crowns(pixels(spark, sf_dir), 0.05)


@query("SELECT l_orderkey, l_linenumber, round(greatest(0.02 * l_quantity - 3 * l_discount, 0) - 0.5 * greatest(5 * l_tax, 0) + 0.1, 6) + 0.0 AS prediction FROM lineitem")
def net_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = np.array([[0.02, 0.0], [-3.0, 0.0], [0.0, 5.0]])
    net = [(first, np.zeros(2)), (np.array([[1.0], [-0.5]]), np.array([0.1]))]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return nets.predict(rows, ["l_quantity", "l_discount", "l_tax"], [net]).select("l_orderkey", "l_linenumber", (F.round("prediction", 6) + 0.0).alias("prediction"))


def _flight_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as photos, eight a flight, four across; balances put their GPS off and turn them."""
    k, off = F.col("s_suppkey"), F.col("s_acctbal") / 1e4
    return table(spark, sf_dir, "supplier").select(
        F.floor(k / 8).alias("flight"), (k % 8).cast("long").alias("photo"), F.lit(1.0).alias("zx"), F.lit(0.0).alias("zy"), (40.0 * (k % 4) + off).alias("east"), (40.0 * F.floor((k % 8) / 4) - off).alias("north"),
        F.cos(0.2 + 0.05 * off).alias("ux"), F.sin(0.2 + 0.05 * off).alias("uy"),
    )


def _flight_ties(photos: DataFrame) -> DataFrame:
    """Four points that neighbours share, as each sees them from its true place and turn."""
    at = lambda s: photos.select("flight", F.col("photo").alias(s), (40.0 * (F.col("photo") % 4)).alias(f"x{s}"), (40.0 * F.floor(F.col("photo") / 4)).alias(f"y{s}"), F.col("ux").alias(f"ux{s}"), F.col("uy").alias(f"uy{s}"))
    right = (F.col("i") % 4 < 3) & (F.col("j") == F.col("i") + 1)
    pairs = at("i").join(at("j"), "flight").where(right | (F.col("j") == F.col("i") + 4))
    corner = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-9.0, -7.0), (8.0, -6.0), (-5.0, 9.0), (7.0, 8.0)))))
    rows = pairs.withColumn("c", corner).withColumns({"gx": (F.col("xi") + F.col("xj")) / 2 + F.col("c.a"), "gy": (F.col("yi") + F.col("yj")) / 2 + F.col("c.b")})

    def seen(s: str, p: str) -> list:
        dx, dy, ux, uy = F.col("gx") - F.col(f"x{s}"), F.col("gy") - F.col(f"y{s}"), F.col(f"ux{s}"), F.col(f"uy{s}")
        return [(dx * ux + dy * uy).alias(f"{p}x"), (dy * ux - dx * uy).alias(f"{p}y")]

    return rows.select("flight", "i", "j", *seen("i", "p"), *seen("j", "q"))


@query()
def photo_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = _flight_photos(spark, sf_dir)
    got = positions.place(photos.drop("ux", "uy"), _flight_ties(photos), tolerance=1e-8)
    return got.select("flight", "photo", "group", "basis", *(F.round(c, 3).alias(c) for c in ("zx", "zy", "tx", "ty")))
