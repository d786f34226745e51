"""Water balance, sequences, units, rasters, points and statistics over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilth.functions import agronomy as A
from tilth.functions import geo, spectral, stats
from tilth.operators import raster, sequences, spatial, units, water
from tilth.operators.quantiles import beside, exact_quantiles
from tilth.sources.shared import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a field; the day's mean value is the demand, its least the rain."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("field"), F.to_date("ts").alias("day"))
    return rows.agg(F.round(F.avg("value") / 20, 8).alias("eto"), F.round(F.min("value") / 10, 8).alias("rain"), F.round(F.max("value") / 100, 8).alias("v"), F.count("*").alias("n"))


_DAILY = "daily AS (SELECT user_id AS field, CAST(ts AS DATE) AS day, round(avg(value) / 20, 8) AS eto, round(min(value) / 10, 8) AS rain, round(max(value) / 100, 8) AS v, count(*) AS n FROM events GROUP BY 1, 2)"
_SPINE = _DAILY + ", ends AS (SELECT field, min(day) AS a, max(day) AS b FROM daily GROUP BY field), spine AS (SELECT field, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM ends)"


@query(f"WITH {_SPINE} SELECT s.field, s.day, last_value(d.eto IGNORE NULLS) OVER (PARTITION BY s.field ORDER BY s.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eto, d.day IS NULL AS filled FROM spine s LEFT JOIN daily d ON d.field = s.field AND d.day = s.day")
def spine_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.fill_spine(daily_events(spark, sf_dir).select("field", "day", "eto"), ["field"], "day", ["eto"])


_INTERP = _SPINE + """, j AS (SELECT s.field, s.day, d.v, CASE WHEN d.v IS NOT NULL THEN s.day END AS k FROM spine s LEFT JOIN daily d ON d.field = s.field AND d.day = s.day),
e AS (SELECT field, day, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS d0, first_value(v IGNORE NULLS) OVER f AS v1, first_value(k IGNORE NULLS) OVER f AS d1 FROM j WINDOW b AS (PARTITION BY field ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY field ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
interp AS (SELECT field, day, v0 + (v1 - v0) * coalesce((day - d0)::DOUBLE / nullif(d1 - d0, 0), 0.0) AS v FROM e)"""


@query(f"WITH {_INTERP} SELECT field, day, round(v, 6) AS v FROM interp")
def interp_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.interpolate(daily_events(spark, sf_dir).select("field", "day", "v"), ["field"], "day", "v").withColumn("v", F.round("v", 6))


_NEEDS = "(VALUES ('emergence', 20.0::DOUBLE), ('boot', 60.0), ('flowering', 120.0), ('black_layer', 400.0)) t(stage, need)"


@query(f"""WITH {_DAILY}, r AS (SELECT field, day, v * 10 AS g, sum(v * 10) OVER (PARTITION BY field ORDER BY day) AS total, row_number() OVER (PARTITION BY field ORDER BY day DESC) AS rn FROM daily),
t AS (SELECT field, arg_max(total, day) AS total, max(day) AS last, avg(g) FILTER (WHERE rn <= 14) AS rate FROM r GROUP BY field)
SELECT t.field, n.stage, n.need, round(t.total, 4) AS total, min(r.day) FILTER (WHERE r.total >= n.need) IS NOT NULL AS reached,
 coalesce(min(r.day) FILTER (WHERE r.total >= n.need), t.last + CAST(ceil((n.need - t.total) / t.rate) AS INTEGER)) AS date FROM t CROSS JOIN {_NEEDS.replace(' t(stage, need)', ' n(stage, need)')} JOIN r ON r.field = t.field GROUP BY t.field, n.stage, n.need, t.total, t.last, t.rate""")
def cum_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = daily_events(spark, sf_dir).select("field", "day", (F.col("v") * 10).alias("g"))
    needs = [("emergence", 20.0), ("boot", 60.0), ("flowering", 120.0), ("black_layer", 400.0)]
    return sequences.crossings(rows, ["field"], "day", "g", needs).withColumn("total", F.round("total", 4))


def _season(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = daily_events(spark, sf_dir)
    kc_ini, kc_mid, p, _, _, _ = A.CROPS["sorghum"]
    rows = days.select("field", "day", "eto", "rain", F.col("v").alias("ndvi"), F.lit(kc_ini).alias("kc_ini"), F.lit(kc_mid).alias("kc_mid"), F.lit(p).alias("p_base"), F.lit(False).alias("perennial"), F.when(F.col("n") >= 6, -1.0).when(F.col("n") >= 4, 12.7).alias("irrigation"))
    taw = A.stored_water_mm(F.lit(0.3) + F.lit(0.9) * F.col("cover"), A.uniform_storage_cm(F.lit(2.0)))
    return water.daily_demand(rows, ["field"], "day", taw)


def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return water.balance(_season(spark, sf_dir), ["field"], "day", F.lit(20.0))


_BALANCE = _DAILY + """, f AS (SELECT field, day, eto, rain, n, least(greatest((v - 0.15) / (0.85 - 0.15), 0.0), 1.0) AS fc FROM daily),
k AS (SELECT field, day, eto, CASE WHEN rain >= 0.2 * eto THEN rain ELSE 0.0 END AS rain, n, (0.30 + (1.05 - 0.30) * fc) * eto AS etp, 0.3 + 0.9 * max(fc) OVER (PARTITION BY field ORDER BY day) AS root FROM f),
q AS (SELECT field, row_number() OVER w AS i, day, etp, rain, CASE WHEN n >= 6 THEN -1.0 WHEN n >= 4 THEN 12.7 END AS irr, least(greatest(0.55 + 0.04 * (5 - avg(etp) OVER (PARTITION BY field ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)), 0.1), 0.8) AS p, root * 2.0 * 2.54 / 30.48 * 1000 AS taw FROM k WINDOW w AS (PARTITION BY field ORDER BY day)),
b AS (WITH RECURSIVE s AS (
 SELECT field, 0::BIGINT AS i, NULL::DATE AS day, 20.0::DOUBLE AS dr, NULL::DOUBLE AS ks, NULL::DOUBLE AS etc, NULL::DOUBLE AS drained, NULL::DOUBLE AS raw, NULL::DOUBLE AS taw FROM (SELECT DISTINCT field FROM q)
 UNION ALL SELECT field, i, day, least(greatest(after, 0.0), taw), ks, etc, greatest(0.0, -after), raw, taw FROM (
  SELECT *, dr0 - rain - CASE WHEN irr IS NULL THEN 0.0 WHEN irr < 0 THEN dr0 ELSE irr END + etc AS after FROM (
   SELECT *, ks * etp AS etc FROM (SELECT *, CASE WHEN dr0 <= raw THEN 1.0 ELSE greatest(0.0, (taw - dr0) / ((1 - p) * taw)) END AS ks FROM (
    SELECT q.field, q.i, q.day, q.etp, q.rain, q.irr, q.p, q.taw, q.p * q.taw AS raw, least(s.dr, q.taw) AS dr0 FROM s JOIN q ON q.field = s.field AND q.i = s.i + 1)))))
 SELECT * FROM s WHERE i > 0)"""


@query(f"WITH {_BALANCE} SELECT field, day AS date, round(ks, 9) AS ks, round(etc, 9) AS etc, round(dr, 9) AS dr, round(drained, 9) AS drained FROM b")
def balance_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _balance(spark, sf_dir).select("field", "date", *(F.round(c, 9).alias(c) for c in ("ks", "etc", "dr", "drained")))


@query(f"""WITH {_BALANCE}, l AS (SELECT field, arg_max(dr, day) AS dr, arg_max(raw, day) AS raw, arg_max(etc, day) AS etc FROM b GROUP BY field),
d AS (SELECT *, CASE WHEN dr >= raw THEN 0 WHEN ceil((raw - dr) / nullif(etc, 0)) <= 45 THEN CAST(ceil((raw - dr) / nullif(etc, 0)) AS INTEGER) END AS days, CASE WHEN dr >= raw THEN 0 WHEN ceil((raw - dr) / nullif(etc * 1.2, 0)) <= 45 THEN CAST(ceil((raw - dr) / nullif(etc * 1.2, 0)) AS INTEGER) ELSE 45 END AS soon, CASE WHEN dr >= raw THEN 0 WHEN ceil((raw - dr) / nullif(etc * 0.8, 0)) <= 45 THEN CAST(ceil((raw - dr) / nullif(etc * 0.8, 0)) AS INTEGER) ELSE 45 END AS late FROM l)
SELECT field, round(dr, 4) AS dr, days, CASE WHEN coalesce(days, 45) > 0 THEN soon END AS days_soonest, CASE WHEN coalesce(days, 45) > 0 THEN late END AS days_latest, CASE WHEN days IS NULL THEN 'ok for now' WHEN days <= 0 THEN 'water now' WHEN days <= 3 THEN 'water within 3 days' WHEN days <= 7 THEN 'water this week' ELSE 'ok for now' END AS status FROM d""")
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _balance(spark, sf_dir).groupBy("field").agg(F.max_by(F.struct("dr", "raw", "etc"), "date").alias("s")).select("field", "s.*")
    return water.project(last).select("field", F.round("dr", 4).alias("dr"), "days", "days_soonest", "days_latest", "status")


@query(f"WITH {_DAILY} SELECT field, day, round(max(least(greatest((v - 0.15) / (0.85 - 0.15), 0.0), 1.0)) OVER (PARTITION BY field ORDER BY day), 6) AS cover FROM daily")
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season(spark, sf_dir).select("field", "day", F.round("cover", 6).alias("cover"))


@query("""WITH e AS (SELECT user_id AS field, CAST(ts AS DATE) AS day, CASE event_type WHEN 'signup' THEN 'planted' WHEN 'purchase' THEN 'irrigated' ELSE 'note' END AS kind FROM events WHERE value < 30),
a AS (SELECT field, max(day) FILTER (WHERE kind = 'planted') AS planted, min(day) FILTER (WHERE kind = 'irrigated') AS watered FROM e WHERE day <= DATE '2024-01-30' GROUP BY field)
SELECT field, coalesce(planted, watered, DATE '2024-01-30' - 60) AS start, CASE WHEN planted IS NOT NULL THEN 'planted' WHEN watered IS NOT NULL THEN 'irrigated' ELSE 'assumed' END AS reason FROM a""")
def season_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "planted").when(F.col("event_type") == "purchase", "irrigated").otherwise("note")
    rows = table(spark, sf_dir, "events").where("value < 30 and to_date(ts) <= date'2024-01-30'").select(F.col("user_id").alias("field"), F.to_date("ts").alias("day"), kind.alias("kind"))
    return water.season_start(rows, ["field"], F.lit("2024-01-30").cast("date"))


@query("SELECT a.event_type, a.event_id AS id, round(quantile_cont(b.value, 0.5), 4) AS median, count(*) AS n FROM events a JOIN events b ON a.event_type = b.event_type AND abs(floor(epoch(a.ts)) - floor(epoch(b.ts))) <= 420 GROUP BY 1, 2")
def drift_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "value")
    return sequences.running_median(rows, ["event_type"], "s", "value", 420).withColumn("median", F.round("median", 4))


def _purchase_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Points (all events but purchases) and spans of two hours from each purchase."""
    rows = table(spark, sf_dir, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    spans = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("seq"), F.col("s").alias("start"), (F.col("s") + 7200).alias("end"))
    return rows.where("event_type != 'purchase'").select("user_id", F.col("event_id").alias("point"), "s"), spans


@query("""WITH p AS (SELECT user_id, event_id AS point, floor(epoch(ts)) AS s FROM events WHERE event_type <> 'purchase'), i AS (SELECT user_id, event_id AS seq, floor(epoch(ts)) AS a, floor(epoch(ts)) + 7200 AS b FROM events WHERE event_type = 'purchase')
SELECT p.user_id, p.point, min(i.seq) AS held FROM p LEFT JOIN i ON i.user_id = p.user_id AND p.s BETWEEN i.a AND i.b GROUP BY 1, 2""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: purchases open a span, the others are points."""
    return sequences.holding_interval(*_purchase_spans(spark, sf_dir), ["user_id"], "s", 7200).select("user_id", "point", "held")


@query("""WITH p AS (SELECT user_id, event_id AS point, floor(epoch(ts)) AS s FROM events WHERE event_type <> 'purchase'), i AS (SELECT user_id, event_id AS seq, floor(epoch(ts)) AS a, floor(epoch(ts)) + 7200 AS b FROM events WHERE event_type = 'purchase')
SELECT p.user_id, p.point, coalesce(min(i.seq) FILTER (WHERE p.s BETWEEN i.a AND i.b), arg_min(i.seq, {'d': abs(p.s - (i.a + i.b) / 2), 'q': i.seq})) AS held FROM p LEFT JOIN i ON i.user_id = p.user_id GROUP BY 1, 2""")
def interval_or_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.interval_or_nearest(*_purchase_spans(spark, sf_dir), ["user_id"], "s", 7200).select("user_id", "point", "held")


@query("SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM (SELECT l_orderkey, l_linenumber, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'N')) GROUP BY l_orderkey, run")
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag != 'N'").select("l_orderkey", "l_linenumber").distinct()
    return sequences.islands(rows, ["l_orderkey"], "l_linenumber", F.lit(True))


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 7200000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return sequences.sessions(rows, ["user_id"], "ts", 7200)


@query("""WITH p AS (SELECT l_orderkey AS k, (l_linenumber - 1) * 10 AS start, CAST(least(l_quantity, 12) AS INTEGER) AS length FROM lineitem), t AS (SELECT *, max(start) OVER (PARTITION BY k) + 10 AS total FROM p),
g AS (SELECT *, start > coalesce(max(start + length) OVER (PARTITION BY k ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap FROM t) SELECT k, NOT bool_or(gap) AND max(start + length) >= max(total) AS complete, max(start + length) AS reached FROM g GROUP BY k""")
def covered_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), ((F.col("l_linenumber") - 1) * 10).alias("start"), F.least("l_quantity", F.lit(12.0)).cast("int").alias("length"))
    # in the order that covered_bytes reads, so that pieces are sorted once and not joined with themselves
    whole = Window.partitionBy("k").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sequences.covered_bytes(p.withColumn("total", F.max("start").over(whole) + 10), ["k"])


_UNITS = """u AS (SELECT p_partkey AS unit, p_brand AS block, CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE p_retailprice * (p_partkey % 13) END AS size, p_size AS area, (p_partkey * 7919) % 101 - 20.0 AS exg, ((p_partkey * 31) % 100) / 100.0 AS cover FROM part),
q AS (SELECT block, count(*) AS group_size, quantile_cont(size, 0.15) AS s15, quantile_cont(size, 0.25) AS s25, quantile_cont(size, 0.5) AS s50, quantile_cont(size, 0.75) AS s75, quantile_cont(exg, 0.15) AS e15, quantile_cont(exg, 0.25) AS e25, quantile_cont(exg, 0.5) AS e50, quantile_cont(exg, 0.75) AS e75, quantile_cont(cover, 0.5) AS c50, quantile_cont(area, 0.5) AS a50 FROM u GROUP BY block),
z AS (SELECT u.*, q.*, CASE WHEN s75 - s25 <= 0 THEN 0.0 ELSE (size - s50) / ((s75 - s25) / 1.349) END AS sz, CASE WHEN e75 - e25 <= 0 THEN 0.0 ELSE (exg - e50) / ((e75 - e25) / 1.349) END AS ez FROM u JOIN q USING (block)),
flagged AS (SELECT unit, block, size, sz, CASE WHEN group_size < 8 THEN CASE WHEN size IS NULL THEN 'NO_DATA' ELSE 'HEALTHY' END WHEN size IS NULL THEN 'NO_DATA' WHEN area < 0.75 * a50 THEN 'EDGE' WHEN cover < 0.7 * c50 THEN 'MISSING' WHEN size < 0.1 * s50 THEN 'DEAD' WHEN ez < -3 AND (e50 <= 0 OR exg < 0.25 * e50) THEN 'DEAD' WHEN (size < s15 AND size < 0.8 * s50 AND sz < -1.5) OR (exg < e15 AND exg < 0.8 * e50 AND ez < -1.5) THEN 'STRESSED' ELSE 'HEALTHY' END AS flag FROM z)"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    u = table(spark, sf_dir, "part").select(k.alias("unit"), F.col("p_brand").alias("block"), F.when(k % 97 != 0, F.col("p_retailprice") * (k % 13)).alias("size"), F.col("p_size").cast("double").alias("area"), ((k * 7919) % 101 - 20.0).alias("exg"), (((k * 31) % 100) / 100.0).alias("cover"))
    return units.classify(u, ["block"], "size", "exg", "cover", "area")


@query(f"WITH {_UNITS} SELECT unit, block, flag, round(sz, 5) AS z FROM flagged")
def unit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("unit", "block", "flag", F.round("size_z", 5).alias("z"))


@query(f"""WITH {_UNITS}, b AS (SELECT block, count(*) AS n_units, count(*) FILTER (WHERE flag = 'HEALTHY') AS n_healthy, count(*) FILTER (WHERE flag = 'STRESSED') AS n_stressed, count(*) FILTER (WHERE flag = 'DEAD') AS n_dead, count(*) FILTER (WHERE flag = 'MISSING') AS n_missing, count(*) FILTER (WHERE flag IN ('EDGE', 'NO_DATA')) AS n_not_assessed, round(quantile_cont(size, 0.5), 4) AS median_volume FROM flagged GROUP BY block)
SELECT *, n_units - n_not_assessed AS n_judged, round((n_stressed + n_dead + n_missing) / nullif(n_units - n_not_assessed, 0), 6) AS share_problem FROM b""")
def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = units.block_summary(_flagged(spark, sf_dir), ["block"], "size")
    return out.drop("share_stressed", "share_dead", "share_missing").withColumn("share_problem", F.round("share_problem", 6)).withColumn("median_volume", F.round("median_volume", 4))


@query("SELECT p_partkey, round(100.0 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0) / count(*) OVER (PARTITION BY p_brand), 6) AS pct FROM part")
def pct_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(stats.average_rank_percent("p_size", ["p_brand"]), 6).alias("pct"))


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, count(*) FILTER (WHERE (l_extendedprice - m) / ((b - a) / 1.349) < -1.2) AS low, round(max((l_extendedprice - m) / ((b - a) / 1.349)), 5) AS z_max FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1")
def robust_z_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    q = exact_quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75])
    z = stats.robust_z(F.col("l_extendedprice"), F.get("q", F.lit(1)), F.get("q", F.lit(0)), F.get("q", F.lit(2)))
    return beside(rows, q, ["l_returnflag"]).withColumn("z", z).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("z") < -1.2).alias("low"), F.round(F.max("z"), 5).alias("z_max"))


_PIX = "px AS (SELECT label AS raster, CAST(vec_id AS BIGINT) AS row, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label is a raster, each vector a row of it."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("raster"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v")).select("raster", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("v").cast("double").alias("v"))


@query(f"WITH {_PIX} SELECT raster, col // 8 AS zone, count(*) AS n_pixels, round(count(*) * 0.01::DOUBLE, 4) AS area, round(max(v), 6) AS largest, round(avg(v), 6) AS mean, round(count(*) FILTER (WHERE v >= 0.15) / count(*), 6) AS cover, round(sum(greatest(v, 0.0)) * 0.01, 6) AS volume FROM px GROUP BY 1, 2")
def zonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.zonal(pixels(spark, sf_dir).withColumn("zone", F.floor(F.col("col") / 8)), ["raster", "zone"], "v", 0.15, 0.01)
    return out.select("raster", "zone", "n_pixels", F.round("area", 4).alias("area"), *(F.round(c, 6).alias(c) for c in ("largest", "mean", "cover", "volume")))


@query(f"WITH {_PIX}, n AS (SELECT a.raster, a.row, a.col, avg(b.v) AS f FROM px a JOIN px b ON a.raster = b.raster AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3) SELECT raster, row, col, round(f, 6) AS f FROM n")
def focal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.focal(pixels(spark, sf_dir), raster.offsets(1)).select("raster", "row", "col", F.round("f", 6).alias("f"))


@query(f"WITH {_PIX} SELECT raster, row // 4 AS row, col // 4 AS col, round(avg(v), 6) AS v, count(*) AS n FROM px GROUP BY 1, 2, 3")
def block_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_reduce(pixels(spark, sf_dir), 4).select("raster", "row", "col", F.round("v", 6).alias("v"), "n")


@query(f"WITH {_PIX} SELECT row, col, CASE WHEN a.v - b.v IS NOT NULL THEN round(least(greatest(a.v - b.v, 0.0), 0.3), 6) END AS v, a.v - b.v < 0 AS clamped FROM (SELECT row % 50 AS row, col, max(v) AS v FROM px WHERE raster % 2 = 0 GROUP BY 1, 2) a LEFT JOIN (SELECT row % 50 AS row, col, max(v) AS v FROM px WHERE raster % 2 = 1 GROUP BY 1, 2) b USING (row, col)")
def raster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    top, ground = (pixels(spark, sf_dir).where(F.col("raster") % 2 == i).groupBy(F.lit(0).alias("raster"), (F.col("row") % 50).alias("row"), "col").agg(F.max("v").alias("v")) for i in (0, 1))
    return raster.surface_height(top, ground, 0.3).select("row", "col", F.round("v", 6).alias("v"), "clamped")


@query(f"""WITH RECURSIVE {_PIX}, c AS (SELECT raster, row, col, row * 2147483648 + col AS cell FROM px WHERE v > 0.14),
walk AS (SELECT raster, row, col, cell AS label FROM c UNION SELECT c.raster, c.row, c.col, w.label FROM walk w JOIN c ON c.raster = w.raster AND abs(c.row - w.row) + abs(c.col - w.col) = 1)
SELECT raster, row, col, min(label) AS label FROM walk GROUP BY 1, 2, 3""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.components(pixels(spark, sf_dir).where("v > 0.14").select("raster", "row", "col"))


@query(f"""WITH {_PIX}, e AS (SELECT raster, min(v) AS a, max(v) AS b FROM px GROUP BY 1), h AS (SELECT raster, least(CAST(floor((v - a) / (b - a) * 256) AS BIGINT), 255) AS bin, a, b, count(*) AS n FROM px JOIN e USING (raster) GROUP BY ALL),
x AS (SELECT raster, bin, n, a + (bin + 0.5) * (b - a) / 256 AS x FROM h), s AS (SELECT raster, bin, x, sum(n) OVER w AS n0, sum(n * x) OVER w AS s0, sum(n) OVER p AS n, sum(n * x) OVER p AS s FROM x WINDOW w AS (PARTITION BY raster ORDER BY bin), p AS (PARTITION BY raster)),
t AS (SELECT raster, bin, x, n0 * (n - n0) * pow(s0 / n0 - (s - s0) / (n - n0), 2) AS between_ FROM s WHERE n0 < n) SELECT raster, round(arg_min(x, {{'b': -round(between_, 6), 'i': bin}}), 6) AS threshold FROM t GROUP BY raster""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.otsu(pixels(spark, sf_dir), ["raster"], "v").withColumn("threshold", F.round("threshold", 6))


@query("WITH p AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_quantity AS low, n FROM p WHERE rn = floor((n - 1) * 5 / 100) + 1")
def ground_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.order_statistic(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", 5)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a point: discount and tax are its place, the price its height."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_discount") * 100).alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_extendedprice") / 10000).alias("z"))


@query("WITH t AS (SELECT l_suppkey AS k, floor(l_discount * 100 / 2) AS i, floor(l_tax * 100 / 2) AS j, max(l_extendedprice / 10000) AS top FROM lineitem GROUP BY 1, 2, 3) SELECT k, round(sum(ceil(greatest(top - 1, 0) / 2.0)) * 8, 4) AS volume, count(*) AS columns FROM t GROUP BY k")
def voxel_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.voxel_volume(points(spark, sf_dir), ["k"], 2.0, 1.0).withColumn("volume", F.round("volume", 4))


@query("""WITH p AS (SELECT l_suppkey AS k, l_discount * 100 AS x, l_tax * 100 AS y, l_extendedprice / 10000 AS z FROM lineitem), d AS (SELECT *, floor(x / 3) AS a, floor(y / 3) AS b, floor(z / 3) AS c, round(pow(x - (floor(x / 3) + 0.5) * 3, 2) + pow(y - (floor(y / 3) + 0.5) * 3, 2) + pow(z - (floor(z / 3) + 0.5) * 3, 2), 9) AS d FROM p)
SELECT k, round(m.x, 6) AS x, round(m.y, 6) AS y, round(m.z, 6) AS z FROM (SELECT k, min({'d': d, 'x': x, 'y': y, 'z': z}) AS m FROM d GROUP BY k, a, b, c)""")
def thin_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.thin(points(spark, sf_dir), ["k"], 3.0).select("k", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("""WITH t AS (SELECT l_returnflag, count(*) AS n, regr_count(l_extendedprice, l_quantity) AS c, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem GROUP BY 1),
f AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c2 FROM t) SELECT l_returnflag, n, round(mz - b * mx - c2 * my, 2) AS a, round(b, 3) AS b, round(c2, 2) AS c FROM f""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))
    return spatial.plane_sums(rows, ["l_returnflag"]).select("l_returnflag", "n", F.round("a", 2).alias("a"), F.round("b", 3).alias("b"), F.round("c", 2).alias("c"))


@query()
def robust_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_extendedprice").alias("z"))
    return spatial.robust_plane(rows, ["l_returnflag"])


@query("""WITH t AS (SELECT l_suppkey % 20 AS k, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) AS a, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity > 25) AS b, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity <= 25) AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_quantity <= 25) AS d FROM lineitem GROUP BY 1),
h AS (SELECT t.*, u.i, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(u.i + 1) - lgamma(a + b - u.i + 1) - lgamma(a + c - u.i + 1) - lgamma(c + d - a - c + u.i + 1) AS l FROM t, unnest(range(a, least(a + b, a + c) + 1)) AS u(i))
SELECT k, a, b, c, d, round(least((a / (a + b)) / (c / (c + d)), 99.0), 5) AS ratio, round(least(sum(exp(l)), 1.0), 5) AS p FROM h GROUP BY ALL""")
def fisher_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_suppkey") % 20)
    return spatial.link(rows, ["k"], F.col("l_returnflag") == "R", F.col("l_quantity") > 25).select("k", "a", "b", "c", "d", F.round("ratio", 5).alias("ratio"), F.round("p", 5).alias("p"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.vec_id AS query, r.vec_id AS id, round(sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - r.v[i]) * (q.v[i] - r.v[i])))), 6) AS d FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, id, d, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, id) AS rank FROM d) WHERE rank <= 8""")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return spatial.nearest_vectors(rows.where("id % 100 = 0"), rows, 8)


@query("""WITH p AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 40 AS DOUBLE) AS y FROM part), b AS (SELECT p_brand, CAST(floor(min(x) / 4) AS BIGINT) AS a, CAST(ceil(max(x) / 4) AS BIGINT) AS b, CAST(floor(min(y) / 4) AS BIGINT) AS c, CAST(ceil(max(y) / 4) AS BIGINT) AS d FROM p GROUP BY 1),
l AS (SELECT p_brand, unnest(range(a, b + 1)) AS i, c, d FROM b), g AS (SELECT p_brand, i, unnest(range(c, d + 1)) AS j FROM l) SELECT g.p_brand, g.i, g.j FROM g WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.p_brand = g.p_brand AND pow(p.x - 4 * g.i, 2) + pow(p.y - 4 * g.j, 2) <= 1.8 * 1.8)""")
def lattice_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    return spatial.empty_positions(rows, ["p_brand"], 4.0, 0.45)


@query("""WITH p AS (SELECT p_partkey AS id, p_brand, p_size AS x, p_partkey % 40 AS y FROM part), d AS (SELECT a.p_brand, a.id, b.id AS other, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.id <> b.id)
SELECT p_brand, id, other, round(d, 6) AS d, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS rank FROM d WHERE d <= 10) WHERE rank <= 3""")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    return spatial.nearest_within(rows, ["p_brand"], 3, 10.0).withColumn("d", F.round("d", 6))


@query(ORACLE_SQL["grid_neighbours"].replace(" WHERE d <= 10", ""))
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"))
    return spatial.nearest(rows, ["p_brand"], 3, 4.0).withColumn("d", F.round("d", 6))


@query()
def greedy_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 40).cast("double").alias("y"), F.col("p_retailprice").alias("score"))
    return spatial.greedy_pick(rows, ["p_brand"], 5, 6.0)


@query("SELECT k, n, round(CASE WHEN ax < 0 THEN ax + 180 ELSE ax END, 4) AS axis FROM (SELECT l_suppkey AS k, count(*) AS n, degrees(0.5 * atan2(2 * covar_pop(l_quantity, l_extendedprice / 2000), var_pop(l_quantity) - var_pop(l_extendedprice / 2000))) AS ax FROM lineitem GROUP BY 1)")
def main_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"))
    return spatial.main_axis(rows, ["k"]).withColumn("axis", F.round("axis", 4))


@query("SELECT k, round(CASE WHEN ph < 0 THEN ph + 7 ELSE ph END, 4) AS phase FROM (SELECT l_suppkey AS k, atan2(avg(sin(l_quantity * 2 * pi() / 7)), avg(cos(l_quantity * 2 * pi() / 7))) * 7 / (2 * pi()) AS ph FROM lineitem GROUP BY 1)")
def circular_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.circular_phase(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "k"), ["k"], "l_quantity", 7.0).withColumn("phase", F.round("phase", 4))


@query()
def level_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are frames over the parts they share."""
    shares = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("frame"), F.col("l_partkey").alias("cell")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))
    return raster.level_frames(shares)


#: Weather that reaches each guard: still air, no sun, air wetter than it can be, and the polar night.
_ET = """l_orderkey, l_linenumber, 15 + l_quantity / 2.5 AS tmax, 5 + l_quantity / 5 AS tmin, 5 + l_quantity / 2 AS dew, l_tax * 50 AS wind, l_discount * 200 - 1 AS solar,
 dayofyear(l_shipdate) AS doy, CASE WHEN l_linenumber % 4 = 0 THEN 80.0 ELSE 26.2 END AS lat"""


@query(f"""WITH w0 AS (SELECT {_ET} FROM lineitem),
w AS (SELECT * REPLACE (greatest(wind, 0.5) AS wind, greatest(solar, 0.0) AS solar) FROM w0),
s AS (SELECT *, (tmax + tmin) / 2 AS m, 0.000665 * 101.3 * pow((293.0 - 0.0065 * 30) / 293.0, 5.26) AS g, 2 * pi() / 365 * doy AS j, lat * pi() / 180 AS phi,
 (0.6108 * exp(17.27 * tmax / (tmax + 237.3)) + 0.6108 * exp(17.27 * tmin / (tmin + 237.3))) / 2 AS es, 0.6108 * exp(17.27 * dew / (dew + 237.3)) AS said FROM w),
t AS (SELECT *, least(said, es) AS ea, 4098 * 0.6108 * exp(17.27 * m / (m + 237.3)) / pow(m + 237.3, 2) AS d, 1 + 0.033 * cos(j) AS dr, 0.409 * sin(j - 1.39) AS tilt FROM s),
u AS (SELECT *, acos(least(greatest(-tan(phi) * tan(tilt), -1.0), 1.0)) AS ws FROM t),
r AS (SELECT *, (0.75 + 2e-5 * 30) * 24 * 60 / pi() * 0.0820 * dr * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws)) AS clear FROM u),
n AS (SELECT *, 0.77 * solar - 4.903e-9 * (pow(tmax + 273.16, 4) + pow(tmin + 273.16, 4)) / 2 * (0.34 - 0.14 * sqrt(ea))
 * (1.35 * CASE WHEN clear > 0 THEN least(greatest(solar / clear, 0.3), 1.0) END - 0.35) AS rn FROM r)
SELECT l_orderkey, l_linenumber, CASE WHEN rn IS NOT NULL THEN round(greatest((0.408 * d * rn + g * 900 / (m + 273) * wind * (es - ea)) / (d + g * (1 + 0.34 * wind)), 0.0), 5) END AS eto FROM n""")
def eto_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "15 + l_quantity / 2.5D as tmax", "5 + l_quantity / 5 as tmin", "5 + l_quantity / 2 as dew", "l_tax * 50 as wind", "l_discount * 200 - 1 as solar",
        "dayofyear(l_shipdate) as doy", "case when l_linenumber % 4 = 0 then 80.0D else 26.2D end as lat",
    )
    eto = A.reference_et(*(F.col(c) for c in ("tmax", "tmin", "dew", "wind", "solar", "lat")), F.lit(30.0), F.col("doy"))
    return w.select("l_orderkey", "l_linenumber", F.round(eto, 5).alias("eto"))


@query("SELECT l_orderkey, l_linenumber, round((least(greatest((15 + l_quantity / 2.5) * 9 / 5 + 32, 50), 100) + least(greatest((5 + l_quantity / 5) * 9 / 5 + 32, 50), 100)) / 2 - 50, 5) AS gdu FROM lineitem")
def degree_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(A.degree_units(15 + q / 2.5, 5 + q / 5), 5).alias("gdu"))


_BANDS = "l_quantity / 50 AS b08, l_discount * 5 AS b04, l_tax * 8 AS b11, l_linenumber AS scl"


@query(f"""WITH p AS (SELECT l_suppkey AS field, {_BANDS} FROM lineitem), i AS (SELECT field, CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND abs(b08 + b04) >= 1e-6 AND abs((b08 - b04) / (b08 + b04)) <= 1 THEN (b08 - b04) / (b08 + b04) END AS v FROM p)
SELECT field, count(v) AS n_valid, count(*) AS n_total, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(stddev_pop(v), 6) AS std, round(count(*) FILTER (WHERE v < 0) / count(v), 6) AS negative FROM i GROUP BY field""")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as field", "l_quantity / 50 as b08", "l_discount * 5 as b04", "l_tax * 8 as b11", "l_linenumber as scl")
    rows = p.select("field", F.when(spectral.ground_class(F.col("scl")), spectral.spectral_index("NDVI")).alias("v"))
    out = rows.groupBy("field").agg(F.count("v").alias("n_valid"), F.count("*").alias("n_total"), F.avg("v").alias("mean"), F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.stddev_pop("v").alias("std"), (F.count_if(F.col("v") < 0) / F.count("v")).alias("negative"))
    q = {name: F.get("q", F.lit(i)) for i, name in enumerate(("p10", "median", "p90"))}
    return out.select("field", "n_valid", "n_total", F.round("mean", 6).alias("mean"), *(F.round(c, 6).alias(n) for n, c in q.items()), F.round("std", 6).alias("std"), F.round("negative", 6).alias("negative"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(g + r - b) >= 1e-6 AND r + g + b > 0 AND abs((g - r) / (g + r - b)) <= 1.5 THEN round((g - r) / (g + r - b), 6) + 0.0 END AS vari, CASE WHEN r + g + b > 0 THEN round((2 * g - r - b) / (r + g + b), 6) + 0.0 END AS exg, CASE WHEN r + g + b > 0 THEN round((2 * g - r - b) / (2 * g + r + b), 6) + 0.0 END AS gli FROM (SELECT l_orderkey, l_linenumber, l_quantity AS g, l_discount * 300 AS r, l_tax * 300 AS b FROM lineitem)")
def colour_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.colour_indices(F.col("l_discount") * 300, F.col("l_quantity"), F.col("l_tax") * 300)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *((F.round(c, 6) + 0.0).alias(n) for n, c in out.items()))


@query("""WITH p AS (SELECT user_id, event_id, ts, -98 + value / 100 AS lon, 26 + (event_id % 100) / 100.0 AS lat FROM events), l AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, round(2 * 6371000 * asin(sqrt(least(pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2), 1))), 3) AS metres FROM l""")
def track_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (F.col("value") / 100 - 98).alias("lon"), (F.lit(26) + (F.col("event_id") % 100) / 100.0).alias("lat"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return p.select("user_id", "event_id", F.round(geo.haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), 3).alias("metres"))


@query("SELECT s_suppkey, round(CASE WHEN d <= 0.25 THEN 5.08 * 25 / 30.48 * (d / 0.25) * 10 ELSE d * 5.08 * 100 / 30.48 * 10 END, 5) AS taw FROM (SELECT s_suppkey, abs(s_acctbal) / 5000 AS d FROM supplier)")
def stored_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.abs("s_acctbal") / 5000
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(A.stored_water_mm(depth, A.uniform_storage_cm(F.lit(2.0))), 5).alias("taw"))


@query("SELECT c_custkey, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS epsg, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor((((degrees(atan2(lon, lat)) % 360) + 360) % 360) / 45 + 0.5) % 8 AS INTEGER) + 1] AS heading FROM (SELECT c_custkey, c_acctbal / 60 AS lon, (c_custkey % 160) - 80.0 + 0.25 AS lat FROM customer WHERE abs(c_acctbal) < 10000)")
def zones_and_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").where("abs(c_acctbal) < 10000").select("c_custkey", (F.col("c_acctbal") / 60).alias("lon"), ((F.col("c_custkey") % 160) - 80.0 + 0.25).alias("lat"))
    return rows.select("c_custkey", geo.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"), geo.compass(F.col("lon"), F.col("lat")).alias("heading"))


@query(f"""WITH {_DAILY}, w AS (SELECT field, day, CASE WHEN n > 1 OR field % 3 = 0 THEN eto END AS eto, CASE WHEN v > 1 THEN rain END AS rain FROM daily), s AS (SELECT field, min(day) + CAST(field % 4 AS INTEGER) AS start, max(day) + CAST(field % 13 AS INTEGER) AS as_of FROM daily GROUP BY field),
t AS (SELECT s.field, s.start, s.as_of, max(w.day) AS latest, max(w.day) FILTER (WHERE w.day BETWEEN start AND as_of) AS last, min(w.day) FILTER (WHERE w.day BETWEEN start AND as_of) AS first, count(w.day) FILTER (WHERE w.day BETWEEN start AND as_of) AS n
 FROM s LEFT JOIN w ON w.field = s.field AND w.eto IS NOT NULL GROUP BY 1, 2, 3),
p AS (SELECT *, coalesce(last, latest) AS e, CASE WHEN last IS NULL AND (latest IS NULL OR latest >= start OR as_of - latest > 10) THEN 'no weather' WHEN first > start THEN 'starts late' WHEN last IS NOT NULL AND n < last - start + 1 THEN 'missing days'
 WHEN as_of - coalesce(last, latest) > 10 THEN 'ends early' END AS problem FROM t),
u AS (SELECT p.field, avg(w.eto) AS usual FROM p JOIN w ON w.field = p.field AND w.day BETWEEN greatest(CASE WHEN last IS NULL THEN e - 6 ELSE start END, e - 6) AND e WHERE problem IS NULL GROUP BY 1),
d AS (SELECT field, e, problem, CAST(unnest(generate_series(CAST(start AS TIMESTAMP), CAST(as_of AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM p)
SELECT d.field, d.date, round(CASE WHEN problem IS NULL THEN CASE WHEN d.date > e THEN usual ELSE w.eto END END, 6) AS eto, CASE WHEN problem IS NULL THEN CASE WHEN d.date > e THEN 0.0 ELSE coalesce(w.rain, 0.0) END END AS rain,
 problem IS NULL AND d.date > e AS filled, problem FROM d LEFT JOIN u ON u.field = d.field LEFT JOIN w ON w.field = d.field AND w.day = d.date""")
def weather_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with a single event have no figure (but for every third user); spans end up to twelve days after the last event."""
    daily = daily_events(spark, sf_dir)
    weather = daily.select("field", F.col("day").alias("date"), F.when((F.col("n") > 1) | (F.col("field") % 3 == 0), F.col("eto")).alias("eto"), F.when(F.col("v") > 1, F.col("rain")).alias("rain"))
    spans = daily.groupBy("field").agg(F.date_add(F.min("day"), (F.col("field") % 4).cast("int")).alias("start"), F.date_add(F.max("day"), (F.col("field") % 13).cast("int")).alias("as_of"))
    return water.complete_weather(weather, spans).withColumn("eto", F.round("eto", 6))
