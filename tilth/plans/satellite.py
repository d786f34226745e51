"""Climatology, scoring, triage and reporting queries.

An order stands for an observation: the priority is the field, the order date the day, the price the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import climatology as C
from tilth.operators import merges, sequences
from tilth.sources.shared import table

KEYS = ["field"]
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.to_date("o_orderdate").alias("date"), F.dayofyear("o_orderdate").alias("doy"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("year").between(1995, 1998))


_OBS = """obs AS (SELECT o_orderpriority AS field, CAST(o_orderdate AS DATE) AS date, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value, o_orderkey AS id FROM orders),
hist AS (SELECT * FROM obs WHERE year BETWEEN 1995 AND 1998), days AS (SELECT CAST(range AS INTEGER) AS doy FROM range(1, 367)), fields AS (SELECT DISTINCT field FROM hist)"""
_CLIM = _OBS + """, clim AS (SELECT f.field, d.doy, quantile_cont(h.value, 0.10) AS p10, quantile_cont(h.value, 0.25) AS p25, quantile_cont(h.value, 0.50) AS median, quantile_cont(h.value, 0.75) AS p75, quantile_cont(h.value, 0.90) AS p90, count(h.value) AS n_obs, count(DISTINCT h.year) AS n_years
 FROM fields f CROSS JOIN days d LEFT JOIN hist h ON h.field = f.field AND least(abs(h.doy - d.doy), 366 - abs(h.doy - d.doy)) <= 12 GROUP BY f.field, d.doy)"""
_SMOOTH = _CLIM + """, ring AS (SELECT c.*, t.t, c.doy + t.t * 366 AS place FROM clim c CROSS JOIN (VALUES (-1), (0), (1)) t(t)),
sm AS (SELECT field, doy, t, avg(p10) OVER w AS p10, avg(p25) OVER w AS p25, avg(median) OVER w AS median, avg(p75) OVER w AS p75, avg(p90) OVER w AS p90, n_obs, n_years, median IS NULL AS was_null FROM ring WINDOW w AS (PARTITION BY field ORDER BY place ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)),
base AS (SELECT field, doy, p10, p25, median, p75, p90, n_obs, n_years, CAST(was_null AND median IS NOT NULL AS INTEGER) AS interpolated, CASE WHEN n_obs >= 6 AND n_years >= 3 THEN 'high' WHEN n_obs >= 3 AND n_years >= 2 THEN 'medium' WHEN n_obs >= 1 THEN 'low' ELSE 'none' END AS confidence FROM sm WHERE t = 0)"""
_ROUNDED = "field, doy, round(p10, 5) AS p10, round(p25, 5) AS p25, round(median, 5) AS median, round(p75, 5) AS p75, round(p90, 5) AS p90, n_obs, n_years"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 5).alias(c) if c in C.STATISTICS else c for c in df.columns))


@query(f"WITH {_CLIM} SELECT {_ROUNDED} FROM clim")
def doy_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.climatology(history(spark, sf_dir), KEYS))


@query(f"WITH {_SMOOTH} SELECT {_ROUNDED}, interpolated, confidence FROM base")
def climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(C.smoothed(C.climatology(history(spark, sf_dir), KEYS), KEYS))


@query(f"WITH {_SMOOTH} SELECT field, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low, count(*) FILTER (WHERE confidence = 'none') AS none FROM base GROUP BY field")
def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.smoothed(C.climatology(history(spark, sf_dir), KEYS), KEYS).groupBy("field").agg(*(F.count_if(F.col("confidence") == g).alias(g) for g in ("high", "medium", "low", "none")))


@query("""WITH obs AS (SELECT o_custkey AS field, CAST(o_orderdate AS DATE) AS date, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice AS value, o_orderkey AS id FROM orders),
hist AS (SELECT * FROM obs WHERE year BETWEEN 1995 AND 1998), days AS (SELECT CAST(range AS INTEGER) AS doy FROM range(1, 367)), fields AS (SELECT DISTINCT field FROM hist), clim AS (SELECT f.field, d.doy, quantile_cont(h.value, 0.10) AS p10, quantile_cont(h.value, 0.25) AS p25, quantile_cont(h.value, 0.50) AS median, quantile_cont(h.value, 0.75) AS p75, quantile_cont(h.value, 0.90) AS p90, count(h.value) AS n_obs, count(DISTINCT h.year) AS n_years
 FROM fields f CROSS JOIN days d LEFT JOIN hist h ON h.field = f.field AND least(abs(h.doy - d.doy), 366 - abs(h.doy - d.doy)) <= 12 GROUP BY f.field, d.doy), g AS (SELECT field, doy, CASE WHEN n_obs >= 6 AND n_years >= 3 THEN 3 WHEN n_obs >= 3 AND n_years >= 2 THEN 2 WHEN n_obs >= 1 THEN 1 ELSE 0 END AS grade FROM clim),
r AS (SELECT *, doy - row_number() OVER (PARTITION BY field ORDER BY doy) AS run FROM g WHERE grade < 3)
SELECT field, min(doy) AS first_doy, max(doy) AS last_doy, count(*) AS days, CASE min(grade) WHEN 0 THEN 'none' WHEN 1 THEN 'low' ELSE 'medium' END AS worst FROM r GROUP BY field, run HAVING count(*) >= 5""")
def thin_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak days of the whole history; customers are fields, as they are seen seldom."""
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.to_date("o_orderdate").alias("date"), F.dayofyear("o_orderdate").alias("doy"), F.year("o_orderdate").alias("year"), F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("id"))
    return C.thin_stretches(C.smoothed(C.climatology(seen.where(F.col("year").between(1995, 1998)), KEYS), KEYS), KEYS)


_SCORE = _SMOOTH + """, season AS (SELECT * FROM obs WHERE year = 1999), pooled AS (SELECT s.id, count(*) FILTER (WHERE h.value < s.value) AS below, count(*) FILTER (WHERE h.value = s.value) AS ties, count(*) AS n FROM season s JOIN hist h ON h.field = s.field AND least(abs(h.doy - s.doy), 366 - abs(h.doy - s.doy)) <= 12 GROUP BY s.id),
scored AS (SELECT s.field, s.date, s.id, s.doy, s.value, b.median, b.p10, 100.0 * (p.below + 0.5 * p.ties) / p.n AS percentile, CASE WHEN (b.p75 - b.p25) / 1.349 <= 0 THEN 0.0 ELSE (s.value - b.median) / ((b.p75 - b.p25) / 1.349) END AS z, coalesce(s.value < b.p10, FALSE) AS below_p10, b.confidence FROM season s LEFT JOIN base b ON b.field = s.field AND b.doy = s.doy LEFT JOIN pooled p ON p.id = s.id)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = history(spark, sf_dir)
    season = observations(spark, sf_dir).where("year = 1999")
    base = C.smoothed(C.climatology(past, KEYS), KEYS)
    return C.score_observations(season, base, past, KEYS)


@query(f"WITH {_SCORE} SELECT field, date, id, round(value, 3) AS value, round(percentile, 4) AS percentile, round(z, 4) AS z, below_p10, confidence FROM scored")
def season_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("field", "date", "id", F.round("value", 3).alias("value"), F.round("percentile", 4).alias("percentile"), F.round("z", 4).alias("z"), "below_p10", "confidence")


_TERM = """SELECT field, count(*) FILTER (WHERE low) AS low_run, count(*) FILTER (WHERE dep) AS depressed_run, coalesce(quantile_cont(short, 0.5) FILTER (WHERE dep), 0.0) AS shortfall, arg_max(confidence, {'d': date, 'i': id}) AS confidence, count(*) AS n_observations
 FROM (SELECT field, date, id, confidence, max(CASE WHEN below_p10 THEN 0 ELSE 1 END) OVER w = 0 AS low, max(CASE WHEN coalesce(z < 0, FALSE) THEN 0 ELSE 1 END) OVER w = 0 AS dep, (median - value) / greatest(abs(median), 0.2) AS short FROM %s WINDOW w AS (PARTITION BY field ORDER BY date DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY field"""
_TERMS = "SELECT *, depressed_run >= 6 AND shortfall >= 0.10 AS sustained, CASE WHEN depressed_run = 0 THEN 0.0 ELSE (least(greatest(shortfall, 0.0), 0.4) / 0.4 + least(greatest(low_run, CASE WHEN depressed_run >= 6 AND shortfall >= 0.10 THEN depressed_run ELSE 0 END), 4) / 4.0) / 2 END AS term FROM (%s)"


@query(f"""WITH {_SCORE}, a AS ({_TERMS % (_TERM % "(SELECT * FROM scored WHERE id % 2 = 0)")}), b AS ({_TERMS % (_TERM % "(SELECT * FROM scored WHERE id % 2 = 1)")})
SELECT a.field, round(100 * (0.75 * a.term + 0.25 * coalesce(b.term, 0.0)) * CASE a.confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 WHEN 'low' THEN 0.6 ELSE 0.0 END, 1) AS score, (a.low_run >= 2 OR a.sustained) AS flagged,
 (a.low_run >= 2 OR a.sustained) AND (coalesce(b.low_run > 0, FALSE) OR coalesce(b.sustained, FALSE)) AS water_stress, a.low_run AS n_low, a.depressed_run AS n_depressed, CASE WHEN a.low_run >= 2 THEN 'p10-run' WHEN a.sustained THEN 'sustained' ELSE '' END AS trigger, round(a.shortfall, 4) AS shortfall, a.confidence, a.n_observations FROM a LEFT JOIN b ON a.field = b.field""")
def triage_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even order keys are the first index, odd ones the second."""
    scored = _scores(spark, sf_dir)
    terms = C.index_terms(scored.withColumn("index", F.col("id") % 2), [*KEYS, "index"], ["date", "id"])
    return C.rank_fields(C.field_scores(terms, KEYS, "index"), KEYS).withColumn("shortfall", F.round("shortfall", 4))


@query("""WITH m AS (SELECT o_custkey AS field, CAST(o_orderdate AS DATE) AS d FROM orders GROUP BY 1, 2), l AS (SELECT field, lag(d) OVER (PARTITION BY field ORDER BY d) AS gap_start, d AS gap_end FROM m) SELECT field, gap_start, gap_end, CAST(gap_end - gap_start AS INTEGER) AS days FROM l WHERE gap_end - gap_start >= 30""")
def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.to_date("o_orderdate").alias("date"))
    return sequences.gaps(rows, KEYS, "date")


@query("SELECT c_custkey, c_mktsegment, count(*) AS n_obs, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days, min(CAST(o_orderdate AS DATE)) AS first, max(CAST(o_orderdate AS DATE)) AS last, round(avg(o_totalprice), 6) AS mean FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n_obs"), F.count_distinct("d").alias("n_days"), F.min("d").alias("first"), F.max("d").alias("last"), F.round(F.avg("o_totalprice"), 6).alias("mean"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(counts, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE abs(l_discount) >= 0.09) AS saturated, round(count(*) FILTER (WHERE abs(l_discount) >= 0.09) / count(*), 6) AS share FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (WHERE abs(l_discount) >= 0.09) > 0.05 * count(*)")
def saturation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.count_if(F.abs("l_discount") >= 0.09)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), hit.alias("saturated"), F.round(hit / F.count("*"), 6).alias("share")).where("saturated > 0.05 * n")


@query("SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS status, max(event_id) AS attempt FROM events GROUP BY 1, 2")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("status"), F.col("event_id").alias("attempt"))
    return merges.latest(rows, ["user_id", "day"], ["attempt"])


@query("WITH l AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, event_id) AS status FROM events GROUP BY 1, 2) SELECT user_id, count(*) FILTER (WHERE status = 'view') AS view, count(*) FILTER (WHERE status = 'click') AS click, count(*) FILTER (WHERE status = 'purchase') AS purchase, count(*) FILTER (WHERE status = 'signup') AS signup, count(*) FILTER (WHERE status = 'error') AS error FROM l GROUP BY user_id")
def status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["view", "click", "purchase", "signup", "error"]
    return latest_attempt(spark, sf_dir).groupBy("user_id").pivot("status", kinds).count().na.fill(0, kinds)


@query("SELECT user_id, event_type, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def weather_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END * 1000000000 + event_id AS r, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS eto, CASE WHEN event_id % 2 = 0 THEN NULL ELSE value END AS tmax FROM events)
SELECT user_id, day, (array_agg(eto ORDER BY r))[1] AS eto, (array_agg(tmax ORDER BY r) FILTER (WHERE tmax IS NOT NULL))[1] AS tmax FROM e GROUP BY 1, 2""")
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event type is the source; eto comes from the best source even if NULL, tmax from the best that has it."""
    value, i = F.col("value"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", F.when(i % 3 != 0, value).alias("eto"), F.when(i % 2 != 0, value).alias("tmax"))
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "view", 1).otherwise(2) * F.lit(1_000_000_000) + i
    return merges.priority_merge(rows, ["user_id", "day"], rank, ["eto"], ["tmax"])


_UPSERT = "SELECT o_custkey AS k, max(o_orderkey) AS v, round(max(o_totalprice), 2) AS t FROM orders WHERE %s GROUP BY 1"


@query(f"WITH a AS ({_UPSERT % 'year(o_orderdate) <= 1997'}), b AS ({_UPSERT % 'year(o_orderdate) > 1997'}) SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, CASE WHEN b.k IS NOT NULL THEN b.t ELSE a.t END AS t FROM a FULL JOIN b ON a.k = b.k")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = (table(spark, sf_dir, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v"), F.round(F.max("o_totalprice"), 2).alias("t")) for c in ("year(o_orderdate) > 1997", "year(o_orderdate) <= 1997"))
    return merges.upsert(old, new, ["k"])


@query(f"WITH a AS ({_UPSERT % 'year(o_orderdate) <= 1997'}), b AS ({_UPSERT % 'year(o_orderdate) > 1996'}) SELECT coalesce(b.k, a.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'missing' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    new, old = (table(spark, sf_dir, "orders").where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("v")) for c in ("year(o_orderdate) > 1996", "year(o_orderdate) <= 1997"))
    return merges.sync_status(old, new, ["k"], "v")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')")
def anti_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return merges.not_done(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), done, ["c_custkey"])


@query("""WITH f AS (SELECT l_suppkey, arg_max(l_orderkey, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber}) AS l_orderkey, arg_max(l_quantity, {'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber}) AS l_quantity, count(*) - 1 AS superseded FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY 1)
SELECT coalesce(s_suppkey, l_suppkey) AS field, s_nationkey, l_orderkey, l_quantity, superseded FROM (SELECT * FROM supplier WHERE s_suppkey % 5 <> 0) FULL JOIN f ON s_suppkey = l_suppkey""")
def latest_join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "supplier").where("s_suppkey % 5 != 0").select(F.col("s_suppkey").alias("field"), "s_nationkey")
    flights = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 != 0").select(F.col("l_suppkey").alias("field"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    return merges.join_views(ranked, flights, "field", ["l_shipdate", "l_orderkey", "l_linenumber"]).select("field", "s_nationkey", "l_orderkey", "l_quantity", "superseded")


@query("SELECT field, count(*) FILTER (WHERE run) AS run, count(*) AS n FROM (SELECT user_id AS field, max(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 0 AS run FROM events) GROUP BY field")
def trailing_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("field"), "ts", "event_id", "value")
    return sequences.trailing_runs(rows, KEYS, ["ts", "event_id"], F.col("value") < 60)


@query("""WITH a AS (SELECT s_nationkey, s_suppkey, sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS d FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
SELECT s_nationkey, round(sum(w * d) / sum(w), 6) AS weighted, arg_max(s_suppkey, {'w': w, 's': -s_suppkey}) AS dominant, round(max(w) / sum(w), 6) AS share FROM a GROUP BY 1""")
def weighted_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("w"), (F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity")).alias("d"))
    rows = units.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    return rows.groupBy("s_nationkey").agg(F.round(F.sum(F.col("w") * F.col("d")) / F.sum("w"), 6).alias("weighted"), F.max_by("l_suppkey", F.struct("w", -F.col("l_suppkey"))).alias("dominant"), F.round(F.max("w") / F.sum("w"), 6).alias("share"))


@query("SELECT year, max(n) AS largest, round(max(n) / sum(n), 6) AS share FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'idle' ELSE o_orderpriority END AS class, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY year")
def modal_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "idle").otherwise(F.col("o_orderpriority"))
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), kind.alias("class")).agg(F.count("*").alias("n"))
    return counts.groupBy("year").agg(F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type, priority FROM (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 ELSE 5 END AS priority FROM events WHERE value > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 90)) ORDER BY user_id, priority, event_id")
def reminder_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one reminder for each user, by priority, for users who have not opted out."""
    events = table(spark, sf_dir, "events")
    out = events.where("event_type = 'signup' and value > 90").select("user_id").distinct()
    kind = F.col("event_type")
    rank = F.when(kind == "error", 1).when(kind == "purchase", 2).when(kind == "signup", 3).when(kind == "click", 4).otherwise(5)
    rows = events.where("value > 20").join(out, "user_id", "left_anti").select("user_id", "event_id", "event_type", rank.alias("priority"))
    return rows.groupBy("user_id").agg(F.min_by(F.struct("event_id", "event_type", "priority"), F.struct("priority", "event_id")).alias("r")).select("user_id", "r.*")
