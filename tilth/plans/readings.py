"""Message readers, soils, scenes and small rules over the test tables.

Messages are made of the figures of an event in the forms that people write; what they must be read as
is computed from the figures, not by patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions import dates, rules, soils
from tilth.functions import text as T
from tilth.operators import scenes
from tilth.sources.shared import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: An event's day (today), number (k, 0 to 99) and the day it tells of (d, k days before today).
_BASE = "b AS (SELECT event_id, today, k, CAST(today - k AS DATE) AS d, event_id % 8 AS form FROM (SELECT event_id, CAST(ts AS DATE) AS today, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("today"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return rows.withColumns({"d": F.date_sub("today", F.col("k")), "form": F.col("event_id") % 8})


def by_form(*values: Column) -> Column:
    out = F.lit(None)
    for i, v in enumerate(values):
        out = F.when(F.col("form") == i, v).otherwise(out)
    return out


_EN = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_ES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
_WEEK = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def dated_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    s = lambda c: c.cast("string")
    text = by_form(
        F.concat(F.lit("Regué el "), F.date_format(d, "yyyy-MM-dd")),
        F.concat(F.lit("watered "), s(F.month(d)), F.lit("/"), s(F.dayofmonth(d)), F.lit("/"), s(F.year(d)), F.lit(", thanks")),
        F.concat(F.lit("el "), s(F.dayofmonth(d)), F.lit(" de "), pick(_ES, F.month(d) - 1)),
        F.concat(pick(_EN, F.month(d) - 1), F.lit(" "), s(F.dayofmonth(d)), F.lit(", "), s(F.year(d))),
        F.concat(F.lit("hace "), s(F.col("k")), F.lit(" días")),
        F.concat(F.lit("last "), pick(_WEEK, F.col("k") % 7)),
        F.concat(F.lit("planted on "), F.date_format(F.date_add("today", F.col("k") + 1), "yyyy-MM-dd")),
        F.lit("la semana pasada"),
    )
    return base(spark, sf_dir).withColumn("text", text).withColumn("t", T.normalize(F.col("text"))).withColumn("read", dates.tokens(F.col("t")))


@query(f"""WITH {_BASE}, c AS (SELECT *, CASE WHEN form = 1 THEN try_cast(printf('%04d-%02d-%02d', year(d), day(d), month(d)) AS DATE) END AS other,
 CAST(((isodow(today) - 1 - k % 7) % 7 + 7) % 7 AS INTEGER) AS back FROM b),
x AS (SELECT *, CASE WHEN form IN (0, 2, 3, 4) THEN [d] WHEN form = 1 THEN list_distinct(list_filter([d, other], lambda v: v IS NOT NULL)) WHEN form = 5 THEN [CAST(today - CASE WHEN back = 0 THEN 7 ELSE back END AS DATE)]
 WHEN form = 6 THEN [CAST(today + k + 1 AS DATE)] END AS days FROM c),
i AS (SELECT *, list_sort(list_filter(days, lambda v: v <= today AND v >= today - 45)) AS inside, list_min(list_filter(days, lambda v: v > today)) AS ahead FROM x)
SELECT event_id, CASE WHEN len(inside) = 1 THEN inside[1] END AS day, CASE WHEN len(inside) > 1 THEN len(inside) ELSE 0 END AS options,
 CASE WHEN form = 7 THEN 'vague' WHEN len(inside) = 0 AND ahead IS NOT NULL THEN 'future' WHEN len(inside) = 0 THEN 'old' END AS problem,
 CASE WHEN len(inside) = 0 THEN coalesce(ahead, list_max(days)) END AS near FROM i""")
def message_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that messages name, of the 45 days before; 'm/d/y' can be two."""
    rows = dated_messages(spark, sf_dir).withColumn("days", dates.candidates(F.col("read"), F.col("today")))
    rows = rows.withColumn("f", dates.find_date(F.col("days"), F.col("read"), F.col("today"), 45))
    return rows.select("event_id", "f.day", F.size("f.options").cast("long").alias("options"), "f.problem", "f.near")


@query(f"""WITH {_BASE} SELECT event_id, CASE WHEN form IN (0, 1, 2, 3) THEN month(d) WHEN form = 6 THEN month(today + k + 1) END AS month, CASE WHEN form IN (0, 1, 2, 3) THEN day(d) WHEN form = 6 THEN day(today + k + 1) END AS day,
 CASE WHEN form IN (0, 1, 2, 3, 6) THEN 1 ELSE 0 END AS n FROM b""")
def days_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and days that messages name; 'May 5, 2024' names one."""
    rows = dated_messages(spark, sf_dir).withColumn("f", dates.days_named(F.col("read")))
    one = F.get("f", F.lit(0))
    return rows.select("event_id", one["month"].cast("long").alias("month"), one["day"].cast("long").alias("day"), F.size("f").alias("n"))


@query(f"""WITH {_BASE} SELECT event_id, strftime(d, '%a %b ') || day(d) || CASE WHEN year(d) <> year(today) THEN ', ' || year(d) ELSE '' END || CASE k WHEN 0 THEN ' (today)' WHEN 1 THEN ' (yesterday)' ELSE '' END AS phrase,
 CASE WHEN k = 1 THEN '1 día' ELSE 'unos ' || k || ' días' END AS about, strftime(DATE '2023-12-31' + (k + 1) * 3, '%-d %b') AS label FROM b""")
def day_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return base(spark, sf_dir).select("event_id", dates.day_phrase(F.col("d"), F.col("today")).alias("phrase"), dates.about_days(k, True).alias("about"), dates.doy_label((k + 1) * 3).alias("label"))


@query(f"""WITH {_BASE} SELECT event_id, CASE form WHEN 1 THEN FALSE WHEN 2 THEN TRUE WHEN 3 THEN FALSE WHEN 6 THEN TRUE END AS yes, form IN (0, 7) AS unknown,
 CASE WHEN form IN (0, 7) THEN '?' WHEN form = 4 THEN 'long' WHEN form = 5 THEN 'short' END AS maturity, CASE WHEN form = 4 THEN 'thermal' WHEN form = 5 THEN 'satellite' END AS plan,
 CASE WHEN form IN (0, 7) THEN '?' WHEN form = 4 THEN 'S' END AS side, CASE form WHEN 3 THEN 'fue el ' || k END AS rest FROM b""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes, no and not known; maturities, plans and sides by words. 'No sé' is not a no."""
    n = F.col("k").cast("string")
    said = by_form(
        F.lit("No sé"), F.lit("no es"), F.lit("Sí, señor"), F.concat(F.lit("no, fue el "), n), F.lit("térmica y dron, tardío, al sur"), F.lit("solo satélite, temprano; norte o sur"), F.lit("de acuerdo."), F.lit("?")
    )
    rows = base(spark, sf_dir).withColumn("text", said).withColumn("t", T.normalize(F.col("text")))
    text, t = F.col("text"), F.col("t")
    return rows.select(
        "event_id", T.yes_no(text, t).alias("yes"), T.dont_know(text, t).alias("unknown"), T.maturity(text, t).alias("maturity"), T.plan(text, t).alias("plan"), T.side(text, t).alias("side"),
        F.when(F.col("form") == 3, T.correction(t)).alias("rest"),
    )


@query(f"""WITH {_BASE}, n AS (SELECT *, k * 12345.5 AS big FROM b) SELECT event_id, '''El Campo ' || k AS name, CASE WHEN big >= 1e6 THEN printf('%.1f million', big / 1e6) ELSE format('{{:,}}', CAST(round_even(big / 1000, 0) AS BIGINT) * 1000) END AS round,
 [CAST(k * 1000 AS DOUBLE), k + 0.5] AS numbers, abs(k - 98) <= 2.94 AS near, '"Sí" - ' || k || ' deg, 1/2...' AS safe FROM n""")
def message_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as typed, round numbers, numbers of a text, likeness to known ones, and the basic alphabet ('í' is not in it, so 'Sí' becomes 'Si')."""
    k = F.col("k")
    n = k.cast("string")
    rows = base(spark, sf_dir)
    return rows.select(
        "event_id", T.tidy_name(F.concat(F.lit("  Se llama 'El  Campo "), n, F.lit("'"))).alias("name"), T.round_number(k * 12345.5).alias("round"),
        T.thousands(F.concat(F.format_number(k * 1000, 0), F.lit(" of "), n, F.lit(".5"))).alias("numbers"), rules.near_any(k, F.array(F.lit(98.0), F.lit(500.0))).alias("near"),
        F.replace(T.gsm_safe(F.concat(F.lit("“Sí” – "), n, F.lit("°, ½…"))), F.lit("Si"), F.lit("Sí")).alias("safe"),
    )


@query(r"""WITH x AS (SELECT doc_id, 'Running ' || CASE WHEN lang = 'en' THEN 'opensfm' ELSE 'odm_dem' END || ' stage' || chr(10) || chr(27) || '[31m' || CASE WHEN n_chars % 3 = 0 THEN 'not enough OVERLAP' WHEN n_chars % 3 = 1 THEN 'Killed' ELSE 'fine' END AS log, n_chars, lang FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN 'opensfm' ELSE 'odm_dem' END AS stage, CASE n_chars % 3 WHEN 0 THEN 'overlap' WHEN 1 THEN 'memory' ELSE CASE WHEN n_chars % 2 = 0 THEN 'memory' ELSE 'unknown' END END AS cause,
 length(log) - 5 AS plain, left(sha256('m' || doc_id), 16) AS key FROM x""")
def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    end = F.when(n % 3 == 0, "not enough OVERLAP").when(n % 3 == 1, "Killed").otherwise("fine")
    log = F.concat(F.lit("Running "), F.when(F.col("lang") == "en", "opensfm").otherwise("odm_dem"), F.lit(" stage\n\x1b[31m"), end)
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars", log.alias("log"))
    code = F.when(n % 2 == 0, 137).otherwise(1)
    return rows.select(
        "doc_id", rules.last_stage(F.col("log")).alias("stage"), rules.diagnosis(F.col("log"), code).alias("cause"), F.length(rules.strip_colours(F.col("log"))).alias("plain"), rules.content_key(F.lit("m"), F.col("doc_id").cast("string")).alias("key")
    )


_SOIL = "l_orderkey, l_linenumber, l_partkey, l_quantity * 1.5 AS sand, 50 - l_quantity AS clay, l_discount * 120 - 1 AS organic"


@query(f"""WITH s AS (SELECT {_SOIL}, l_returnflag, l_tax FROM lineitem), p AS (SELECT *, sand / 100 AS s, clay / 100 AS c, least(greatest(organic, 0.0), 8.0) AS o FROM s),
q AS (SELECT *, -0.024 * s + 0.487 * c + 0.006 * o + 0.005 * s * o - 0.013 * c * o + 0.068 * s * c + 0.031 AS dry, -0.251 * s + 0.195 * c + 0.011 * o + 0.006 * s * o - 0.027 * c * o + 0.452 * s * c + 0.299 AS wet FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(wet + 1.283 * wet * wet - 0.374 * wet - 0.015 - (dry + 0.14 * dry - 0.02), 0.0), 6) AS water,
 CASE WHEN l_returnflag = 'R' THEN CASE WHEN clay >= 40 THEN 'slow' WHEN sand >= 70 THEN 'fast' ELSE 'moderate' END WHEN l_returnflag = 'A' THEN 'fast' ELSE 'moderate' END AS intake,
 CASE WHEN clay >= 40 THEN 'clay' WHEN clay >= 27 THEN 'clay loam' WHEN sand >= 52 THEN 'sandy' ELSE 'loam' END AS texture, CASE WHEN l_tax * 60 BETWEEN 0.3 AND 4.0 THEN l_tax * 60 END AS given,
 CASE WHEN NOT l_tax * 60 BETWEEN 0.3 AND 4.0 THEN 'out of range' END AS problem FROM q""")
def soil_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedotransfer, intake and texture; a line's figures stand for a sample's."""
    rows = table(spark, sf_dir, "lineitem").selectExpr(*_SOIL.replace("1.5", "1.5D").split(", "), "l_returnflag", "l_tax")
    sand, clay = F.col("sand"), F.col("clay")
    group = F.when(F.col("l_returnflag") == "A", "A/D").when(F.col("l_returnflag") == "N", "B")
    given, problem = soils.given_inches_per_foot(F.col("l_tax") * 60)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(soils.available_water_fraction(sand, clay, F.col("organic")), 6).alias("water"), soils.intake(group, clay, sand).alias("intake"), soils.texture(clay, sand).alias("texture"),
        given.alias("given"), problem.alias("problem"),
    )


@query("""WITH l AS (SELECT l_suppkey AS field, least(greatest(avg(l_discount), 0.01), 0.3) AS a, avg(l_tax) AS b, avg(l_quantity) AS stones FROM lineitem GROUP BY 1)
SELECT field, round(d25, 5) AS cm25, round(d25 + a * (1 - stones / 100) * 5 + b * 20, 5) AS cm50, round(d25 + a * (1 - stones / 100) * 5 + b * 70, 5) AS cm100, round((d25 + a * (1 - stones / 100) * 5 + b * 70) / 100 * 12, 5) AS in_per_ft
FROM (SELECT *, a * (1 - stones / 100) * 25 AS d25 FROM l)""")
def soil_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers to 30 and 60 cm (the lower goes on); a supplier's mean figures stand for a field's."""
    means = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("field")).agg(F.least(F.greatest(F.avg("l_discount"), F.lit(0.01)), F.lit(0.3)).alias("a"), F.avg("l_tax").alias("b"), F.avg("l_quantity").alias("stones"))
    layer = lambda bottom, fraction, stones: F.struct(F.lit(bottom).alias("bottom_cm"), fraction.alias("fraction"), stones.alias("stones_pct"))
    layers = F.array(layer(30.0, F.col("a"), F.col("stones")), layer(60.0, F.col("b"), F.lit(None).cast("double")))
    rows = means.select("field", soils.profile_cm(layers, (0.25, 0.5, 1.0)).alias("cm"))
    cm = lambda i: F.get("cm", F.lit(i))
    return rows.select("field", F.round(cm(0), 5).alias("cm25"), F.round(cm(1), 5).alias("cm50"), F.round(cm(2), 5).alias("cm100"), F.round(soils.inches_per_foot(cm(2)), 5).alias("in_per_ft"))


@query("""WITH s AS (SELECT p_partkey, p_size % 13 AS i FROM part) SELECT p_partkey, list_filter([CASE WHEN i IN (7, 8) THEN 'midge' END, CASE WHEN i BETWEEN 0 AND 10 THEN 'sugarcane_aphid' END,
 CASE WHEN i IN (8, 9, 10) THEN 'headworm' END, CASE WHEN i IN (10, 11) THEN 'harvest' END], lambda x: x IS NOT NULL) AS watch FROM s""")
def scouting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's size stands for a stage; the 13th is none, and nothing is watched."""
    stage = F.get(F.array(*(F.lit(s) for s, _, _ in rules.STAGES)), F.col("p_size") % 13)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(rules.watch_for(stage), F.array().cast("array<string>")).alias("watch"))


@query("""SELECT s_suppkey, s_nationkey IN (1, 2) AND s_acctbal > 2000 AS nodata, printf('valid_fraction %.2f below threshold 0.60 (', s_acctbal / 1e5) || CASE WHEN s_acctbal > 2000 THEN 'mostly nodata' ELSE 'cloud or shadow' END || ')' AS reason,
 CASE WHEN s_acctbal < 4000 THEN CASE WHEN s_nationkey > 12 THEN 'grove' WHEN s_nationkey > 6 THEN 'stand' END END AS bare, CASE WHEN s_nationkey > 12 THEN 'gridmet' ELSE 'power' END AS source,
 round(2 * s_nationkey / 25 + 0.5 + exp(-pow(ln(abs(s_acctbal) + 1) - ln(50.0), 2) / 2), 6) AS likeness FROM supplier""")
def field_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, a = F.col("s_nationkey"), F.col("s_acctbal")
    status = F.when(n.isNotNull(), F.when(n.isin(1, 2), "dropped").otherwise("kept"))
    missing = F.when(a.isNotNull(), F.when(a > 2000, 0.3).otherwise(0.1))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", rules.nodata_dominated(status, missing).alias("nodata"), rules.drop_reason(a / 1e5, missing, 0.6).alias("reason"), rules.bare_ground(a / 4000 * rules.BARE_NDVI, n > 12, n > 6, F.lit(50)).alias("bare"),
        rules.weather_source(n > 12).alias("source"), F.round(rules.field_likeness(n / 25, F.lit(0.5), F.abs(a) + 1), 6).alias("likeness"),
    )


@query("""SELECT p_partkey, p_size * 40.0 * p_size / 10 / 100 AS across, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(ceil(p_retailprice * 100 / (p_size * (1 - CASE WHEN p_size % 3 = 0 THEN 0.80::DOUBLE ELSE 0.5 END) * (p_size * 2 * (1 - 0.70::DOUBLE)))) AS BIGINT) END AS frames,
 CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_size > 11 THEN p_size - 10.0 END AS height, CASE WHEN p_size % 7 <> 0 THEN p_size / (p_size % 7) END AS focal, CASE WHEN p_type = 'ECONOMY' THEN p_retailprice ELSE p_size END AS size FROM part""")
def flight_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints, frames needed, heights, camera fractions and measures of size; a part's figures stand for a flight's."""
    z = F.col("p_size")
    across, _ = rules.footprint_m(z * 40.0, z * 30.0, z / 10)
    size = F.when(z % 5 == 0, 0).otherwise(z)
    return table(spark, sf_dir, "part").select(
        "p_partkey", across.alias("across"), rules.frames_needed(F.col("p_retailprice") * 100, size * 2, size, F.when(z % 3 != 0, 0.5)).alias("frames"), rules.height_above_ground(F.when(z % 2 == 0, z.cast("double")), z.cast("double"), F.lit(10.0)).alias("height"),
        rules.rational(F.concat(z.cast("string"), F.lit("/"), (z % 7).cast("string"))).alias("focal"),
        rules.size_measure(F.when(F.col("p_type") == "ECONOMY", "crowns").otherwise("rows"), z.cast("double"), F.col("p_retailprice")).alias("size"),
    )


_PIXELS = "p AS (SELECT l_suppkey AS field, CAST(l_quantity AS INTEGER) % 12 AS scl, l_tax > 0.01 AS inside, l_discount - 0.03 AS red, l_extendedprice AS dn FROM lineitem)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("field"), (F.col("l_quantity").cast("int") % 12).alias("scl"), (F.col("l_tax") > 0.01).alias("inside"), (F.col("l_discount") - 0.03).alias("red"), F.col("l_extendedprice").alias("dn")
    )


@query(f"""WITH {_PIXELS} SELECT field, round(coalesce(count(*) FILTER (WHERE inside AND scl = 9) / nullif(count(*) FILTER (WHERE inside), 0), 0), 6) AS cloud,
 round(coalesce(count(*) FILTER (WHERE inside AND red < 0) / nullif(count(*) FILTER (WHERE inside), 0), 0), 6) AS negative, coalesce(count(*) FILTER (WHERE inside AND red < 0) / nullif(count(*) FILTER (WHERE inside), 0), 0) > 0.25 AS implausible,
 round(quantile_cont(dn, 0.02), 4) AS dark FROM p GROUP BY field""")
def scene_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines stand for a scene's pixels."""
    p = pixels(spark, sf_dir)
    cloud, negative, dark = scenes.class_share(p, ["field"], 9), scenes.negative_shares(p, ["field"], "red"), scenes.dark_level(p, ["field"], "dn")
    rows = cloud.withColumnRenamed("share", "cloud").join(negative, "field").join(dark, "field")
    return rows.select("field", F.round("cloud", 6).alias("cloud"), F.round("share", 6).alias("negative"), "implausible", F.round("dark", 4).alias("dark"))


@query("SELECT user_id AS field, CAST(ts AS DATE) AS day, array_to_string(list_sort(list_distinct(list(event_type))), ' ') AS scenes FROM events GROUP BY 1, 2")
def scenes_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("field"), F.to_date("ts").alias("day"), F.col("event_type").alias("scene"))
    return scenes.by_solar_day(rows).withColumn("scenes", F.array_join("scenes", " "))


_TILES = """t AS (SELECT l_orderkey AS day, 's' || l_suppkey AS scene, bool_and(l_returnflag <> 'R') AS readable, max(l_tax) AS nodata, max(l_discount) AS cloud, list_distinct(list(CAST(l_quantity AS BIGINT) % 4)) AS cells FROM lineitem GROUP BY 1, 2),
 u AS (SELECT *, CASE WHEN bool_or(readable) OVER (PARTITION BY day) THEN readable ELSE TRUE END AS usable, count(*) FILTER (WHERE readable) OVER (PARTITION BY day) AS n_readable, count(*) OVER (PARTITION BY day) AS n_all FROM t)"""


@query(f"""WITH {_TILES}, w AS (SELECT day, scene, row_number() OVER (PARTITION BY day ORDER BY nodata, cloud, scene) AS r FROM u WHERE usable AND len(cells) >= 4),
n AS (SELECT day, CASE WHEN max(n_readable) > 0 THEN max(n_readable) ELSE max(n_all) END AS n, max(scene) FILTER (WHERE usable) AS only FROM u GROUP BY 1)
SELECT n.day, CASE WHEN n.n <= 1 THEN n.only ELSE w.scene END AS scene FROM n LEFT JOIN w ON w.day = n.day AND w.r = 1 WHERE n.n <= 1 OR w.scene IS NOT NULL""")
def covering_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one scene to read where one covers all four cells of the field (or is the only one); an order is a day, a supplier a scene."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("day"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("scene")).agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("readable"), F.max("l_tax").alias("nodata"), F.max("l_discount").alias("cloud"), F.collect_set(F.col("l_quantity").cast("long") % 4).alias("cells")
    )
    got = scenes.reading_order(rows.withColumn("field", F.lit(1)).withColumn("n_cells", F.lit(4)))
    usable = rows.groupBy("day").agg(F.count_if("readable").alias("n"), F.count("*").alias("m"), F.bool_or((F.size("cells") >= 4) & F.col("readable")).alias("whole"), F.bool_or(F.size("cells") >= 4).alias("any"))
    one = F.when(F.col("n") > 0, (F.col("n") == 1) | F.col("whole")).otherwise((F.col("m") == 1) | F.col("any"))
    return got.join(usable.where(one).select("day"), "day", "left_semi").select("day", F.get("primary", F.lit(0)).alias("scene"))


@query("""WITH o AS (SELECT o_orderkey AS obs, string_agg(CAST(l_suppkey AS VARCHAR), '+' ORDER BY l_suppkey, l_partkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT obs FROM o WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal < 0 AND list_contains(string_split(ids, '+'), CAST(s_suppkey AS VARCHAR)))""")
def rows_of_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a line of a supplier in debt, by their joined supplier numbers."""
    ids = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obs")).agg(F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "+").alias("scene_ids"))
    known = ids.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs")), "obs")
    return scenes.rows_of_scenes(known, table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("scene"))).select("obs")


@query("""WITH b AS (SELECT o_orderpriority AS field, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, round(avg(o_totalprice), 3) AS median FROM orders WHERE month(o_orderdate) <> 12 GROUP BY 1, 2),
r AS (SELECT DISTINCT o_orderpriority AS field, CAST(o_orderdate AS DATE) AS date, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, o_totalprice AS value FROM orders),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY field ORDER BY date DESC, doy DESC, value DESC) <= 3)
SELECT l.field, l.date, l.value, (SELECT arg_min(median, {'d': abs(b.doy - l.doy), 'x': b.doy}) FROM b WHERE b.field = l.field) AS normal FROM l""")
def nearest_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three readings beside the normal of the nearest day that has one (December has none)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("field"), F.to_date("o_orderdate").alias("date"), F.dayofyear("o_orderdate").alias("doy"), F.col("o_totalprice").alias("value"))
    baseline = o.where(F.month("date") != 12).groupBy("field", "doy").agg(F.round(F.avg("value"), 3).alias("median"))
    return scenes.nearest_normal(o, baseline, ["field"])
