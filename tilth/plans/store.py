"""Views of a store of fields, events, messages, links and alerts over the test tables.

A user of `events` is a field, ten of which in turn belong to one phone; a customer is a field with its state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions import rules
from tilth.operators import store as S
from tilth.sources.shared import table

QUERIES, ORACLE_SQL = {}, {}
NOW = "2024-01-20 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "irrigated").when(F.col("event_type") == "purchase", "rain").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("field"), F.to_date("ts").alias("day"), kind.alias("kind"), F.round("value", 2).alias("inches"))


def standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    return S.standing_events(rows, rows.where("inches > 180").select("id"))


_STANDING = """e AS (SELECT event_id AS id, user_id AS field, CAST(ts AS DATE) AS day, round(value, 2) AS inches,
  CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'irrigated' WHEN 'purchase' THEN 'rain' ELSE event_type END AS kind FROM events),
 last AS (SELECT max(id) AS id FROM e WHERE kind <> 'photo' GROUP BY field, day, kind UNION ALL SELECT id FROM e WHERE kind = 'photo'),
 standing AS (SELECT e.* FROM e JOIN last USING (id) WHERE inches <= 180)"""


@query(f"WITH {_STANDING} SELECT id, field, day, kind, inches FROM standing")
def standing_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that stand; those of more than 180 were voided."""
    return standing(spark, sf_dir).select("id", "field", "day", "kind", "inches")


@query(f"WITH {_STANDING} SELECT field // 10 AS phone, max(id) AS id, arg_max(field, id) AS field, arg_max(kind, id) AS kind FROM standing GROUP BY 1")
def last_event_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = reports(spark, sf_dir).select("field", F.floor(F.col("field") / 10).alias("phone")).distinct()
    return S.last_event_of(standing(spark, sf_dir), fields)


@query(f"""WITH {_STANDING}, starts AS (SELECT field, min(day) + 5 AS start FROM e GROUP BY field)
SELECT s.field, round(coalesce(sum(inches) FILTER (WHERE kind = 'irrigated'), 0), 2) AS irrigated, round(coalesce(sum(inches) FILTER (WHERE kind = 'rain'), 0), 2) AS rain
FROM starts s LEFT JOIN standing t ON t.field = s.field AND t.day >= s.start GROUP BY s.field""")
def water_put_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums since five days after each field's first report."""
    starts = reports(spark, sf_dir).groupBy("field").agg(F.date_add(F.min("day"), 5).alias("start"))
    return S.water_put_on(standing(spark, sf_dir), starts).select("field", F.round("irrigated", 2).alias("irrigated"), F.round("rain", 2).alias("rain"))


_MARKS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'sent' WHEN 'signup' THEN 'kept' ELSE 'sending' END"


@query(f"""WITH m AS (SELECT user_id AS id, event_id AS seq, {_MARKS} AS status, CASE WHEN value > 100 THEN 'p' || event_id END AS provider_id, CASE WHEN event_type = 'error' THEN 'no route' END AS error, ts FROM events)
SELECT id, arg_max(status, seq) AS status, arg_max_null(error, seq) AS error, arg_max(provider_id, seq) AS provider_id, arg_max(ts, seq) FILTER (WHERE status IN ('sent', 'kept')) AS sent_at FROM m GROUP BY id""")
def message_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a message, each event a mark of it."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "view", "sent").when(kind == "signup", "kept").otherwise("sending")
    marks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("value") > 100, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("provider_id"),
        F.when(kind == "error", "no route").alias("error"), F.col("ts").alias("at"),
    )
    messages = marks.select("id").distinct().select("id", F.lit("sending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("sent_at"))
    return S.message_states(messages, marks).select("id", "status", "error", "provider_id", "sent_at")


@query(f"""SELECT event_id, user_id FROM (SELECT *, CASE WHEN value < 100 THEN ts + INTERVAL 8 HOUR END AS send_after FROM events)
WHERE event_type IN ('click', 'view') AND (send_after IS NULL OR send_after <= TIMESTAMP '{NOW}')""")
def queued_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views are outgoing messages; those under 100 wait eight hours."""
    out = F.col("event_type").isin("click", "view")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.when(out, "out").otherwise("in").alias("direction"), F.lit("queued").alias("status"), F.when(F.col("value") < 100, F.col("ts") + F.expr("interval 8 hours")).alias("send_after")
    )
    return S.due(rows, now()).select("event_id", "user_id")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("field"), F.col("event_type").alias("kind"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("token"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("interval 9 days")).alias("expires_at")
    )


_LINKS = "l AS (SELECT user_id AS field, event_type AS kind, 't' || event_id AS token, ts AS created_at, ts + INTERVAL 9 DAY AS expires_at FROM events)"


@query(f"""WITH {_LINKS}, w AS (SELECT DISTINCT field, k.kind FROM l, (VALUES ('view'), ('error'), ('map')) k(kind)),
o AS (SELECT field, kind, arg_max(token, {{'c': created_at, 't': token}}) AS token FROM l WHERE expires_at >= TIMESTAMP '{NOW}' GROUP BY 1, 2)
SELECT w.field, w.kind, o.token, CASE WHEN o.token IS NULL THEN TIMESTAMP '{NOW}' + INTERVAL 14 DAY END AS expires_at FROM w LEFT JOIN o ON o.field = w.field AND o.kind = w.kind""")
def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field wants a view, an error and a map link."""
    have = links(spark, sf_dir)
    wanted = have.select("field").distinct().select("field", F.explode(F.array(*map(F.lit, ("view", "error", "map")))).alias("kind"))
    return S.links_to_make(wanted, have, now(), 14)


@query(f"WITH {_LINKS} SELECT l.token, l.field, count(f.token) AS files, coalesce(sum(f.bytes), 0) AS bytes FROM l LEFT JOIN (SELECT 't' || l_orderkey AS token, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem) f ON f.token = l.token WHERE l.kind = 'purchase' GROUP BY 1, 2")
def upload_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are upload links; the lines of the order of that number are the files sent to it."""
    have = links(spark, sf_dir)
    files = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("token"), F.floor("l_extendedprice").alias("bytes"))
    return S.upload_counts(have.where("kind = 'purchase'").select("token"), files, have).select("token", "field", "files", "bytes")


@query("SELECT o_custkey AS field, o_orderpriority AS kind, max(o_orderdate) AS last FROM orders GROUP BY 1, 2")
def last_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_alerts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("field"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("sent_at")))


@query("""WITH top AS (SELECT greatest(max(s_suppkey), 7) AS top FROM supplier), n AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + top AS n FROM customer, top)
SELECT c_custkey, 'F' || CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id FROM n""")
def numbered_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are new fields beside suppliers, whose ids are taken."""
    key = F.col("s_suppkey").cast("string")
    old = table(spark, sf_dir, "supplier").select(F.concat(F.lit("F"), F.when(F.length(key) < 3, F.lpad(key, 3, "0")).otherwise(key)).alias("id"))
    return S.numbered_fields(table(spark, sf_dir, "customer").select("c_custkey"), old, F.lit(7), ["c_custkey"])


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1")
def forgotten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left when customers in debt are forgotten with all their orders."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.without_person(table(spark, sf_dir, "lineitem").select("l_orderkey"), orders, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


TODAY = "2000-01-05"
_FIELDS = f"""f AS (SELECT c_custkey AS field, c_custkey // 3 AS phone, c_acctbal > 0 AS alerts_on, c_mktsegment <> 'MACHINERY' AS idle, c_acctbal > 9000 AS no_water, c_acctbal < 8000 AS irrigated, c_nationkey = 3 AS waits,
  CAST(floor(abs(c_acctbal)) AS BIGINT) % 5 AS days_left, CAST(c_nationkey AS VARCHAR) AS cycle, CASE WHEN c_mktsegment = 'BUILDING' THEN 'sorghum' ELSE 'cotton' END AS crop, c_nationkey > 5 AS scout, c_nationkey > 12 AS has_place,
  CASE WHEN c_nationkey % 4 = 0 THEN 'map' WHEN c_nationkey % 4 = 1 THEN 'planted' WHEN c_nationkey % 4 = 2 THEN 'side' END AS ask FROM customer),
 a AS (SELECT o_custkey AS field, CASE o_orderpriority WHEN '1-URGENT' THEN 'water_now' WHEN '2-HIGH' THEN 'water_soon' WHEN '3-MEDIUM' THEN 'checkin' WHEN '4-NOT SPECIFIED' THEN 'scout' ELSE 'missing' END AS kind,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(c_nationkey AS VARCHAR) ELSE '2000-W01' END AS key, o_orderdate AS sent_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 AND o_orderdate <= '{TODAY}')"""


@query(f"""WITH {_FIELDS}, w AS (SELECT field, max(CAST(sent_at AS DATE)) AS d FROM a WHERE kind = 'water_now' GROUP BY 1), m AS (SELECT field, max(CAST(sent_at AS DATE)) AS d FROM a WHERE kind = 'missing' GROUP BY 1),
o AS (SELECT f.phone, f.field, 1 AS n, 'water_now' AS kind, cycle AS key FROM f WHERE alerts_on AND NOT waits AND NOT no_water AND irrigated AND days_left = 0
 UNION ALL SELECT f.phone, f.field, 2, 'water_soon', cycle FROM f WHERE alerts_on AND NOT waits AND NOT no_water AND irrigated AND days_left BETWEEN 1 AND 3
 UNION ALL SELECT f.phone, f.field, 3, 'checkin', cycle FROM f JOIN w ON w.field = f.field WHERE alerts_on AND NOT waits AND NOT no_water AND irrigated AND days_left = 0 AND idle AND DATE '{TODAY}' - w.d >= 3
 UNION ALL SELECT f.phone, f.field, 4, 'scout', '2000-W01' FROM f WHERE alerts_on AND NOT waits AND crop = 'sorghum' AND scout
 UNION ALL SELECT f.phone, f.field, 5, 'missing', ask || ':{TODAY}' FROM f LEFT JOIN m ON m.field = f.field WHERE alerts_on AND idle AND ask IS NOT NULL AND (m.d IS NULL OR DATE '{TODAY}' - m.d >= 7) AND (ask <> 'map' OR has_place)),
x AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.field = o.field AND a.kind = o.kind AND a.key = o.key))
SELECT DISTINCT ON (phone) phone, field, kind, key FROM x ORDER BY phone, n, field""")
def reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one reminder for each phone; a customer's figures stand for a field's state, its dear orders for alerts sent."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_nationkey")
    fields = c.select(
        F.col("c_custkey").alias("field"), F.floor(F.col("c_custkey") / 3).alias("phone"), (F.col("c_acctbal") > 0).alias("alerts_on"), (F.col("c_mktsegment") != "MACHINERY").alias("idle"), (F.col("c_acctbal") > 9000).alias("no_water"),
        (F.col("c_acctbal") < 8000).alias("irrigated"), (n == 3).alias("waits"), (F.floor(F.abs("c_acctbal")) % 5).alias("days_left"), n.cast("string").alias("cycle"), F.when(F.col("c_mktsegment") == "BUILDING", "sorghum").otherwise("cotton").alias("crop"),
        F.when(n > 5, F.array(F.lit("sugarcane_aphid"))).otherwise(F.array(F.lit("headworm"))).alias("watch"), (n > 12).alias("has_place"),
        F.array_compact(F.array(F.when(n % 4 == 0, "map"), F.when(n % 4 == 1, "planted"), F.when(n % 4 == 2, "side"))).alias("missing"),
    )
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in (("1-URGENT", "water_now"), ("2-HIGH", "water_soon"), ("3-MEDIUM", "checkin"), ("4-NOT SPECIFIED", "scout"), ("5-LOW", "missing")) for x in kv)), F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").where((F.col("o_totalprice") > 100_000) & (F.col("o_orderdate") <= F.lit(TODAY).cast("date"))).join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    key = F.when(F.col("kind").isin("water_now", "water_soon", "checkin"), n.cast("string")).otherwise("2000-W01")
    alerts = orders.select(F.col("o_custkey").alias("field"), kind.alias("kind"), "c_nationkey", F.col("o_orderdate").alias("sent_at")).select("field", "kind", key.alias("key"), "sent_at")
    return S.plan_reminders(fields, alerts, F.lit(TODAY).cast("date"))


@query("""SELECT c_custkey AS field, days_left, row_number() OVER (ORDER BY CASE WHEN no_water THEN 2 WHEN days_left IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN no_water OR days_left IS NULL THEN 0 ELSE days_left END,
 CASE WHEN no_water THEN 0 WHEN sensitive THEN 0 ELSE 1 END, c_custkey) AS rank
FROM (SELECT c_custkey, c_acctbal > 9000 AS no_water, c_mktsegment = 'BUILDING' AS sensitive, CASE WHEN c_nationkey > 4 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 20 END AS days_left FROM customer)""")
def fields_by_urgency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("field"), F.when(F.col("c_nationkey") > 4, F.floor(F.abs("c_acctbal")) % 20).alias("days_left"), (F.col("c_acctbal") > 9000).alias("no_water"), (F.col("c_mktsegment") == "BUILDING").alias("sensitive")
    )
    return S.by_urgency(rows)


@query("""WITH s AS (SELECT DISTINCT conv_id, turn, w FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)), p AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part),
n AS (SELECT conv_id, turn, p_partkey, count(*) AS score FROM s JOIN p USING (w) GROUP BY ALL) SELECT conv_id, turn, p_partkey AS field, score FROM n QUALIFY score = max(score) OVER (PARTITION BY conv_id, turn)""")
def named_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a turn names by most words of their names; all share one phone."""
    said = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.lit(1).alias("phone"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1).alias("words"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("field"), F.lit(1).alias("phone"), F.split("p_name", " ").alias("words"))
    return S.named_fields(said, parts).select("id.conv_id", "id.turn", "field", "score")


@query("""SELECT c_custkey, CASE WHEN plan IN ('drone', 'thermal') AND c_nationkey NOT IN (1, 2) AND c_acctbal <= 5000 THEN CASE WHEN c_nationkey = 3 THEN 'working' ELSE 'photos' END END AS waits, plan
FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'drone' WHEN 'MACHINERY' THEN 'thermal' WHEN 'FURNITURE' THEN CASE WHEN c_nationkey > 10 THEN 'drone' ELSE 'satellite' END ELSE 'satellite' END AS plan FROM customer)""")
def drone_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("c_nationkey"), F.col("c_mktsegment")
    plan = rules.plan_of(F.when(kind == "BUILDING", "drone").when(kind == "MACHINERY", "thermal"), F.when((kind == "FURNITURE") & (n > 10), "drone").when(kind == "FURNITURE", ""))
    flight = F.when(n == 1, "done").when(n == 2, "failed").when(n == 3, "working")
    return table(spark, sf_dir, "customer").select("c_custkey", rules.drone_wait(plan, flight, F.col("c_acctbal") > 5000).alias("waits"), plan.alias("plan"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'mature' WHEN c_mktsegment = 'MACHINERY' THEN 'not_irrigated' WHEN c_nationkey > 20 THEN NULL WHEN c_nationkey <= 0 THEN 'water_now' WHEN c_nationkey <= 3 THEN 'water_soon' ELSE 'no_water_yet' END AS action,
 c_mktsegment = 'FURNITURE' AS sends FROM customer""")
def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("c_mktsegment")
    action = rules.expected_action(F.when(kind == "BUILDING", "mature").otherwise("ok"), kind != "MACHINERY", F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")))
    channel = F.when(kind == "FURNITURE", "telegram").when(kind == "BUILDING", "sms").otherwise("web")
    return table(spark, sf_dir, "customer").select("c_custkey", action.alias("action"), rules.can_send(channel, False, "x").alias("sends"))
