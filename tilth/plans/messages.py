"""Text, JSON and streaming queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions import dates
from tilth.functions import text as T
from tilth.operators import merges
from tilth.sources.shared import table
from tilth.streaming import messages as S

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FOLD = "translate(lower(coalesce(text, '')), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy')"
_NORM = f"trim(regexp_replace(regexp_replace(replace({_FOLD}, '', ''), '[^a-z0-9.,:/%-]+', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {_NORM} AS norm, len(regexp_extract_all({_NORM}, '([a-z0-9]+)', 1)) AS n_words FROM conversations")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.normalize(F.col("text")).alias("norm"), F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query(r"SELECT doc_id, len(x) AS n_numbers, round(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE))), 4) AS total FROM (SELECT doc_id, regexp_extract_all(text, '([0-9]+(?:\.[0-9]+)?)', 1) AS x FROM documents) WHERE len(x) > 0")
def text_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.col("text")).alias("x")).where(F.size("x") > 0)
    return rows.select("doc_id", F.size("x").cast("long").alias("n_numbers"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(r"SELECT conv_id, turn, CAST(CASE WHEN n = 0 THEN 0 WHEN basic THEN CASE WHEN n <= 160 THEN 1 ELSE ceil(n / 153) END ELSE CASE WHEN n <= 70 THEN 1 ELSE ceil(n / 67) END END AS INTEGER) AS segments FROM (SELECT conv_id, turn, length(text) AS n, NOT regexp_matches(text, '[^\x0A\x0D\x20-\x5A\x61-\x7A£¥èéùìòÇØøÅåΔ_ΦΓΛΩΠΨΣΘΞÆæßÉ¤¡ÄÖÑÜ§¿äöñüà]') AS basic FROM conversations)")
def sms_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sms_segments(F.col("text")).alias("segments"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || ':' || json_extract_string(props, '$.k') AS key FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("key"))


@query(r"""SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) AS number, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int").alias("number"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).cast("long").alias("links"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, event_type AS kind, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) - 1 AS voided FROM events GROUP BY 1, 2, 3")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))
    return rows.agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"), (F.count("*") - 1).alias("voided"))


#: Messages made of the numbers of an event, in the forms that farmers write.
_SMS = "CASE event_id % 8 WHEN 0 THEN 'I irrigated ' || k || ' inches yesterday' WHEN 1 THEN k || ' of 80 plants' WHEN 2 THEN 'about ' || k || ' %' WHEN 3 THEN 'Si, ' || k || ' acres' WHEN 4 THEN 'rained ' || k || ' in, ' || (k % 20 + 1) || ' days ago' WHEN 5 THEN 'No' WHEN 6 THEN (k % 9 + 1)::VARCHAR WHEN 7 THEN 'water 26.' || (k + 100) || ', -98.' || (k + 200) END"


def _sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    s = k.cast("string")
    m = F.col("event_id") % 8
    text = (
        F.when(m == 0, F.concat(F.lit("I irrigated "), s, F.lit(" inches yesterday")))
        .when(m == 1, F.concat(s, F.lit(" of 80 plants")))
        .when(m == 2, F.concat(F.lit("about "), s, F.lit(" %")))
        .when(m == 3, F.concat(F.lit("Si, "), s, F.lit(" acres")))
        .when(m == 4, F.concat(F.lit("rained "), s, F.lit(" in, "), (k % 20 + 1).cast("string"), F.lit(" days ago")))
        .when(m == 5, F.lit("No"))
        .when(m == 6, (k % 9 + 1).cast("string"))
        .otherwise(F.concat(F.lit("water 26."), (k + 100).cast("string"), F.lit(", -98."), (k + 200).cast("string")))
    )
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("today"), text.alias("text"))


_E = f"m AS (SELECT event_id, today, k, text FROM (SELECT event_id, CAST(ts AS DATE) AS today, k, {_SMS} AS text FROM (SELECT event_id, ts, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)))"


@query(f"""WITH {_E} SELECT event_id, CASE event_id % 8 WHEN 0 THEN k::DOUBLE WHEN 4 THEN k::DOUBLE END AS inches, CASE event_id % 8 WHEN 1 THEN CASE WHEN k <= 80 THEN round(100.0 * k / 80, 6) END WHEN 2 THEN CASE WHEN k <= 100 THEN k::DOUBLE END END AS share,
 CASE event_id % 8 WHEN 3 THEN TRUE WHEN 5 THEN FALSE END AS yes, CASE event_id % 8 WHEN 6 THEN k % 9 + 1 END AS choice, CASE event_id % 8 WHEN 0 THEN today - 1 WHEN 4 THEN today - (k % 20 + 1) END AS day,
 CASE event_id % 8 WHEN 7 THEN CAST('26.' || (k + 100) AS DOUBLE) END AS lat FROM m""")
def message_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    said, t = F.col("text"), F.col("t")
    lat, _ = T.coordinates(said)
    rows = _sms(spark, sf_dir).withColumn("t", T.normalize(said)).withColumn("read", dates.tokens(t))  # once for all readers
    return rows.select(
        "event_id", T.water_inches(t, F.lit(40.0)).alias("inches"), F.round(T.share_found(t), 6).alias("share"), T.yes_no(said, t).alias("yes"),
        T.menu_choice(said, 9).alias("choice"), T.relative_date(F.col("read"), F.col("today")).alias("day"), lat.alias("lat"),
    )


@query(f"WITH {_E} SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'irrigated' WHEN event_id % 8 = 4 THEN 'rain' WHEN event_id % 8 = 7 THEN 'status' END AS command FROM m")
def message_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = {"irrigated": ("irrigated", "watered", "regue"), "rain": ("rained", "rain", "llovio"), "status": ("water", "agua", "status")}
    return _sms(spark, sf_dir).select("event_id", T.first_phrase(F.col("text"), table_).alias("command"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '+1956' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') WHEN c_custkey % 3 = 1 THEN '+52868' || lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0') END AS phone FROM customer")
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.lpad((F.col("c_custkey") % 10_000_000).cast("string"), 7, "0")
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("(956) "), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("+52 868-"), k)).otherwise(F.lit("12-34"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.phone(raw).alias("phone"))


@query("""SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.2f', l_quantity / 4), '\\.?0+$', '') AS inches, CASE WHEN n >= 1e9 THEN printf('%.1f GB', n / 1e9) WHEN n >= 1e6 THEN printf('%d MB', CAST(round(n / 1e6) AS BIGINT)) ELSE printf('%d KB', greatest(CAST(round(n / 1e3) AS BIGINT), 1)) END AS size FROM (SELECT *, l_extendedprice * 7919 AS n FROM lineitem)""")
def wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.plain_decimal(F.col("l_quantity") / 4).alias("inches"), T.byte_size(F.col("l_extendedprice") * 7919).alias("size"))


@query("SELECT event_id, event_type, value FROM events")
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each message twice in the stream, once in the result."""
    schema = table(spark, sf_dir, "events").schema
    events = S.stream_table(spark, sf_dir, "events", schema).select("event_id", "ts", "event_type", "value", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return S.run_available(S.once(events, "event_id", "ts", "40 days")).select("event_id", "event_type", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    counts = S.tumbling(S.stream_table(spark, sf_dir, "events", schema), "ts", ["event_type"], "1 hour")
    return S.run_complete(counts).withColumn("total", F.round("total", 4))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS seq, 'idle' AS state, CAST(0 AS BIGINT) AS confirmed, CAST(0 AS BIGINT) AS voided FROM events
 UNION ALL SELECT f.user_id, o.seq, CASE WHEN kind = 'signup' OR (state = 'confirm' AND kind IN ('purchase', 'error')) OR (state = 'idle' AND kind NOT IN ('view', 'click')) THEN 'idle' ELSE 'confirm' END,
  confirmed + CASE WHEN state = 'confirm' AND kind = 'purchase' THEN 1 ELSE 0 END, voided + CASE WHEN state = 'idle' AND kind = 'error' AND confirmed > voided THEN 1 ELSE 0 END
 FROM f JOIN o ON o.user_id = f.user_id AND o.seq = f.seq + 1)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversation state of each user after all its messages."""
    schema = table(spark, sf_dir, "events").schema
    states = S.run_available(S.conversations(S.stream_table(spark, sf_dir, "events", schema)))
    return merges.latest(states, ["user_id"], ["seq"])


@query("""SELECT event_id, hour(l) < 8 OR hour(l) >= 20 AS wait, timezone('UTC', timezone('America/Chicago', CASE WHEN hour(l) >= 20 THEN date_trunc('day', l) + INTERVAL 32 HOUR WHEN hour(l) < 8 THEN date_trunc('day', l) + INTERVAL 8 HOUR ELSE l END)) AS due FROM (SELECT event_id, timezone('America/Chicago', timezone('UTC', ts)) AS l FROM events)""")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    wait, due = S.quiet_hours(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", wait.alias("wait"), due.alias("due"))


#: Short answers by the event's number: (text, stop, start, help, greeting, yes, name).
_SHORT = (
    ("¡CANCELAR!", True, False, False, False, None, "¡CANCELAR!"), ("Darme de baja.", True, False, False, False, None, "Darme de baja"), ("no, cancelar", False, False, False, False, False, "no, cancelar"),
    ("Sí", False, True, False, False, True, "Sí"), (" ? ", False, False, True, False, None, None), ("Ayúdame:", False, False, True, False, None, "Ayúdame:"),
    ("Buenas tardes", False, False, False, True, None, "Buenas tardes"), ("Me llamo  El Norte", False, False, False, False, None, "El Norte"), ("that's right", False, False, False, False, True, "that's right"),
    ("It's called 40-B", False, False, False, False, None, "40-B"), ("I don't know", False, False, False, False, None, "I don't know"),
)


def _shorts(i: int) -> str:
    told = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
    return "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN {told(row[i])}" for k, row in enumerate(_SHORT)) + " END"


@query(f"SELECT event_id, {_shorts(1)} AS stop, {_shorts(2)} AS start, {_shorts(3)} AS help, {_shorts(4)} AS greeting, {_shorts(5)} AS yes, {_shorts(6)} AS name FROM events")
def message_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to leave, to come back and for help, greetings, answers and names in short messages."""
    said, t = F.col("text"), F.col("t")
    texts = F.array(*(F.lit(row[0]) for row in _SHORT))
    rows = table(spark, sf_dir, "events").select("event_id", F.get(texts, (F.col("event_id") % 11).cast("int")).alias("text")).withColumn("t", T.normalize(said))
    return rows.select("event_id", *(T.signal(said, t, kind).alias(kind) for kind in T.SIGNALS), T.yes_no(said, t).alias("yes"), T.tidy_name(said).alias("name"))
