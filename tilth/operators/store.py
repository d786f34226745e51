"""Views of an append-only store of fields, events, messages, links and alerts.

Nothing is updated in place: a later row voids or completes an earlier one, and these functions give
the state that follows. Each is an aggregate or an equi-join, so a busy key combines before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilth.sources.shared import materialize

#: Kinds of events of which several can stand on one day (fixed values).
KEPT_TOGETHER = ("photo", "note")
#: Reminders, the most pressing first (fixed values), and days between two of a kind.
REMINDERS = ("water_now", "water_soon", "checkin", "scout", "missing")
CHECKIN_AFTER, REMIND_EVERY = 3, 7


def standing_events(events: DataFrame, voids: DataFrame) -> DataFrame:
    """Events (id, field, day, kind) that stand: the last of its field, day and kind, but for those KEPT_TOGETHER, without those voided by id."""
    together = F.col("kind").isin(*KEPT_TOGETHER)
    last = events.where(~together).groupBy("field", "day", "kind").agg(F.max("id").alias("id")).select("id")
    stand = last.union(events.where(together).select("id")).join(voids.select("id"), "id", "left_anti")
    return events.join(stand, "id", "left_semi")


def last_event_of(standing: DataFrame, fields: DataFrame) -> DataFrame:
    """The latest standing event of each phone, over all its fields (field, phone)."""
    return standing.join(fields.select("field", "phone"), "field").groupBy("phone").agg(F.max_by(F.struct("id", "field", "kind"), "id").alias("e")).select("phone", "e.*")


def message_states(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages (id, status, sent_at) after all marks (id, seq, status, provider_id, error, at): the last status and error, the last provider id given, and when it last was sent or kept."""
    done = F.col("status").isin("sent", "kept")
    last = marks.groupBy("id").agg(
        F.max_by("status", "seq").alias("new_status"), F.max_by("error", "seq").alias("error"), F.max_by("provider_id", F.when(F.col("provider_id").isNotNull(), F.col("seq"))).alias("provider_id"), F.max_by("at", F.when(done, F.col("seq"))).alias("at")
    )
    return messages.join(last, "id", "left").withColumns({"status": F.coalesce("new_status", "status"), "sent_at": F.coalesce("at", "sent_at")}).drop("new_status", "at")


def due(messages: DataFrame, now: Column) -> DataFrame:
    """Outgoing messages held back until now."""
    return messages.where((F.col("direction") == "out") & (F.col("status") == "queued") & (F.col("send_after").isNull() | (F.col("send_after") <= now)))


def open_links(links: DataFrame, now: Column) -> DataFrame:
    """The newest link of each field and kind that has not run out."""
    return links.where(F.col("expires_at") >= now).groupBy("field", "kind").agg(F.max_by("token", F.struct("created_at", "token")).alias("token"), F.max("created_at").alias("created_at"))


def links_to_make(wanted: DataFrame, links: DataFrame, now: Column, days: int) -> DataFrame:
    """Links for wanted (field, kind): the open one, or a new one with its expiry and no token yet."""
    have = open_links(links, now)
    fresh = F.when(F.col("token").isNull(), now + F.make_dt_interval(days=F.lit(days)))
    return wanted.join(have, ["field", "kind"], "left").select("field", "kind", "token", fresh.alias("expires_at"))


def upload_counts(uploads: DataFrame, files: DataFrame, links: DataFrame) -> DataFrame:
    """Uploads (token) with their field and the number and bytes of their files (token, bytes)."""
    counts = files.groupBy("token").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    rows = uploads.join(links.select("token", "field"), "token").join(counts, "token", "left")
    return rows.withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0))})


def sent_alerts(alerts: DataFrame) -> DataFrame:
    """The last time each field was sent each kind and key."""
    return alerts.groupBy("field", "kind", "key").agg(F.max("sent_at").alias("sent_at"))


def last_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("field", "kind").agg(F.max("sent_at").alias("last"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `number` from 1 in the order of some columns (equal rows in any order).

    Numbers are dealt by task: a count of each, then a running total over the counts, so no task sees all rows. The
    sorted rows are written once, so that counts and numbers are of the same tasks.
    """
    dealt = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    task = F.shiftright("_row", 33)
    sizes = dealt.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    before = sizes.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))  # one row a task
    number = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1) + 1
    return dealt.withColumn("_task", task).join(F.broadcast(before), "_task").select(*rows.columns, number.alias("number"))


def numbered_fields(new: DataFrame, fields: DataFrame, last_used: Column, order: list[str]) -> DataFrame:
    """New fields with ids after the highest ever used, F001 onwards."""
    top = fields.agg(F.max(F.regexp_extract("id", r"^F([0-9]+)$", 1).try_cast("long")).alias("top"))
    rows = numbered(new, order).crossJoin(F.broadcast(top))
    text = (F.greatest(F.coalesce("top", F.lit(0)), F.coalesce(last_used, F.lit(0))) + F.col("number")).cast("string")
    return rows.select(F.concat(F.lit("F"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text)).alias("id"), *new.columns)


def without_person(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A table without the rows of persons, fields or links that are to be forgotten."""
    return table.join(gone.select(key).distinct(), key, "left_anti")


def water_put_on(standing: DataFrame, starts: DataFrame) -> DataFrame:
    """Inches irrigated and rained since each field's start (field, start), from standing events (field, day, kind, inches)."""
    rows = standing.where(F.col("kind").isin("irrigated", "rain")).join(starts, "field").where("day >= start")
    sums = rows.groupBy("field").agg(*(F.sum(F.when(F.col("kind") == k, F.coalesce("inches", F.lit(0.0))).otherwise(0.0)).alias(k) for k in ("irrigated", "rain")))
    return starts.select("field").join(sums, "field", "left").na.fill(0.0, ["irrigated", "rain"])


def plan_reminders(fields: DataFrame, alerts: DataFrame, today: Column) -> DataFrame:
    """At most one reminder for each phone: phone, field, kind and key.

    fields: phone, field, alerts_on, idle, no_water, irrigated, waits, days_left, cycle, crop, watch (array),
    has_place and missing (array of facts). A reminder is not sent again under its key: the irrigation
    cycle for water, the ISO week for scouting, the day for missing facts, which wait REMIND_EVERY days.
    """
    sent, last = sent_alerts(alerts), last_alerts(alerts)
    since = lambda kind: last.where(F.col("kind") == kind).select("field", F.to_date("last").alias(f"last_{kind}"))
    rows = fields.where("alerts_on").join(since("water_now"), "field", "left").join(since("missing"), "field", "left")
    wet = ~F.col("waits") & ~F.col("no_water") & F.col("irrigated")
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), today), F.weekofyear(today))
    ask = F.get(F.filter(F.array(*map(F.lit, ("map", "crop", "planted", "method", "last_irrigation", "side"))), lambda q: F.array_contains("missing", q)), F.lit(0))
    asks = F.col("idle") & F.coalesce(F.datediff(today, "last_missing") >= REMIND_EVERY, F.lit(True)) & ((ask != "map") | F.col("has_place"))
    options = {
        "water_now": (wet & (F.col("days_left") == 0), F.col("cycle")),
        "water_soon": (wet & F.col("days_left").between(1, 3), F.col("cycle")),
        "checkin": (wet & (F.col("days_left") == 0) & F.col("idle") & (F.datediff(today, "last_water_now") >= CHECKIN_AFTER), F.col("cycle")),
        "scout": (~F.col("waits") & (F.col("crop") == "sorghum") & F.array_contains("watch", "sugarcane_aphid"), week),
        "missing": (asks, F.concat(ask, F.lit(":"), today.cast("string"))),
    }
    choice = F.array_compact(F.array(*(F.when(when, F.struct(F.lit(i).alias("order"), F.lit(kind).alias("kind"), key.alias("key"))) for i, (kind, (when, key)) in enumerate(options.items()))))
    open_ = rows.select("phone", "field", F.explode(choice).alias("o")).select("phone", "field", "o.*").where("key is not null").join(sent, ["field", "kind", "key"], "left_anti")
    return open_.groupBy("phone").agg(F.min_by(F.struct("field", "kind", "key"), F.struct("order", "field")).alias("r")).select("phone", "r.*")


def by_urgency(status: DataFrame) -> DataFrame:
    """Fields (field, days_left, no_water, sensitive) in order of who needs water first, numbered from 1.

    Dated needs come first, then those beyond the projection, then those without need; a sensitive crop
    breaks ties, then the field.
    """
    group = F.when(F.col("no_water"), 2).when(F.col("days_left").isNotNull(), 0).otherwise(1)
    need = {"_group": group, "_days": F.when(group == 0, F.col("days_left")).otherwise(0), "_calm": F.when(group == 2, 0).when(F.col("sensitive"), 0).otherwise(1)}
    return numbered(status.select("field", "days_left", *(c.alias(k) for k, c in need.items())), [*need, "field"]).select("field", "days_left", F.col("number").alias("rank"))


def named_fields(messages: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields (phone, field, words) that a message (id, phone, words) names by most of its distinctive words."""
    said = messages.select("id", "phone", F.explode(F.array_distinct("words")).alias("word"))
    called = fields.select("phone", "field", F.explode(F.array_distinct("words")).alias("word"))
    scores = said.join(called, ["phone", "word"]).groupBy("id", "field").agg(F.count("*").alias("score"))
    best = scores.groupBy("id").agg(F.max("score").alias("best"))
    return scores.join(best, "id").where("score = best").select("id", "field", "score")
