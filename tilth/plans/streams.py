"""Streams with state and side effects over the events: conversations with time-outs, and an outbox."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators import merges
from tilth.sources.shared import shared_dir, table
from tilth.streaming import messages as S
from tilth.streaming.outbox import STOPPED, Outbox
from tilth.streaming.timed import timed_conversations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Silence after which a question is dropped, and what the watermark leaves open.
SILENCE_MS, LATE_MS = 12 * 3_600_000, 86_400_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream in which each comes twice."""
    events = S.stream_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)
    return events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")


@query(f"""WITH RECURSIVE h AS (SELECT epoch_ms(max(ts)) - {LATE_MS} AS until FROM events),
o AS (SELECT user_id, event_type AS kind, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS seq FROM events, h WHERE epoch_ms(ts) <= until),
f AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS seq, 'idle' AS state, CAST(0 AS BIGINT) AS confirmed, CAST(0 AS BIGINT) AS voided, CAST(0 AS BIGINT) AS timed_out, CAST(-1 AS BIGINT) AS last_ms FROM o
 UNION ALL SELECT user_id, seq, CASE WHEN kind = 'signup' OR (was = 'confirm' AND kind IN ('purchase', 'error')) OR (was = 'idle' AND kind NOT IN ('view', 'click')) THEN 'idle' ELSE 'confirm' END,
  confirmed + CASE WHEN was = 'confirm' AND kind = 'purchase' THEN 1 ELSE 0 END, voided + CASE WHEN was = 'idle' AND kind = 'error' AND confirmed > voided THEN 1 ELSE 0 END,
  timed_out + CASE WHEN was <> state THEN 1 ELSE 0 END, ms
 FROM (SELECT f.* EXCLUDE (seq, last_ms), o.seq, o.kind, o.ms, CASE WHEN state = 'confirm' AND o.ms - last_ms > {SILENCE_MS} THEN 'idle' ELSE state END AS was FROM f JOIN o ON o.user_id = f.user_id AND o.seq = f.seq + 1)),
l AS (SELECT f.*, state = 'confirm' AND until - last_ms > {SILENCE_MS} AS silent FROM f, h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
SELECT user_id, seq, CASE WHEN silent THEN 'idle' ELSE state END AS state, confirmed, voided, timed_out + silent::BIGINT AS timed_out FROM l""")
def stream_timed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's conversation as the watermark leaves it, folded in order of event time."""
    states = S.run_available(timed_conversations(_twice(spark, sf_dir), "1 day", SILENCE_MS))
    return merges.latest(states, ["user_id"], ["seq", "timed_out"])


#: A provider that has numbers which opted out, and is out of order for a quarter of the attempts.
_CODE = f"CASE WHEN event_id % 50 = 7 THEN {STOPPED} WHEN (event_id + attempts + 1) % 4 = 0 THEN 500 END"


def _round(i: int, hours: int) -> str:
    """One flush, hours after noon of the second day, in SQL."""
    return f"""d{i} AS (SELECT r.*, (status = 'queued' AND send_after <= moment) OR (status = 'failed' AND retry_at <= moment) AS due, moment, user_id IN (SELECT user_id FROM r{i - 1} WHERE code = {STOPPED}) AS stop
 FROM r{i - 1} r, (SELECT date_trunc('day', max(ts)) + INTERVAL {66 + hours} HOUR AS moment FROM events)),
c{i} AS (SELECT *, CASE WHEN stop THEN {STOPPED} ELSE {_CODE} END AS got FROM d{i} WHERE due),
r{i} AS (SELECT event_id, user_id, status, send_after, attempts, code, retry_at FROM d{i} WHERE due IS NOT TRUE
 UNION ALL SELECT event_id, user_id, CASE WHEN got IS NULL THEN 'sent' ELSE 'failed' END, send_after, attempts + 1, got, CASE WHEN got = 500 AND attempts < 2 THEN moment + INTERVAL 15 MINUTE * (1 << attempts) END FROM c{i})"""


@query(f"""WITH m AS (SELECT *, timezone('America/Chicago', timezone('UTC', ts)) AS l FROM events),
w AS (SELECT *, CASE WHEN hour(l) >= 20 THEN date_trunc('day', l) + INTERVAL 32 HOUR WHEN hour(l) < 8 THEN date_trunc('day', l) + INTERVAL 8 HOUR END AS morning FROM m),
i AS (SELECT event_id, user_id, ts, 0 AS attempts, CASE WHEN user_id % 17 = 0 THEN 'opted out' WHEN event_type = 'signup' THEN 'kept' WHEN event_type <> 'purchase' AND morning IS NOT NULL THEN 'queued' ELSE 'sending' END AS status,
 timezone('UTC', timezone('America/Chicago', morning)) AS morning FROM w),
r0 AS (SELECT event_id, user_id, CASE WHEN status <> 'sending' THEN status WHEN got IS NULL THEN 'sent' ELSE 'failed' END AS status, CASE WHEN status = 'queued' THEN morning END AS send_after,
 CASE WHEN status = 'sending' THEN 1 ELSE 0 END AS attempts, CASE WHEN status = 'sending' THEN got END AS code, CASE WHEN status = 'sending' AND got = 500 THEN ts + INTERVAL 15 MINUTE END AS retry_at
 FROM (SELECT *, {_CODE} AS got FROM i)),
{_round(1, 0)}, {_round(2, 1)}, {_round(3, 4)}
SELECT event_id, user_id, status, send_after, attempts, CASE WHEN status = 'sent' THEN 'sm-' || event_id END AS provider_id, code FROM r3""")
def outbox_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of a text for each event, of which each comes twice, after three flushes; tried three times at most."""

    def send(due: DataFrame) -> DataFrame:
        key = F.col("message_id")
        code = F.when(key % 50 == 7, STOPPED).when((key + F.col("attempt")) % 4 == 0, 500)
        return due.withColumns({"code": code, "provider_id": F.when(code.isNull(), F.concat(F.lit("sm-"), key.cast("string")))})

    box = Outbox(spark, shared_dir(spark), send, most=3)
    kind = F.col("event_type")
    texts = _twice(spark, sf_dir).select(
        F.col("event_id").alias("message_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), kind.alias("body"),
        (F.col("user_id") % 17 == 0).alias("opted_out"), (kind != "signup").alias("can_send"), (kind == "purchase").alias("urgent"),
    )
    texts.writeStream.foreachBatch(box.take).option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).start().awaitTermination()
    end = table(spark, sf_dir, "events").agg(F.unix_seconds(F.max(F.col("ts").cast("timestamp")))).first()[0] or 0
    for hours in (66, 67, 70):
        box.flush(datetime.fromtimestamp(end - end % 86_400 + hours * 3600, UTC))
    return box.texts().select(F.col("message_id").alias("event_id"), "user_id", "status", "send_after", "attempts", "provider_id", "code")
