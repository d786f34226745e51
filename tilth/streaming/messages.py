"""Streams of events and messages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tilth.sources.shared import shared_dir


def stream_table(spark: SparkSession, sf_dir: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet table as a stream of its files."""
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]*")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and give what it wrote (append mode) to the shared folder."""
    spark = stream.sparkSession
    out = shared_dir(spark)
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame) -> DataFrame:
    """Run an aggregating stream over all that is there; each micro-batch replaces the whole result."""
    spark = stream.sparkSession
    out = shared_dir(spark)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", shared_dir(spark)).trigger(availableNow=True).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def once(messages: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """At most one message for each provider key within the watermark."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, ts: str, keys: list[str], width: str, late: str = "1 day") -> DataFrame:
    """Counts and sums in tumbling windows."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


CONVERSATION = "user_id long, seq long, state string, confirmed long, voided long"
_STATE = "state string, confirmed long, voided long, seq long"


def step(state: str, kind: str) -> tuple[str, int, int]:
    """Next state of a conversation, events confirmed and events taken back by one message.

    A report ('view', 'click') asks to confirm; 'purchase' confirms, 'error' says no; 'signup' starts anew.
    """
    if kind == "signup":
        return "idle", 0, 0
    if state == "confirm":
        return ("idle", 1, 0) if kind == "purchase" else ("idle", 0, 0) if kind == "error" else ("confirm", 0, 0)
    if kind == "error":
        return "idle", 0, 1
    return ("confirm", 0, 0) if kind in ("view", "click") else ("idle", 0, 0)


def converse(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold a user's messages, in order of their ids, into the conversation state."""
    now, confirmed, voided, seq = state.get if state.exists else ("idle", 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values("event_id")
    for kind in rows["event_type"]:
        now, yes, undo = step(now, kind)
        confirmed, voided, seq = confirmed + yes, voided + min(undo, confirmed - voided), seq + 1
    state.update((now, confirmed, voided, seq))
    yield pd.DataFrame({"user_id": [key[0]], "seq": [seq], "state": [now], "confirmed": [confirmed], "voided": [voided]})


def conversations(events: DataFrame) -> DataFrame:
    """State of every conversation after each micro-batch that touched it."""
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(converse, CONVERSATION, _STATE, "append", GroupStateTimeout.NoTimeout)


def quiet_hours(ts, zone: str = "America/Chicago"):
    """Whether messages must wait, and when they may go: 8 to 20 local time."""
    local = F.from_utc_timestamp(ts, zone)
    wait = (F.hour(local) < 8) | (F.hour(local) >= 20)
    morning = F.date_trunc("day", local) + F.expr("interval 8 hours")
    due = F.when(F.hour(local) >= 20, morning + F.expr("interval 1 day")).when(F.hour(local) < 8, morning).otherwise(local)
    return wait, F.to_utc_timestamp(due, zone)
