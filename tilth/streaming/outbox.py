"""An outbox: each text is decided once and sent once, tried again after growing waits, and held overnight.

A ledger in the shared folder has a part for each micro-batch and each flush: what was decided (intents) and what came
of it (results). A part is written whole or not at all, so a micro-batch that is played again finds its own decisions
and results and does nothing twice; one that broke between the two sends what has no result, under the same key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.streaming.messages import quiet_hours

#: The provider's code for a number that has opted out (fixed value).
STOPPED = 21610
INTENT = "message_id long, user_id long, ts timestamp, body string, status string, send_after timestamp"
RESULT = "message_id long, user_id long, attempt int, at timestamp, status string, provider_id string, code int, retry_at timestamp"
SENT = "message_id long, user_id long, attempt int, at timestamp, provider_id string, code int"


def fate(opted_out: Column, can_send: Column, urgent: Column, ts: Column) -> Column:
    """What becomes of a text: 'opted out', 'kept' (no channel), 'queued' (quiet hours, not urgent) or 'sending'; NULLs count as false."""
    wait, _ = quiet_hours(ts)
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return F.when(is_(opted_out), "opted out").when(~is_(can_send), "kept").when(~is_(urgent) & is_(wait), "queued").otherwise("sending")


def by_partition(post: Callable[[str, int, str], tuple[str | None, int | None]]) -> Callable[[DataFrame], DataFrame]:
    """A way to send: post(key, user, body) gives a provider's id, or an error code, for one text.

    The key is the text's own, the same in every attempt that a lost executor repeats, so that a provider can tell repeats.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [post(f"{m}-{a}", u, b) for m, a, u, b in zip(frame["message_id"], frame["attempt"], frame["user_id"], frame["body"], strict=True)]
            out = frame[["message_id", "user_id", "attempt", "at"]].copy()
            out["provider_id"] = pd.Series([a[0] for a in answers], index=out.index, dtype=object)
            out["code"] = pd.Series([a[1] for a in answers], index=out.index, dtype="Int32")
            yield out

    return lambda due: due.mapInPandas(run, SENT)


class Outbox:
    """A ledger of texts in a shared folder, and `send`: due texts (message_id, user_id, body, attempt, at) to provider_id and code (NULL: sent)."""

    def __init__(self, spark: SparkSession, folder: str, send: Callable[[DataFrame], DataFrame], first_wait_s: int = 900, most: int = 4) -> None:
        self.spark, self.folder, self.send, self.first_wait_s, self.most = spark, folder, send, first_wait_s, most

    def take(self, batch: DataFrame, number: int) -> None:
        """Decide on a micro-batch (message_id, user_id, ts, body, opted_out, can_send, urgent) and send what may go; for foreachBatch.

        A repeated message_id counts once, by its earliest row (then the least in its other columns). Senders whom the
        provider has reported as opted out in an earlier part get nothing more.
        """
        part = f"batch-{number}"
        if not self._written("intents", part):
            rest = ["user_id", "body", "opted_out", "can_send", "urgent"]
            one = batch.groupBy("message_id").agg(F.min(F.struct("ts", *rest)).alias("m")).select("message_id", "m.*")
            fresh = one.join(self._read("intents").select("message_id"), "message_id", "left_anti").join(self._stopped(), "user_id", "left")
            status = fate(F.col("opted_out") | F.coalesce("stopped", F.lit(False)), F.col("can_send"), F.col("urgent"), F.col("ts"))
            after = F.when(F.col("status") == "queued", quiet_hours(F.col("ts"))[1])
            self._write(fresh.withColumn("status", status).select("message_id", "user_id", "ts", "body", "status", after.alias("send_after")), "intents", part)
        if not self._written("results", part):
            due = self._read("intents").where((F.col("part") == part) & (F.col("status") == "sending"))
            self._try(due.select("message_id", "user_id", "body", F.lit(1).alias("attempt"), F.col("ts").alias("at")), part)

    def flush(self, now: datetime) -> None:
        """Send what was held or failed and is due by now (with a time zone); nothing in quiet hours, nor twice for the same moment.

        Texts to senders who have opted out meanwhile fail for good and are not sent.
        """
        part, at = f"flush-{int(now.timestamp())}", F.lit(now)
        if self._written("results", part) or self.spark.range(1).select(quiet_hours(at)[0]).first()[0]:
            return
        held = (F.col("status") == "queued") & (F.col("send_after") <= at)
        again = (F.col("status") == "failed") & (F.col("retry_at") <= at)
        due = self.texts().where(held | again).select("message_id", "user_id", "body", (F.col("attempts") + 1).cast("int").alias("attempt"), at.alias("at"))
        self._try(due, part)

    def texts(self) -> DataFrame:
        """Every text with its latest status, attempts, the provider's id or code, and when it is tried next."""
        seen = F.max_by(F.struct("status", "provider_id", "code", "retry_at"), "attempt")
        last = self._read("results").groupBy("message_id").agg(seen.alias("r"), F.max("attempt").alias("attempts"))
        both = self._read("intents").withColumnRenamed("status", "decided").join(last, "message_id", "left")
        return both.select(
            "message_id", "user_id", "ts", "body", F.coalesce("r.status", "decided").alias("status"), "send_after",
            F.coalesce("attempts", F.lit(0)).alias("attempts"), "r.provider_id", "r.code", "r.retry_at",
        )

    def _try(self, due: DataFrame, part: str) -> None:
        """Send and write the results of one part; failed texts wait twice as long after each attempt."""
        marked = due.join(self._stopped(), "user_id", "left")
        out = self.send(marked.where("stopped is null").drop("stopped")).select("message_id", "user_id", "attempt", "at", "provider_id", "code")
        never = marked.where("stopped").select("message_id", "user_id", "attempt", "at", F.lit(None).cast("string").alias("provider_id"), F.lit(STOPPED).alias("code"))
        failed = F.col("code").isNotNull()
        wait = F.make_dt_interval(secs=(F.lit(self.first_wait_s) * F.pow(F.lit(2), F.col("attempt") - 1)).cast("decimal(18,6)"))
        retry = F.when(failed & (F.col("code") != STOPPED) & (F.col("attempt") < self.most), F.col("at") + wait)
        rows = out.unionByName(never).withColumns({"status": F.when(failed, "failed").otherwise("sent"), "retry_at": retry})
        self._write(rows.select("message_id", "user_id", "attempt", "at", "status", "provider_id", "code", "retry_at"), "results", part)

    def _stopped(self) -> DataFrame:
        return self._read("results").where(F.col("code") == STOPPED).select("user_id", F.lit(True).alias("stopped")).distinct()

    def _path(self, kind: str, part: str | None = None):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}" + (f"/part={part}" if part else ""))

    def _written(self, kind: str, part: str | None = None) -> bool:
        path = self._path(kind, part)
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS") if part else path
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def _write(self, rows: DataFrame, kind: str, part: str) -> None:
        rows.write.mode("overwrite").parquet(self._path(kind, part).toString())

    def _read(self, kind: str) -> DataFrame:
        """All parts that are whole; a part that is being written has no files yet."""
        schema = f"{INTENT if kind == 'intents' else RESULT}, part string"
        if not self._written(kind):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(kind).toString())
