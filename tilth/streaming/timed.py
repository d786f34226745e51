"""Conversations in order of event time, with a time-out: messages wait in state until the watermark has passed them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tilth.streaming.messages import step

#: An open question is dropped after so much silence.
SILENCE_MS = 30 * 60 * 1000
TIMED = "user_id long, seq long, state string, confirmed long, voided long, timed_out long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(talk: tuple, messages: list[tuple[int, int, str]], until_ms: int, silence_ms: int = SILENCE_MS) -> tuple:
    """talk (state, confirmed, voided, timed_out, seq, last_ms, last_id) after messages (ms, id, kind) in order, as it stands at until_ms.

    A question that is open for longer than silence_ms is dropped. Messages that are not after the last one are repeats
    or too late, and change nothing.
    """
    state, confirmed, voided, timed_out, seq, last_ms, last_id = talk
    for ms, key, kind in sorted(messages):
        if (ms, key) <= (last_ms, last_id):
            continue
        if state == "confirm" and ms - last_ms > silence_ms:
            state, timed_out = "idle", timed_out + 1
        state, yes, undo = step(state, kind)
        confirmed, voided = confirmed + yes, voided + min(undo, confirmed + yes - voided)
        seq, last_ms, last_id = seq + 1, ms, key
    if state == "confirm" and until_ms - last_ms > silence_ms:
        state, timed_out = "idle", timed_out + 1
    return state, confirmed, voided, timed_out, seq, last_ms, last_id


class Conversation(StatefulProcessor):
    """Keeps a user's messages until the watermark passes them, then folds them in order; one timer a user is set at a time.

    What a micro-batch brings for a user waits as one row of arrays, each message once: repeats change nothing.
    """

    def __init__(self, silence_ms: int) -> None:
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.talk = handle.getValueState("talk", "state string, confirmed long, voided long, timed_out long, seq long, last_ms long, last_id long")
        self.waiting = handle.getListState("waiting", "ms array<long>, event_id array<long>, event_type array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = {m for frame in rows for m in zip(*(frame[c].tolist() for c in ("ms", "event_id", "event_type")), strict=True)}
        if new:
            self.waiting.appendValue(self._packed(new))
            self._wake(min(new)[0])
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        every = {m for kept in self.waiting.get() for m in zip(*(list(c) for c in kept), strict=True)}
        talk = tuple(self.talk.get() or ("idle", 0, 0, 0, 0, -1, -1))
        told = fold(talk, [m for m in every if m[0] <= now], now, self.silence_ms)
        later = [m for m in every if m[0] > now]
        if later:
            self.waiting.put([self._packed(later)])
        else:
            self.waiting.clear()
        self.talk.update(told)
        ahead = [m[0] for m in later] + ([told[5] + self.silence_ms + 1] if told[0] == "confirm" else [])
        if ahead:
            self.handle.registerTimer(min(ahead))
        if told != talk:
            state, confirmed, voided, timed_out, seq, _, _ = told
            yield pd.DataFrame({"user_id": [key[0]], "seq": [seq], "state": [state], "confirmed": [confirmed], "voided": [voided], "timed_out": [timed_out]})

    @staticmethod
    def _packed(messages: Iterable[tuple[int, int, str]]) -> tuple[list[int], list[int], list[str]]:
        ms, ids, kinds = zip(*messages, strict=True)
        return [int(m) for m in ms], [int(i) for i in ids], list(kinds)

    def _wake(self, ms: int) -> None:
        """The earliest timer stays; a later one is replaced."""
        timers = list(self.handle.listTimers())
        if not timers or ms < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)


def timed_conversations(events: DataFrame, late: str = "1 day", silence_ms: int = SILENCE_MS) -> DataFrame:
    """State of every conversation each time that the watermark passes messages or the end of a silence.

    events are (user_id, event_id, event_type, ts) in any order; repeats and messages later than `late` change nothing.
    Needs the RocksDB state store, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).where("user_id is not null and ts is not null")
    timed = timed.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return timed.groupBy("user_id").transformWithStateInPandas(Conversation(silence_ms), TIMED, "append", "EventTime")
