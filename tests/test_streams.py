"""Conversations in event time against a plain fold, and the outbox when micro-batches are played again or break."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tilth.operators import merges
from tilth.streaming import messages as S
from tilth.streaming.outbox import STOPPED, Outbox, by_partition
from tilth.streaming.timed import fold, timed_conversations

START = datetime(2024, 5, 1, 15, tzinfo=UTC)  # ten in the morning of the farm
TEXT = "message_id long, user_id long, ts timestamp, body string, opted_out boolean, can_send boolean, urgent boolean"


def text(key, user=1, after=timedelta(), opted_out=False, can_send=True, urgent=False):
    return key, user, START + after, f"text {key}", opted_out, can_send, urgent


def box_with(spark, tmp_path, answer=lambda key: None):
    """An outbox whose provider keeps one file a key, and appends to a log at each call."""
    sent = tmp_path / "sent"
    sent.mkdir()
    place = str(sent)

    def post(key, user, body):
        code = answer(key)
        with open(f"{place}/{key}", "a") as f:
            f.write("x")
        return (None, code) if code else (f"id-{key}", None)

    return Outbox(spark, f"file://{tmp_path}/ledger", by_partition(post)), sent


def calls(sent):
    return {p.name: p.read_text().count("x") for p in sent.iterdir()}


def status(box):
    return {r.message_id: r.status for r in box.texts().collect()}


def test_what_becomes_of_texts(spark, tmp_path):
    box, sent = box_with(spark, tmp_path)
    night = timedelta(hours=14)  # midnight of the farm
    rows = [text(1), text(2, opted_out=True), text(3, can_send=False), text(4, after=night), text(5, after=night, urgent=True), text(1, after=timedelta(minutes=1)), (6, 1, START, None, None, None, None)]
    box.take(spark.createDataFrame(rows, TEXT), 0)
    assert status(box) == {1: "sent", 2: "opted out", 3: "kept", 4: "queued", 5: "sent", 6: "kept"}
    box.flush(START + night)  # still night
    assert status(box)[4] == "queued" and calls(sent) == {"1-1": 1, "5-1": 1}
    box.flush(START + timedelta(days=1))
    box.flush(START + timedelta(days=1))
    assert status(box)[4] == "sent" and calls(sent) == {"1-1": 1, "5-1": 1, "4-1": 1}
    box.take(spark.createDataFrame([], TEXT), 1)
    assert len(status(box)) == 6


def test_a_batch_played_again_sends_nothing(spark, tmp_path):
    box, sent = box_with(spark, tmp_path)
    batch = spark.createDataFrame([text(k) for k in range(40)], TEXT)
    box.take(batch, 0)
    box.take(batch, 0)
    box.take(batch, 1)  # repeats in a later one
    assert calls(sent) == {f"{k}-1": 1 for k in range(40)} and set(status(box).values()) == {"sent"}


def test_a_batch_that_breaks_between_decision_and_result(spark, tmp_path):
    box, sent = box_with(spark, tmp_path)
    batch = spark.createDataFrame([text(k) for k in range(5)], TEXT)
    good, box.send = box.send, lambda due: due.select(F.raise_error(F.lit("line down")).alias("message_id"), "user_id", "attempt", "at", F.lit("").alias("provider_id"), F.lit(0).alias("code"))
    with pytest.raises(Exception, match="line down"):
        box.take(batch, 0)
    assert set(status(box).values()) == {"sending"} and calls(sent) == {}
    box.send = good
    box.take(spark.createDataFrame([text(k, opted_out=True) for k in range(5)], TEXT), 0)  # decided already
    assert set(status(box).values()) == {"sent"} and set(calls(sent).values()) == {1}


def test_waits_grow_and_end(spark, tmp_path):
    box, sent = box_with(spark, tmp_path, lambda key: 500)
    box.most = 3
    box.take(spark.createDataFrame([text(1)], TEXT), 0)
    waits, at = [], START
    for _ in range(2):
        due = box.texts().first().retry_at.astimezone(UTC)
        waits.append((due - at).total_seconds())
        box.flush(due - timedelta(seconds=1))  # too early
        box.flush(at := due)
    last = box.texts().first()
    assert waits == [900, 1800] and (last.attempts, last.status, last.retry_at) == (3, "failed", None)
    assert calls(sent) == {"1-1": 1, "1-2": 1, "1-3": 1}


def test_who_opted_out_at_the_provider_gets_no_more(spark, tmp_path):
    box, sent = box_with(spark, tmp_path, lambda key: STOPPED if key == "1-1" else None)
    night = timedelta(hours=14)
    box.take(spark.createDataFrame([text(1), text(2, after=night), text(3, user=2, after=night)], TEXT), 0)
    box.take(spark.createDataFrame([text(4)], TEXT), 1)
    box.flush(START + timedelta(days=1))
    assert status(box) == {1: "failed", 2: "failed", 3: "sent", 4: "opted out"} and set(calls(sent)) == {"1-1", "3-1"}


def test_conversations_in_event_time(spark, tmp_path):
    """Files bring messages out of order, twice and too late; the fold is that of the messages in order of time."""
    minute = 60_000
    base = int(START.timestamp() * 1000)
    kinds = ["view", "purchase", "click", "error", "error", "view", "signup", "click", "view", "purchase"]
    first = [(1, k, kinds[k], base + k * 7 * minute) for k in (3, 1, 0, 2, 4)] + [(2, 20, "click", base), (2, 20, "click", base)]
    second = [(1, k, kinds[k], base + k * 7 * minute) for k in (9, 6, 5, 8, 7, 4)] + [(3, 90, "view", base + 300 * minute)]
    third = [(3, 91, "purchase", base + 301 * minute)]
    fourth = [(1, 50, "error", base + minute), (3, 99, "view", base + 900 * minute)]  # 50 is too late
    columns = "user_id long, event_id long, event_type string, ms long"
    for i, part in enumerate((first, second, third, fourth)):
        frame = spark.createDataFrame(part, columns).coalesce(1).withColumn("ts", F.timestamp_millis("ms")).drop("ms")
        frame.write.parquet(f"file://{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("user_id long, event_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = S.run_available(timed_conversations(stream, "60 minutes", 30 * minute))
    got = {r.user_id: (r.state, r.confirmed, r.voided, r.timed_out, r.seq) for r in merges.latest(out, ["user_id"], ["seq", "timed_out"]).collect()}
    until, begin = base + 840 * minute, ("idle", 0, 0, 0, 0, -1, -1)
    want = {u: fold(begin, [(ms, i, k) for w, i, k, ms in {*first, *second, *third} if w == u], until, 30 * minute)[:5] for u in (1, 2, 3)}
    assert got == want
    assert want[1] == ("idle", 2, 1, 0, 10) and want[2] == ("idle", 0, 0, 1, 1) and want[3] == ("idle", 1, 0, 0, 2)


def test_messages_wait_in_one_row_of_a_micro_batch(spark):
    """what comes for a user at once is one row of state, each message once, and the fold is that of all."""
    from types import SimpleNamespace

    import pandas as pd

    from tilth.streaming.timed import Conversation

    rows, timers, talks = [], [], []
    waiting = SimpleNamespace(appendValue=rows.append, get=lambda: iter(list(rows)), put=lambda new: rows.__setitem__(slice(None), new), clear=rows.clear)
    handle = SimpleNamespace(getValueState=lambda *_: SimpleNamespace(get=lambda: talks[-1] if talks else None, update=talks.append), getListState=lambda *_: waiting, listTimers=lambda: iter(timers), registerTimer=timers.append, deleteTimer=timers.remove)
    one = Conversation(1000)
    one.init(handle)
    frame = pd.DataFrame({"ms": [5, 900, 5, 900, 7], "event_id": [1, 3, 1, 3, 2], "event_type": ["view", "error", "view", "error", "purchase"]})
    assert list(one.handleInputRows((1,), iter([frame, frame]), None)) == [] and len(rows) == 1 and len(rows[0][0]) == 3 and timers == [5]
    made = list(one.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 10), None))
    assert [tuple(x) for x in made[0].itertuples(index=False)] == [(1, 2, "idle", 1, 0, 0)] and rows == [([900], [3], ["error"])]
    list(one.handleExpiredTimer((1,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 1000), None))
    assert rows == [] and talks[-1] == fold(("idle", 0, 0, 0, 0, -1, -1), [(5, 1, "view"), (7, 2, "purchase"), (900, 3, "error")], 1000, 1000)
