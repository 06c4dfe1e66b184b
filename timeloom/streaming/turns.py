"""Per-turn work on a stream of messages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tables import kept
from ..operators import memory
from ..sources.store import Store

#: A session's rows after a batch: its messages with their places, or after its timer one row without a message.
BUFFER = "session_key string, message_id long, role string, content string, created_at timestamp, place int"


class RecentBuffer(StatefulProcessor):
    """Keeps the last messages of a session; a timer, set anew by each append, drops them all.

    Messages are placed by their time, also those that come late but before the watermark has passed
    them; what lies ``ttl`` or more before its successor belongs to a run that has ended.
    """

    def __init__(self, cap: int, ttl: int):
        self.cap, self.ttl = cap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "message_id long, role string, content string, created_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        new = [x for f in rows for x in f[["message_id", "role", "content", "created_at"]].itertuples(index=False, name=None)]
        known = {r[0] for r in held}
        held = sorted([*held, *(r for r in dict((r[0], r) for r in new).values() if r[0] not in known)], key=lambda r: (pd.Timestamp(r[3]), r[0]))
        start = len(held) - 1
        while start > 0 and (pd.Timestamp(held[start][3]) - pd.Timestamp(held[start - 1][3])).total_seconds() < self.ttl:
            start -= 1
        held = held[max(start, len(held) - self.cap) :]
        self.held.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(held[-1][3]).timestamp() * 1000) + self.ttl * 1000)
        yield pd.DataFrame([(key[0], *r, i) for i, r in enumerate(held)], columns=["session_key", "message_id", "role", "content", "created_at", "place"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame({"session_key": [key[0]], "message_id": [None], "role": [None], "content": [None], "created_at": [pd.NaT], "place": [-1]})

    def close(self) -> None:
        pass


def recent_buffers(messages: DataFrame, cap: int = 20, ttl: int = 43_200, late: str = "1 hour") -> DataFrame:
    """A session's buffer after each of its micro-batches, for a stream (session_key, message_id, role, content, created_at).

    Rows later than ``late`` behind the newest are dropped from the buffer; a message that is sent again
    while it is held counts once. The state of a session is at most ``cap`` messages and goes with its timer,
    ``ttl`` seconds after the last one: then a row without a message (place -1) says that the buffer is empty.
    Spark needs the RocksDB state store for it.
    """
    return messages.withWatermark("created_at", late).groupBy("session_key").transformWithStateInPandas(RecentBuffer(cap, ttl), outputStructType=BUFFER, outputMode="Update", timeMode="EventTime")


def last_buffers(rows: DataFrame) -> DataFrame:
    """The buffers as they are after the last batch, from the ``recent_buffers`` of all (with their ``epoch``); expired sessions have none.

    A timer may fire in the batch of a session's last message, so its row comes after that batch's messages.
    """
    last = rows.groupBy("session_key").agg(F.max("epoch").alias("epoch"), F.max(F.when(F.col("place") < 0, F.col("epoch"))).alias("__gone"))
    return rows.where("place >= 0").join(last, ["session_key", "epoch"]).where("__gone is null or __gone < epoch").drop("__gone")


def after_turns(spark: SparkSession, path: str, now, capacity: int = 40, threshold: float = 0.4, parts: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a batch's memories are added, and the scopes it touches forget.

    The table under ``path`` is a ``Store`` with ``parts`` buckets by scope: a batch rewrites the buckets of its
    scopes and commits its number with them, so a batch that is run again changes nothing, and a batch costs
    the same whatever came before. ``memories_after`` reads the table. What a scope forgets does not depend on
    how its memories are cut into batches: ``now`` is fixed, and one that goes early would go later too.
    """
    store = Store(spark, path, memory.SCOPE, parts)

    def run(batch: DataFrame, epoch: int) -> None:
        columns = batch.columns

        def put(old: DataFrame, new: DataFrame) -> DataFrame:
            merged = kept(memory.upsert(old, new, now))
            scopes = new.select(*memory.SCOPE).distinct()
            left = memory.forget(merged.join(scopes, memory.SCOPE, "left_semi"), now, capacity, threshold).where("not forgotten").select(*columns)
            return merged.join(scopes, memory.SCOPE, "left_anti").select(*columns).unionByName(left)

        store.merge(batch, put, batch=epoch)

    return run


def memories_after(spark: SparkSession, path: str) -> DataFrame:
    """The memory table that ``after_turns`` keeps under ``path``, after all batches so far."""
    return Store(spark, path, memory.SCOPE).read()


def received_once(messages: DataFrame, at: str = "received_at", delay: str = "1 hour") -> DataFrame:
    """A stream of messages without those that are sent again within ``delay`` of each other, by the time ``at`` which they came in."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(["message_id"])


class Conversations:
    """Threads and messages under ``path``, as a stream of messages leaves them.

    Two ``Store`` tables by thread: ``messages``, and ``threads`` with the latest append. Both take a batch once
    by its number, and a message that was sent again, however late, is put in place of itself.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64):
        self.messages = Store(spark, f"{path}/messages", ["thread_id"], parts)
        self.threads = Store(spark, f"{path}/threads", ["thread_id"], parts)

    def append(self, batch: DataFrame, epoch: int) -> None:
        """A ``foreachBatch`` function for messages (message_id, thread_id, created_at, ...)."""
        new = kept(batch.dropDuplicates(["message_id"]))
        self.messages.merge(new, lambda old, more: old.join(more.select("thread_id", "message_id"), ["thread_id", "message_id"], "left_anti").unionByName(more), batch=epoch)

        def latest(old: DataFrame, more: DataFrame) -> DataFrame:
            return old.unionByName(more).groupBy("thread_id").agg(F.max("updated_at").alias("updated_at"))

        self.threads.merge(new.groupBy("thread_id").agg(F.max("created_at").alias("updated_at")), latest, batch=epoch)
