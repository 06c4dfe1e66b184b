"""Threads, their messages and recent buffers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import top
from ..functions.text import strip
from ..sources.corpus import number_lines

#: A thread's natural key.
KEY = ["user_id", "entity", "stage", "mode", "thread_name"]

#: Fixed value: the name of a thread that has none.
DEFAULT_NAME = "线程1"


def thread_name(name: Column, default: str = DEFAULT_NAME) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(default))


def session_key(user: Column, entity: Column, stage: Column, mode: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("chat"), user.cast("string"), entity, stage, mode, thread_name(name))


def get_or_create(threads: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """The threads with a new row for each wanted key (``KEY``) that has none.

    New ids follow the largest one; keys get them in their own order, counted
    by ranges rather than in one task.
    """
    new = wanted.select(*KEY[:-1], thread_name(F.col("thread_name")).alias("thread_name")).dropDuplicates(KEY).join(threads.select(*KEY), KEY, "left_anti")
    top_id = threads.agg(F.coalesce(F.max("thread_id"), F.lit(0))).first()[0]
    numbered = number_lines(new.withColumn("__key", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in KEY])), "__key")
    rows = numbered.select((F.lit(top_id) + 1 + F.col("line_index")).alias("thread_id"), *KEY, now.alias("created_at"), now.alias("updated_at"))
    return threads.select("thread_id", *KEY, "created_at", "updated_at").unionByName(rows)


def list_threads(threads: DataFrame, by: list[str]) -> DataFrame:
    """Threads with their rank in a scope, latest update first, then largest id."""
    return threads.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("updated_at"), F.desc("thread_id"))))


def append_messages(threads: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads and messages after ``new`` messages; a thread's updated_at is its latest append."""
    latest = new.groupBy("thread_id").agg(F.max("created_at").alias("__at"))
    moved = threads.join(latest, "thread_id", "left").withColumn("updated_at", F.coalesce("__at", "updated_at")).drop("__at")
    return moved, messages.unionByName(new)


def recent_buffer(messages: DataFrame, now: Column, cap: int = 20, ttl: int = 43_200, key: str = "session_key", order: str = "message_id") -> DataFrame:
    """The last ``cap`` messages of each session that is still alive at ``now``, with their place from 0.

    A session's buffer expires ``ttl`` seconds after its last append, so a gap
    of that length or more begins a new one. Only gaps between the newest
    ``cap`` messages matter, so each task hands on that many of a session.
    """
    back = [F.desc("created_at"), F.desc(order)]
    newest = top(messages, [key], back, cap, "__back")
    w = W.partitionBy(key).orderBy(*back)
    gap = F.timestamp_diff("SECOND", F.col("created_at"), F.lag("created_at").over(w))
    gaps = F.sum(F.coalesce((gap >= ttl).cast("int"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = newest.withColumns({"__gaps": gaps, "__last": F.first("created_at").over(w)})
    alive = marked.where((F.col("__gaps") == 0) & (F.timestamp_diff("SECOND", F.col("__last"), now) < ttl))
    place = F.count(F.lit(1)).over(W.partitionBy(key)) - F.col("__back")
    return alive.withColumn("place", place.cast("int")).drop("__back", "__gaps", "__last")


def thread_history(messages: DataFrame, threads: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """The newest ``limit`` messages of threads (user_id, thread_id) that the user owns, place from 1 for the oldest.

    metadata that is no JSON object becomes an empty map.
    """
    owned = asked.join(threads.select("user_id", "thread_id"), ["user_id", "thread_id"], "left_semi").select("thread_id").distinct()
    newest = top(messages.join(owned, "thread_id", "left_semi"), ["thread_id"], [F.desc("created_at"), F.desc("message_id")], limit, "__rank")
    if "metadata" in newest.columns:
        newest = newest.withColumn("metadata", F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>")))
    return newest.withColumn("place", F.row_number().over(W.partitionBy("thread_id").orderBy("created_at", "message_id"))).drop("__rank")


def delete_threads(asked: DataFrame, threads: DataFrame, **tables: DataFrame) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """What is left of threads and of tables with thread_id, and the ids deleted, for asked (user_id, thread_id).

    Ids of 0 or less, repeats and threads of other users are passed over.
    """
    gone = asked.where("thread_id > 0").dropDuplicates(["user_id", "thread_id"]).join(threads.select("user_id", "thread_id"), ["user_id", "thread_id"], "left_semi").select("thread_id").distinct()
    return threads.join(gone, "thread_id", "left_anti"), {k: t.join(gone, "thread_id", "left_anti") for k, t in tables.items()}, gone


def archive(threads: DataFrame, messages: DataFrame, profiles: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """One row per thread: session_id, entity, stage, created_at, message_count, profile_id, check_status.

    ``profiles`` has entity, stage and skill_id; ``checks`` thread_id and
    status. A thread without a check is ``unchecked``.
    """
    counts = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"), F.min("created_at").alias("created_at"))
    rows = threads.drop("created_at").join(counts, "thread_id", "left").join(profiles.select("entity", "stage", F.col("skill_id").alias("profile_id")), ["entity", "stage"], "left")
    status = F.lit("unchecked")
    if checks is not None:
        rows, status = rows.join(checks.select("thread_id", "status"), "thread_id", "left"), F.coalesce("status", F.lit("unchecked"))
    return rows.select(F.col("thread_id").alias("session_id"), "entity", "stage", "created_at", F.coalesce("message_count", F.lit(0)).alias("message_count"), "profile_id", status.alias("check_status"))
