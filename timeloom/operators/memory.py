"""Episodic memories: recall, boost and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept, top
from ..functions.text import strip
from ..sources.index import upsert as upsert_rows
from .vectors import nearest_in_groups, similarity

#: A memory belongs to one of these.
SCOPE = ["user_id", "entity", "stage", "mode", "thread_name"]

WEEK = 604_800

#: Fixed value: what stands before the original text in the index.
ORIGINAL = "原始内容："


def turn_memories(messages: DataFrame, by: str = "conv_id", order: str = "turn", text: str = "text", speaker: str | Column = "", importance: float = 0.4) -> DataFrame:
    """One memory per question of a user that an assistant answers next: question, answer, summary, content, importance."""
    w = W.partitionBy(by).orderBy(order)
    paired = messages.withColumns({"__next": F.lead("role").over(w), "answer": F.lead(text).over(w)})
    # The labels of question and answer.
    who = F.lit(speaker) if isinstance(speaker, str) else speaker
    asked, said = F.coalesce(F.col(text), F.lit("")), F.coalesce("answer", F.lit(""))
    return paired.where("role = 'user' and __next = 'assistant'").select(
        by,
        order,
        F.col(text).alias("question"),
        "answer",
        F.concat(F.lit("用户提问："), F.substring(asked, 1, 160), F.lit(" | "), who, F.lit("回答："), F.substring(said, 1, 220)).alias("summary"),
        F.concat(F.lit("用户提问："), asked, F.lit("\n"), who, F.lit("回答："), said).alias("content"),
        F.lit(importance).alias("importance"),
    )


def memory_id(created_at: Column, *unique: Column) -> Column:
    """mem_{user}_{entity}_{stage}_{thread}_{ms}_{8 hex}; the last part is a hash of what tells the turn, so a rerun agrees."""
    parts = [F.translate(F.col(c).cast("string"), " :", "__") for c in ("user_id", "entity", "stage", "thread_name")]
    return F.concat(F.lit("mem_"), F.concat_ws("_", *parts), F.lit("_"), F.unix_millis(created_at).cast("string"), F.lit("_"), F.substring(F.sha2(F.concat_ws("\x1f", *[u.cast("string") for u in unique]), 256), 1, 8))


def clamped(importance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), importance.cast("double")))


def upsert(memories: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Memories after ``new`` ones (the same columns): by memory_id content, summary, importance and metadata are replaced.

    Scope, id and created_at of a known memory stay. original_importance is
    what the new row states, else its importance.
    """
    replaced = ["content", "summary", "importance", "metadata", "original_importance"]
    n = new.withColumn("importance", clamped(F.col("importance"))).withColumn("original_importance", F.coalesce("original_importance", "importance"))
    both = memories.select(F.struct("*").alias("o"), "memory_id").join(n.select(F.struct("*").alias("n"), "memory_id"), "memory_id", "full_outer")
    out = []
    for c in memories.columns:
        old, got = F.col(f"o.`{c}`"), F.col(f"n.`{c}`")
        if c == "updated_at":
            out.append(F.when(F.col("n").isNotNull(), now).otherwise(old).alias(c))
        elif c in replaced:
            out.append(F.when(F.col("n").isNotNull(), got).otherwise(old).alias(c))
        else:
            out.append(F.when(F.col("o").isNotNull(), old).otherwise(got).alias(c))
    return both.select(*out)


def strongest(memories: DataFrame, least: float = 0.0, limit: int = 20, by: list[str] = SCOPE) -> DataFrame:
    """The first memories of each scope by importance, update and id; a scope without thread_name spans its threads."""
    order = [F.desc("importance"), F.desc("updated_at"), F.desc("id")]
    return top(memories.where(F.col("importance") >= least), by, order, max(1, limit))


def by_ids(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("memory_id").distinct(), "memory_id", "left_semi")


def touch(memories: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Memories with last_used_at = now where their id is named."""
    used = ids.select("memory_id").distinct().withColumn("__used", F.lit(True))
    return memories.join(used, "memory_id", "left").withColumn("last_used_at", F.when(F.col("__used"), now).otherwise(F.col("last_used_at"))).drop("__used")


def boost(memories: DataFrame, recalls: DataFrame, now: Column, step: float = 0.05, most: float = 0.95) -> DataFrame:
    """Memories after recalls (memory_id, a row a time): each adds ``step`` up to ``most``, and a higher one is lowered to it."""
    n = recalls.groupBy("memory_id").agg(F.count(F.lit(1)).alias("__n"))
    got = memories.join(n, "memory_id", "left")
    raised = F.least(F.lit(most), F.col("importance") + F.col("__n") * step)
    return got.withColumns({"importance": F.when(F.col("__n") > 0, raised).otherwise(F.col("importance")), "last_used_at": F.when(F.col("__n") > 0, now).otherwise(F.col("last_used_at"))}).drop("__n")


def recency(now: Column, *times: Column) -> Column:
    """1 at ``now`` to 0 a week ago from the first time that is known; 0.5 if none is. Later times count as now."""
    at = F.coalesce(*times)
    age = (now.cast("double") - at.cast("double")) / WEEK
    return F.when(at.isNull(), F.lit(0.5)).otherwise(1 - F.least(F.greatest(age, F.lit(0.0)), F.lit(1.0)))


def recall(queries: DataFrame, memories: DataFrame, now: Column, limit: int = 3, least: float = 0.15, rows: DataFrame | None = None) -> DataFrame:
    """query_id, memory_id, score, importance, text, rank for queries with a scope and an embedding.

    The max(5 * limit, 10) nearest memories of the scope with enough importance
    are ranked by (0.8 similarity + 0.2 recency) * (0.8 + 0.4 importance).
    ``memories`` is the index; ``rows``, if given, has the current values of
    importance, summary, content and times by memory_id, which go before the
    index's. A query whose scope has no hit gets the strongest memories of
    ``rows`` (or the index) with their importance as score. Vectors with a
    component that is null or not finite are not near to anything.

    Questions meet memories in cells of bounded size (``nearest_in_groups``),
    on ids and vectors only; the few that are near get their texts afterwards.
    """
    mine = queries.select("query_id", *SCOPE, "embedding")
    near = nearest_in_groups(mine, memories.where(F.col("importance") >= least), SCOPE, "memory_id", max(5 * limit, 10))
    fields = ["importance", "summary", "content", "created_at", "last_used_at"]
    pool = kept(near.drop("dense_rank").join(memories.select("memory_id", *fields), "memory_id"))
    if rows is not None:
        current = rows.select("memory_id", F.struct(*fields).alias("__row"))
        pool = pool.join(current, "memory_id", "left").withColumns({c: F.when(F.col("__row").isNotNull(), F.col(f"__row.{c}")).otherwise(F.col(c)) for c in fields})
    score = (similarity(F.col("distance")) * 0.8 + recency(now, F.col("last_used_at"), F.col("created_at")) * 0.2) * (0.8 + F.col("importance") * 0.4)
    text = F.coalesce(F.nullif("summary", F.lit("")), "content")
    columns = ["query_id", "memory_id", "score", "importance", text.alias("text"), "rank"]
    found = top(pool.withColumn("score", score), ["query_id"], [F.desc("score"), F.col("memory_id")], limit).select(*columns)
    without = mine.drop("embedding").join(pool.select("query_id").distinct(), "query_id", "left_anti")
    table = memories if rows is None else rows
    # The scopes' strongest first, so that no query meets more than its limit.
    others = without.join(strongest(table, least, limit), SCOPE).withColumn("score", F.col("importance"))
    return found.unionByName(others.select(*columns))


def retention(now: Column) -> Column:
    """0.60 importance + 0.25 recency + 0.15 original importance; here a later time than ``now`` counts above 1."""
    age = F.timestamp_diff("SECOND", F.coalesce("last_used_at", "created_at"), now)
    original = F.coalesce(F.round("original_importance", 4), F.col("importance"))
    return 0.60 * F.col("importance") + 0.25 * F.greatest(F.lit(0.0), 1 - age / float(WEEK)) + 0.15 * original


def forget(memories: DataFrame, now: Column, capacity: int = 40, threshold: float = 0.4, by: list[str] = SCOPE) -> DataFrame:
    """``memories`` with retention and forgotten.

    A scope over its capacity forgets as many as it has too many, of those with
    at most the threshold's importance the ones with the lowest retention;
    equal ones by importance, last use and id. Fewer may qualify.
    """
    # Scopes are counted first, so only what may be forgotten is sorted.
    over = memories.groupBy(*by).agg((F.count(F.lit(1)) - capacity).alias("__over")).where("__over > 0").withColumnsRenamed({c: f"__{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    rated = memories.withColumn("retention", retention(now)).join(over, same, "left").drop(*[f"__{c}" for c in by])
    may = F.col("__over").isNotNull() & F.coalesce(F.col("importance") <= threshold, F.lit(False))
    order = W.partitionBy(*by).orderBy("retention", "importance", F.coalesce("last_used_at", "created_at"), "id")
    ranked = rated.where(may).withColumn("forgotten", F.row_number().over(order) <= F.col("__over"))
    return ranked.unionByName(rated.where(~may).withColumn("forgotten", F.lit(False))).drop("__over")


def delete_for_threads(memories: DataFrame, user_threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left, and the ids deleted, for (user_id, thread_id) with ids above 0."""
    gone = user_threads.where("thread_id > 0").dropDuplicates(["user_id", "thread_id"])
    ids = memories.join(gone, ["user_id", "thread_id"], "left_semi").select("memory_id")
    return memories.join(ids, "memory_id", "left_anti"), ids


def index_text(content: Column, summary: Column, entity: Column, stage: Column, thread: Column) -> Column:
    """The six labelled lines that a memory is indexed by."""
    # The lines' labels.
    lines = ["记忆类型：episodic", ("角色：", entity), ("时间线阶段：", stage), ("线程：", thread), ("摘要：", F.coalesce(F.nullif(summary, F.lit("")), content)), (ORIGINAL, content)]
    return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else F.concat(F.lit(x[0]), F.coalesce(x[1], F.lit("None"))) for x in lines])


def original_text(text: Column) -> Column:
    """What follows the first marker of an index text, or all of it."""
    at = F.locate(ORIGINAL, text)
    return F.when(at > 0, strip(F.substring(text, at + len(ORIGINAL), F.char_length(text)))).otherwise(text)


def sync_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index (memory_id, text, and the columns it shares with ``rows``) after changed rows."""
    text = index_text(F.col("content"), F.col("summary"), F.col("entity"), F.col("stage"), F.col("thread_name"))
    return upsert_rows(index, rows.withColumn("text", text).select(*index.columns), "memory_id")


def summaries(recalled: DataFrame, first: int = 3) -> DataFrame:
    """query_id, summary: the texts of the first memories recalled, joined."""
    return recalled.where(F.col("rank") <= first).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "；").alias("summary"))


def stats(recalled: DataFrame, most: int = 20) -> DataFrame:
    """query_id, memories: how many may be recalled, up to ``most``."""
    return recalled.where(F.col("rank") <= most).groupBy("query_id").agg(F.count(F.lit(1)).alias("memories"))


def result_lines(recalled: DataFrame) -> DataFrame:
    """Recalled memories with a line for people: a preview of 80 characters and scores of two decimals."""
    # The labels of a line.
    preview = F.when(F.char_length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    # By the double's exact value, as C and Python print it; format_string rounds its shortest decimal, so 0.945 would be 0.95.
    two = lambda c: F.call_function("format_number", F.col(c).cast("double"), F.lit("0.00"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". [情景记忆] "), preview, F.format_string(" (重要性: %s, 相关度: %s)", two("importance"), two("score")))
    return recalled.withColumn("line", line)


def search(queries: DataFrame, memories: DataFrame, now: Column, types: list[str] | None = None, **kwargs) -> DataFrame:
    """``recall`` for callers that name memory types: without ``episodic`` nothing is found."""
    asked = queries if types is None or "episodic" in types else queries.where("false")
    return recall(asked, memories, now, **kwargs)


#: Actions by name, for callers that dispatch on a column or an argument.
ACTIONS = {"add": upsert, "search": search, "summary": summaries, "stats": stats, "forget": forget, "clear": delete_for_threads}
