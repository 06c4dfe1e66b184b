"""The driver tables in the roles of corpus, questions, memories and turns, as Spark frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tables import read
from .functions.text import padded

#: The moment at which all memory and buffer queries are asked.
NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def timeline(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.concat(F.lit("T"), F.col("id").cast("string")).alias("stage"), F.col("id").cast("int").alias("stage_order"), F.concat(F.lit("anchor "), F.col("id").cast("string")).alias("anchor"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with ids dealt over all vectors; one without a vector stays, but searches do not find it.

    A small part that follows from the id is added to each component, so that documents of one vector lie apart.
    """
    e = read(spark, d, "embeddings")
    n = max(1, e.count())
    rows = read(spark, d, "documents").join(e, F.col("doc_id") % n == F.col("vec_id"), "left")
    order = (F.col("label") % 7).cast("int")
    return rows.select(F.concat(F.lit("doc_"), padded(F.col("doc_id"))).alias("chunk_id"), "doc_id", "text", F.col("source").alias("entity"), order.alias("stage_order"), F.concat(F.lit("T"), order.cast("string")).alias("stage"), F.transform("embedding", lambda x, i: x.cast("double") + (F.col("doc_id") * 31 + (i + 1) * 17) % 101 / 5000).alias("embedding"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "benchmark").join(read(spark, d, "embeddings"), F.col("item_id") == F.col("vec_id"))
    order = (F.col("item_id") % 7).cast("int")
    return rows.select(F.col("item_id").alias("query_id"), "text", order.alias("stage_order"), F.concat(F.lit("T"), order.cast("string")).alias("stage"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("entity"), F.col("embedding").cast("array<double>").alias("embedding"))


def memories(spark: SparkSession, d: str) -> DataFrame:
    return memories_of(read(spark, d, "events"))


def memories_of(e: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("mem_"), F.col("event_id").cast("string")).alias("memory_id"),
        "user_id",
        F.col("event_type").alias("entity"),
        F.concat(F.lit("T"), (F.col("user_id") % 7).cast("string")).alias("stage"),
        F.lit("temporal").alias("mode"),
        F.lit("thread1").alias("thread_name"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100), 4).alias("importance"),
        F.when(F.col("event_id") % 5 != 0, k / 100).alias("original_importance"),
        F.concat(F.lit("summary "), F.col("event_id").cast("string")).alias("summary"),
        F.concat(F.lit("content "), F.col("event_id").cast("string")).alias("content"),
        F.lit("{}").alias("metadata"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
        F.when(F.col("event_id") % 3 == 0, ts + F.expr("interval 1 day")).alias("last_used_at"),
    )


def with_vectors(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """All rows, their ids dealt over all vectors; a row without a vector stays."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("__v"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = max(1, e.count())
    return rows.withColumn("__v", F.col("id") % n).join(e, "__v", "left").drop("__v")


def recall_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every event whose id is divisible by 20 asks in its own scope, with the vector after its own."""
    m = memories(spark, d).where("id % 20 = 0").withColumn("id", F.col("id") + 1)
    got = with_vectors(spark, d, m)
    return got.select(F.col("id").alias("query_id"), "user_id", "entity", "stage", "mode", "thread_name", "embedding")


def threads(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("conv_id")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return (
        read(spark, d, "conversations")
        .select("conv_id")
        .distinct()
        .select(
            c.alias("thread_id"),
            (c % 10).alias("user_id"),
            F.concat(F.lit("src"), (c % 4).cast("string")).alias("entity"),
            F.concat(F.lit("T"), (c % 7).cast("string")).alias("stage"),
            F.when(c % 2 == 0, "temporal").otherwise("transparent").alias("mode"),
            F.concat(F.lit("thread"), c.cast("string")).alias("thread_name"),
            at.alias("created_at"),
            (at + F.make_dt_interval(F.lit(0), F.lit(0), c.cast("int"))).alias("updated_at"),
        )
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    return messages_of(read(spark, d, "conversations"))


def messages_of(conversations: DataFrame) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    seconds = c * 60 + t * 3600 + F.floor(t / 4) * 86_400
    return conversations.select((c * 1000 + t).alias("message_id"), c.alias("thread_id"), F.concat(F.lit("key"), c.cast("string")).alias("session_key"), "role", F.col("text").alias("content"), F.timestamp_seconds(F.lit(1_704_067_200) + seconds).alias("created_at"))


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Per nation: events are the names of all its customers by key, relations its market segments with their counts."""
    cust = read(spark, d, "customer")
    events = cust.groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("events"))
    counts = cust.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).cast("string").alias("n"))
    relations = counts.groupBy("c_nationkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("c_mktsegment", "n")))).alias("relationships"))
    rows = read(spark, d, "nation").join(events, F.col("n_nationkey") == events["c_nationkey"], "left").drop("c_nationkey").join(relations, F.col("n_nationkey") == relations["c_nationkey"], "left").drop("c_nationkey")
    stage = F.concat(F.lit("T"), F.col("n_regionkey").cast("string"))
    text = lambda what: F.concat(F.lit(what + " "), F.col("n_name"))
    meta = F.struct(F.col("n_name").alias("character"), stage.alias("timeline_stage"), text("anchor").alias("global_timeline_anchor"), F.lit("stage").alias("knowledge_type"), F.lit("high").alias("anti_future_sight_level"), F.lit("nation").alias("source"))
    nothing = F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit("skill_"), F.col("n_nationkey").cast("string")).alias("skill_id"),
        F.lit("stage").alias("record_type"),
        F.col("n_name").alias("character"),
        stage.alias("stage_id"),
        text("stage of").alias("stage_name"),
        F.col("n_regionkey").cast("int").alias("stage_order"),
        text("position").alias("positioning"),
        text("state").alias("persona_state"),
        F.array(F.lit("one"), F.lit(""), F.col("n_name")).alias("beliefs"),
        F.lit("calm").alias("mood"),
        F.lit("plain").alias("style"),
        F.coalesce("events", nothing).alias("known_events"),
        F.array(F.lit("later")).alias("forbidden_events"),
        "relationships",
        F.array(F.lit("a"), F.lit("b")).alias("tendencies"),
        nothing.alias("drift"),
        F.array(F.lit("rule")).alias("rules"),
        F.struct(text("anchor").alias("stage_anchor"), F.array(F.lit("e1"), F.lit("e2")).alias("event_distillation"), nothing.alias("persona_texture"), F.array(F.lit("m")).alias("dialogue_mimic"), text("boost").alias("content_boost")).alias("enrichment"),
        F.struct(F.concat(F.lit("card_"), F.col("n_nationkey").cast("string")).alias("card_id"), text("card of").alias("content"), meta.alias("metadata")).alias("card"),
        F.lit("nation.jsonl").alias("file"),
    )


def replies(spark: SparkSession, d: str) -> DataFrame:
    """Router replies from events: clean JSON, fenced, within prose, and broken, by event_id % 4."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"intent": "'), F.when(F.col("event_id") % 3 == 0, "relationship").when(F.col("event_id") % 3 == 1, "daily_chat").otherwise("unheard_of"), F.lit('", "persona_k": '), k, F.lit(', "confidence": '), F.round(F.col("value") / 100, 4).cast("string"), F.lit(', "future_risk": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(', "relationship_target": "'), F.when(F.col("event_id") % 5 == 0, "None").otherwise(F.col("event_type")), F.lit('", "rewritten_query": ""}'))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.concat(F.lit("{broken "), k))
    return read(spark, d, "events").select(F.col("event_id").alias("query_id"), raw.alias("raw"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"))
