"""What an answer is to be written from: five blocks in order of priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import top
from ..functions.text import strip
from ..operators.profiles import profile_for
from ..operators.routing import build_queries
from .retrieval import corpus_settings, hybrid, profile_settings

#: The blocks by priority.
BLOCKS = ("memory", "relations", "profile", "corpus", "external")

#: What stands for a block without items.
NO_ITEMS = "无"


def relations_asked(queries: DataFrame, profiles: DataFrame, aliases: DataFrame) -> DataFrame:
    """query_id, item_id, line, position of each relation that a query is about.

    ``queries`` has query_id, entity, stage, query and target (may be null),
    ``profiles`` entity, stage and the map relationships, ``aliases`` name and
    alias (a name without any goes by itself). A relation is meant if the
    target is its name or an alias, or contains the name, or if the query
    contains an alias.
    """
    mine = queries.select("query_id", "entity", "stage", "query", "target").join(profiles.select("entity", "stage", "relationships"), ["entity", "stage"])
    each = mine.select("query_id", "entity", "stage", "query", "target", F.posexplode(F.map_entries("relationships")).alias("position", "r")).select("*", F.col("r.key").alias("name"), F.col("r.value").alias("description")).drop("r")
    known = aliases.groupBy("name").agg(F.collect_set("alias").alias("__aliases"))
    named = each.join(known, "name", "left").withColumn("__aliases", F.coalesce("__aliases", F.array("name")))
    by_target = F.coalesce((F.col("target") != "") & ((F.col("target") == F.col("name")) | F.array_contains("__aliases", F.col("target")) | F.contains("target", F.col("name"))), F.lit(False))
    by_query = F.exists("__aliases", lambda a: (a != "") & F.contains(F.col("query"), a))
    # The ids and labels of this block's lines, as in the other blocks below.
    item = F.concat(F.lit("stage_profile_"), "entity", F.lit("_"), "stage", F.lit("_relationship_"), "name")
    line = F.concat(F.lit("["), item, F.lit("] "), "entity", F.lit("在"), "stage", F.lit("阶段对"), "name", F.lit("的关系态度："), F.coalesce("description", F.lit("")))
    return named.where(by_target | by_query).select("query_id", item.alias("item_id"), line.alias("line"), "position")


def relation_context(found: DataFrame) -> DataFrame:
    """query_id, relations: the lines of one query, in the order of its profile."""
    return found.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("relations"))


def external_items(queries: DataFrame, results: DataFrame, most: int = 5) -> DataFrame:
    """query_id, item_id, title, url, content, position of outside results, the first ``most`` of each query.

    Only for queries in transparent mode that need a search and have words to
    search for.
    """
    may = queries.where((F.col("mode") == "transparent") & F.col("web_search_needed") & (strip(F.col("web_search_query")) != "")).select("query_id")
    text = {c: F.coalesce(c, F.lit("")) for c in ("title", "url", "content")}
    clean = results.join(may, "query_id", "left_semi").withColumns(text)
    first = top(clean, ["query_id"], [F.col("position")], most, "__rank").drop("__rank")
    return first.select("query_id", F.concat(F.lit("web_search:"), F.coalesce(F.nullif("url", F.lit("")), F.col("title"))).alias("item_id"), "title", "url", "content", "position")


def assemble(items: DataFrame, headings: dict[str, str]) -> DataFrame:
    """query_id, context from rows (query_id, block, position, line): every block under its heading, by priority.

    Items of profile, corpus and external are a blank line apart, others a
    line. A query without items in memory, profile, corpus and external has no
    row, whatever its relations.
    """
    asked = items.groupBy("query_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("block") == b, F.struct("position", "line")))).alias(b) for b in BLOCKS])
    asked = asked.where(" or ".join(f"size({b}) > 0" for b in BLOCKS if b != "relations"))
    parts = []
    for b in BLOCKS:
        joined = F.array_join(F.transform(b, lambda x: x["line"]), "\n" if b in ("memory", "relations") else "\n\n")
        parts.append(F.concat(F.lit(headings[b] + "\n"), F.coalesce(F.nullif(joined, F.lit("")), F.lit(NO_ITEMS))))
    return asked.select("query_id", F.concat_ws("\n\n", *parts).alias("context"))


def memory_lines(memories: DataFrame) -> DataFrame:
    """Recalled memories (query_id, memory_id, importance, score, content, rank) as lines of the block."""
    line = F.concat(F.lit("["), "memory_id", F.lit("] 重要性="), F.format_string("%.2f", F.col("importance").cast("double")), F.lit(" 相关度="), F.format_string("%.2f", F.col("score").cast("double")), F.lit(" "), "content")
    return memories.select("query_id", F.lit("memory").alias("block"), F.col("rank").alias("position"), line.alias("line"))


def chunk_lines(results: DataFrame, chunks: DataFrame, block: str) -> DataFrame:
    """Retrieved chunks (query_id, chunk_id, rank) as lines; corpus ones name their stage and section."""
    body = F.concat(F.lit("["), "chunk_id", F.lit("] "), "text")
    if block == "corpus":
        body = F.concat(F.lit("["), "chunk_id", F.lit("] 阶段="), F.coalesce("stage", F.lit("?")), F.lit(" 章节="), F.coalesce("section_title", F.lit("?")), F.lit("\n"), "text")
    own = ["chunk_id", "text"] + (["stage", "section_title"] if block == "corpus" else [])
    return results.select("query_id", "chunk_id", "rank").join(chunks.select(*own), "chunk_id").select("query_id", F.lit(block).alias("block"), F.col("rank").alias("position"), body.alias("line"))


def external_lines(items: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), "item_id", F.lit("] 标题="), "title", F.lit("\nURL="), "url", F.lit("\n"), "content")
    return items.select("query_id", F.lit("external").alias("block"), "position", line.alias("line"))


def prepare(queries: DataFrame, profiles: DataFrame, profile_chunks: DataFrame, corpus: DataFrame, goal: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search text, profile results and corpus results for queries (query_id, entity, stage, stage_order, query, embedding).

    Queries of unknown stages are left out; ``profile_for`` tells which.
    """
    known, _ = profile_for(queries, profiles)
    built = build_queries(known, goal).withColumn("text", F.col("search_text"))
    return built, hybrid(built, profile_chunks, profile_settings(k)), hybrid(built, corpus, corpus_settings(k))


def history(messages: DataFrame, current: DataFrame) -> DataFrame:
    """Messages (thread_id, message_id, role, content) of users and assistants that say something.

    The last one of a thread goes if it is the message being answered:
    ``current`` has thread_id and message.
    """
    clean = messages.where(F.col("role").isin("user", "assistant") & (F.coalesce("content", F.lit("")) != ""))
    last = top(clean, ["thread_id"], [F.desc("message_id")], 1, "__rank").where("role = 'user'").join(current.select("thread_id", "message"), "thread_id").where(F.col("content") == F.col("message"))
    return clean.join(last.select("thread_id", "message_id"), ["thread_id", "message_id"], "left_anti")
