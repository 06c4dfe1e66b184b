"""Registered queries over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import standins as S
from .functions.tables import kept, new_path, read, top
from .functions.text import mentions, piped, split_lines, tokens
from .operators import chunks as C
from .operators import memory as M
from .operators import profiles as P
from .operators import ranking as R
from .operators import routing as Q
from .operators import threads as H
from .operators.vectors import embed, nearest, similarity
from .plans import context as X
from .plans import retrieval as V
from .sources import corpus, index
from .sources.text_index import TextIndex
from .sources.vector_index import VectorIndex

#: Arguments of the text operators over invented prose.
HEADINGS = {"book": "Th[aeiou]n", "part": "Er", "prologue": "On$", "chapter": "[AÉ]"}
NAMES = ["the", "and", "that", "with"]
ALIASES = {"thes": "the", "of": "ofer"}
MARKERS = ["&&&", "@@@"]
RULES = [({"text": "tion"}, "T3"), ({"text": "ung"}, "T2"), ({"text": "de"}, "T1")]
GOAL = "goal"
BLOCKS = {b: f"[{b}]" for b in X.BLOCKS}


def _6(c: str):
    return F.round(c, 6).alias(c)


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_terms"))


def _topk(spark: SparkSession, d: str, visible: str, k: int, indexed: bool = True) -> DataFrame:
    q, c = S.questions(spark, d), S.chunks(spark, d)
    found = VectorIndex(spark, new_path(spark, "vectors")).build(c).search(q, k, visible) if indexed else nearest(q, c, k, visible)
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), F.round(similarity(F.col("distance")), 6).alias("dense_score"), "dense_rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _topk(spark, d, "all", 5)


def visible_topk(spark: SparkSession, d: str) -> DataFrame:
    return _topk(spark, d, "so_far", 5)


def scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    return _topk(spark, d, "scope", 5, indexed=False)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    s = V.corpus_settings()
    return kept(V.candidates(S.questions(spark, d), S.chunks(spark, d), s).where("in_pool").select("query_id", "chunk_id"))


def bm25_pool(spark: SparkSession, d: str) -> DataFrame:
    q, c = S.questions(spark, d).select("query_id", "text"), S.chunks(spark, d).select("chunk_id", "text")
    return R.bm25(q, _pool(spark, d), texts=c).select("query_id", "chunk_id", _6("score"))


def bm25_corpus(spark: SparkSession, d: str) -> DataFrame:
    """With the counts of the whole corpus, from stored postings."""
    q, c = S.questions(spark, d).select("query_id", "text"), S.chunks(spark, d).select("chunk_id", "text")
    return TextIndex(spark, new_path(spark, "postings")).build(c).bm25(q, _pool(spark, d)).select("query_id", "chunk_id", _6("score"))


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """Two routes without a model: order totals and counts of customers (chunk) in market segments (query)."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy(F.col("c_mktsegment").alias("query_id"), F.col("o_custkey").alias("chunk_id")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    one = per.where("chunk_id % 3 <> 0").select("query_id", "chunk_id", F.lit("dense").alias("route"), F.col("total").alias("score"))
    return one.unionByName(per.where("chunk_id % 4 <> 0").select("query_id", "chunk_id", F.lit("bm25").alias("route"), F.col("n").alias("score")))


def minmax_routes(spark: SparkSession, d: str) -> DataFrame:
    return R.min_max(_routes(spark, d), ["query_id", "route"]).select("query_id", "chunk_id", "route", _6("norm"))


def fuse_routes(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(R.min_max(_routes(spark, d), ["query_id", "route"]), {"dense": 0.7, "bm25": 0.3}).select("query_id", "chunk_id", _6("fused_score"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", _6("dense_score"), _6("bm25_score"), _6("fused_score"), _6("rerank_score"), "rank")


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return _shown(V.hybrid(S.questions(spark, d), S.chunks(spark, d), V.corpus_settings()))


def hybrid_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _shown(V.hybrid(S.questions(spark, d), S.chunks(spark, d), V.profile_settings()))


def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    s = V.corpus_settings()
    c = S.chunks(spark, d)
    dense = V.candidates(S.questions(spark, d), c, s).where("in_dense").join(c.select("chunk_id", "doc_id"), "chunk_id")
    relevance = dense.select("query_id", "chunk_id", (((F.col("query_id") * 31 + F.col("doc_id") * 17) % 1000) / 1000.0).alias("relevance"))
    return R.rerank(dense.select("query_id", "chunk_id"), relevance, s.k).select("query_id", "chunk_id", "rerank_score", "rerank_rank")


def stage_audit(spark: SparkSession, d: str) -> DataFrame:
    q, c = S.questions(spark, d), S.chunks(spark, d)
    found = nearest(q, c, 5, "all")
    return V.beyond_stage(found.select("query_id", "chunk_id"), q, c).select("query_id", "chunk_id", "stage_order", "asked")


def sections(spark: SparkSession, d: str) -> DataFrame:
    found = C.sections(read(spark, d, "documents"), HEADINGS)
    return found.select("doc_id", "section_index", "book", "part", "section_title", F.char_length("body").alias("n_chars"), F.md5("body").alias("body_md5"))


def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    split = F.posexplode(C.split_fixed(F.col("text"), 1800, 180)).alias("piece", "chunk")
    return read(spark, d, "documents").select("doc_id", split).select("doc_id", "piece", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    split = F.posexplode(C.split_column(1800, 180, ["\n\n", "\n", "。", "；", "，", ""])("text")).alias("piece", "chunk")
    return read(spark, d, "documents").select("doc_id", split).select("doc_id", "piece", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("piece", "text")).where("text <> ''")
    rows = lines.withColumn("stage", F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string")))
    return C.number_chunks(rows, ["doc_id", "piece"]).select("doc_id", "piece", "chunk_index", "chunk_id")


def corpus_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = C.corpus_chunks(read(spark, d, "documents"), HEADINGS, markers=MARKERS, rules=RULES, names=NAMES, aliases=ALIASES)
    return found.select("chunk_id", "doc_id", "section_index", "piece", "stage", "character_mentions", F.md5("text").alias("text_md5"))


def stage_infer(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").withColumn("stage", C.infer_stage(RULES, "T0"))
    return C.known_stages(rows.select("doc_id", "stage"), S.timeline(spark)).select("doc_id", "stage", "stage_order", "anchor")


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    found = mentions(F.col("text"), NAMES, ALIASES)
    return read(spark, d, "documents").select("doc_id", piped(found).alias("character_mentions"), F.size(found).alias("n"))


def skip_markers(spark: SparkSession, d: str) -> DataFrame:
    return C.without_markers(read(spark, d, "documents"), MARKERS).select("doc_id", "source")


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_counts(("chunks", S.chunks(spark, d)), ("profiles", P.profile_chunks(S.profiles(spark, d))))


def profile_sections(spark: SparkSession, d: str) -> DataFrame:
    p = S.profiles(spark, d)
    both = p.unionByName(p.withColumn("record_type", F.lit("meta")))  # rows that are to be left out
    return P.profile_chunks(P.stage_rows(both)).select("chunk_id", "chunk_kind", "text", "character", "timeline_stage", "stage_order", "card_id", "source")


def profile_text(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_text(S.profiles(spark, d)).select("skill_id", "text")


def profile_metadata(spark: SparkSession, d: str) -> DataFrame:
    return corpus.clean_metadata(P.profile_metadata(S.profiles(spark, d)), ["skill_id", "record_type", "character", "timeline_stage", "stage_id", "stage_name", "stage_order", "card_id", "knowledge_type", "anti_future_sight_level", "global_timeline_anchor", "source", "source_format"])


def enrich_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = S.profiles(spark, d)
    new = p.groupBy("stage_id").agg(F.min("enrichment").alias("e")).where("stage_id <> 'T4'")
    new = new.select("stage_id", F.struct(F.concat(F.lit("new "), "stage_id").alias("stage_anchor"), F.col("e.event_distillation").alias("event_distillation"), F.col("e.persona_texture").alias("persona_texture"), F.col("e.dialogue_mimic").alias("dialogue_mimic"), F.when(F.col("stage_id") == "T1", "card").otherwise(F.concat(F.lit("more "), "stage_id")).alias("content_boost")).alias("enrichment"))
    done, _ = P.enrich(P.enrich(p, new)[0], new)
    return done.select("skill_id", "stage_id", F.col("enrichment.stage_anchor").alias("stage_anchor"), F.col("card.content").alias("card_text"))


def inventory_check(spark: SparkSession, d: str) -> DataFrame:
    p = S.profiles(spark, d)
    declared = read(spark, d, "nation").select(F.col("n_name").alias("character"), F.when(F.col("n_regionkey") == 4, F.array(F.lit("T0"))).otherwise(F.array(F.lit("T0"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")))).alias("active_stages"))
    return P.inventory_gaps(declared, p)


def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers ask for their nation's profile, every third of them at a stage that it may not have."""
    n = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    q = n.select(F.col("s_suppkey").alias("query_id"), F.col("n_name").alias("entity"), F.concat(F.lit("T"), F.when(F.col("s_suppkey") % 3 == 0, 0).otherwise(F.col("n_regionkey")).cast("string")).alias("stage"))
    p = S.profiles(spark, d).select(F.col("character").alias("entity"), F.col("stage_id").alias("stage"), "skill_id")
    good, bad = P.profile_for(q, p)
    return good.select("query_id", "entity", "stage", "skill_id").unionByName(bad.select("query_id", "entity", "stage", F.lit(None).cast("string").alias("skill_id")))


def relation_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    q = c.select(F.col("c_custkey").alias("query_id"), F.col("n_name").alias("entity"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("stage"), F.concat(F.lit("about "), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise("all")).alias("query"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("target"))
    p = S.profiles(spark, d).select(F.col("character").alias("entity"), F.col("stage_id").alias("stage"), "relationships")
    aliases = read(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lower("c_mktsegment").alias("alias")).distinct()
    return X.relation_context(X.relations_asked(q, p, aliases))


def build_query(spark: SparkSession, d: str) -> DataFrame:
    p = S.profiles(spark, d).select(F.col("character").alias("entity"), F.col("stage_id").alias("stage"), "stage_name", "known_events")
    n = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    q = n.select(F.col("s_suppkey").alias("query_id"), F.col("n_name").alias("entity"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("stage"), F.col("s_name").alias("query"))
    return Q.build_queries(P.profile_for(q, p)[0], GOAL).select("query_id", "search_text")


def routing_digests(spark: SparkSession, d: str) -> DataFrame:
    return Q.digests(S.profiles(spark, d)).select("skill_id", "known_digest", "forbidden_digest", "relation_names")


def route_parse(spark: SparkSession, d: str) -> DataFrame:
    got = Q.parse_replies(S.replies(spark, d))
    return got.select("query_id", "parsed", "intent", _6("confidence"), "relationship_target", "future_risk", "retrieval_policy", "persona_k", "novel_k", "web_search_needed", "web_search_query", "rewritten_query", "answer_guidance")


def route_defaults(spark: SparkSession, d: str) -> DataFrame:
    r = S.replies(spark, d)
    decided = Q.parse_replies(r.where("query_id % 2 = 0"))
    return Q.wanting(Q.with_defaults(r.select("query_id", "query"), decided), "persona_k").select("query_id", "persona_k", "novel_k", "search_query")


def mode_names(spark: SparkSession, d: str) -> DataFrame:
    """Modes by any of their names: ship modes and flags of line items stand for user input."""
    t = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 4 == 0, " Realistic ").when(F.col("l_linenumber") % 4 == 1, "1").when(F.col("l_linenumber") % 4 == 2, "TRANSPARENT").otherwise(F.col("l_returnflag")).alias("mode"))
    good, bad = Q.normalise_modes(t)
    return good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False))).groupBy("mode", "ok").agg(F.count(F.lit(1)).alias("n"))


def turn_validation(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    t = c.select("conv_id", "turn", F.concat(F.lit("T"), (F.col("conv_id") % 9).cast("string")).alias("stage"), F.when(F.col("conv_id") % 5 == 0, "other").otherwise("temporal").alias("mode"), F.rpad(F.lit("n"), F.when(F.col("conv_id") % 11 == 0, 129).otherwise(128).cast("int"), F.lit("n")).alias("thread_name"), F.when(F.col("turn") == 2, "").otherwise(F.concat(F.lit("  "), "text")).alias("message"))
    good, bad = Q.validate_turns(t, [f"T{i}" for i in range(7)])
    keep = ["conv_id", "turn", "reject_reason", "n_chars"]
    n = F.char_length("message").alias("n_chars")
    return good.select("conv_id", "turn", F.lit(None).cast("string").alias("reject_reason"), n).unionByName(bad.select("conv_id", "turn", "reject_reason", n)).select(*keep)


def entity_slugs(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("k")).withColumn("slug", F.concat(F.lit("nation-"), F.col("k").cast("string")))
    dim = read(spark, d, "nation").select(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("slug"), "n_name")
    good, bad = Q.known_slugs(o, dim)
    return good.groupBy("slug", "n_name").count().unionByName(bad.groupBy("slug").count().withColumn("n_name", F.lit(None).cast("string"))).withColumnRenamed("count", "n")


def assemble_context(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest chunks in scope as profile, five so far as corpus, whole pages as outside results."""
    q, c = S.questions(spark, d), S.chunks(spark, d)
    titled = c.withColumn("section_title", F.col("entity"))
    scoped = nearest(q, c, 5, "scope").withColumnRenamed("dense_rank", "rank")
    so_far = nearest(q, c, 5, "so_far").withColumnRenamed("dense_rank", "rank")
    asks = q.select("query_id", F.lit("transparent").alias("mode"), (F.col("query_id") % 2 == 0).alias("web_search_needed"), F.lit("q").alias("web_search_query"))
    results = read(spark, d, "pages").select((F.col("page_id") % 50).alias("query_id"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.when(F.col("page_id") % 3 == 0, F.lit(None)).otherwise(F.col("url")).alias("url"), F.col("html").alias("content"), F.col("page_id").alias("position"))
    outside = X.external_items(asks, results)
    items = X.chunk_lines(scoped, titled, "profile").unionByName(X.chunk_lines(so_far, titled, "corpus")).unionByName(X.external_lines(outside).withColumn("position", F.col("position").cast("int")))
    return X.assemble(items, BLOCKS).select("query_id", F.md5("context").alias("context_md5"), F.char_length("context").alias("n_chars"))


def threads_upsert(spark: SparkSession, d: str) -> DataFrame:
    t = S.threads(spark, d)
    wanted = t.withColumn("thread_name", F.when(F.col("thread_id") % 3 == 0, F.concat(F.lit("new"), F.col("thread_id").cast("string"))).otherwise(F.concat(F.lit(" "), "thread_name", F.lit(" ")))).unionByName(t)
    return H.get_or_create(t, wanted, S.now()).select("thread_id", *H.KEY)


def thread_list(spark: SparkSession, d: str) -> DataFrame:
    return H.list_threads(S.threads(spark, d), ["user_id", "entity"]).select("thread_id", "user_id", "entity", "rank")


def session_keys(spark: SparkSession, d: str) -> DataFrame:
    t = S.threads(spark, d)
    return t.select("thread_id", H.session_key(F.col("user_id"), F.col("entity"), F.col("stage"), F.col("mode"), F.when(F.col("thread_id") % 5 == 0, "  ").otherwise(F.col("thread_name"))).alias("session_key"))


def append_messages(spark: SparkSession, d: str) -> DataFrame:
    m = S.messages(spark, d)
    threads, all_m = H.append_messages(S.threads(spark, d), m.where("message_id % 1000 < 4"), m.where("message_id % 1000 >= 4"))
    n = all_m.groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"))
    return threads.join(n, "thread_id").select("thread_id", F.unix_seconds("updated_at").alias("updated_at"), "messages")


def recent_buffer(spark: SparkSession, d: str) -> DataFrame:
    # Asked at the last turn of all, so that the sessions of early conversations have expired.
    m = S.messages(spark, d)
    now = m.agg(F.max("created_at")).first()[0]
    return H.recent_buffer(m, F.lit(now), 3).select("session_key", "message_id", "role", F.col("place").cast("long").alias("place"))


def thread_history(spark: SparkSession, d: str) -> DataFrame:
    t = S.threads(spark, d)
    asked = t.select(F.when(F.col("thread_id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"), "thread_id")
    return H.thread_history(S.messages(spark, d), t, asked, 4).select("thread_id", "message_id", "role", F.col("place").cast("long").alias("place"))


def history_clean(spark: SparkSession, d: str) -> DataFrame:
    m = S.messages(spark, d)
    last = top(m, ["thread_id"], [F.desc("message_id")], 1)
    return X.history(m, last.select("thread_id", F.col("content").alias("message"))).select("thread_id", "message_id", "role")


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    t = S.threads(spark, d)
    asked = t.select(F.when(F.col("thread_id") % 4 == 0, F.col("user_id")).otherwise(F.lit(3)).cast("long").alias("user_id"), "thread_id").unionByName(t.select("user_id", (-F.col("thread_id")).alias("thread_id")))
    left, tables, _ = H.delete_threads(asked, t, messages=S.messages(spark, d))
    return left.join(tables["messages"].groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages")), "thread_id", "left").select("thread_id", "user_id", F.coalesce("messages", F.lit(0)).alias("messages"))


def archive_export(spark: SparkSession, d: str) -> DataFrame:
    t = S.threads(spark, d)
    p = t.where("thread_id % 2 = 0").select("entity", "stage").distinct().withColumn("skill_id", F.concat("entity", F.lit("/"), "stage"))
    checks = t.where("thread_id % 3 = 0").select("thread_id", F.lit("ok").alias("status"))
    return H.archive(t, S.messages(spark, d), p, checks).select("session_id", "entity", "stage", F.unix_seconds("created_at").alias("created_at"), "message_count", "profile_id", "check_status")


def turn_memories(spark: SparkSession, d: str) -> DataFrame:
    return M.turn_memories(read(spark, d, "conversations"), speaker="X").select("conv_id", "turn", "summary", F.md5("content").alias("content_md5"), "importance")


def memory_ids(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d)
    return m.select("id", M.memory_id(F.col("created_at"), F.col("id")).alias("memory_id"))


def memory_list(spark: SparkSession, d: str) -> DataFrame:
    return M.strongest(S.memories(spark, d), 0.15, 3).select("id", "user_id", "entity", _6("importance"), "rank")


def memory_boost(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d)
    recalls = m.where("id % 3 = 0").select("memory_id").unionByName(m.where("id % 6 = 0").select("memory_id"))
    return M.boost(m, recalls, S.now()).select("id", _6("importance"), F.coalesce(F.unix_seconds("last_used_at"), F.lit(0)).alias("last_used_at"))


def memory_touch(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d)
    ids = m.where("id % 7 = 0").select("memory_id")
    return M.by_ids(M.touch(m, ids, S.now()), ids.unionByName(m.where("id % 11 = 0").select("memory_id"))).select("id", F.coalesce(F.unix_seconds("last_used_at"), F.lit(0)).alias("last_used_at"))


def memory_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d)
    new = m.where("id % 4 = 0").withColumns({"importance": F.col("importance") * 3, "content": F.lit("new"), "memory_id": F.when(F.col("id") % 8 == 0, F.col("memory_id")).otherwise(F.concat(F.lit("new_"), "memory_id")), "original_importance": F.lit(None).cast("double")})
    return M.upsert(m, new, S.now()).select("memory_id", "content", _6("importance"), _6("original_importance"), F.unix_seconds("updated_at").alias("updated_at"))


def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    got = M.recall(S.recall_queries(spark, d), S.with_vectors(spark, d, S.memories(spark, d)), S.now())
    return got.select("query_id", "memory_id", _6("score"), _6("importance"), "text", "rank")


def memory_recall_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The index lacks most users' memories, so their queries fall back on the table."""
    m = S.memories(spark, d)
    got = M.recall(S.recall_queries(spark, d), S.with_vectors(spark, d, m.where("user_id % 10 = 0")), S.now(), rows=m)
    return got.select("query_id", "memory_id", _6("score"), "rank")


def memory_summary(spark: SparkSession, d: str) -> DataFrame:
    got = kept(M.recall(S.recall_queries(spark, d), S.with_vectors(spark, d, S.memories(spark, d)), S.now(), 20))
    lines = M.result_lines(got).where("rank = 1").select("query_id", "line")
    return M.summaries(got).join(M.stats(got), "query_id").join(lines, "query_id")


def memory_forget(spark: SparkSession, d: str) -> DataFrame:
    return M.forget(S.memories(spark, d), S.now(), 10, 0.4).select("id", _6("retention"), "forgotten")


def memory_delete(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d).withColumn("thread_id", F.col("id") % 50)
    asked = m.select("user_id", "thread_id").where("thread_id % 7 = 0").distinct()
    return M.delete_for_threads(m, asked)[0].select("id", "thread_id")


def memory_index(spark: SparkSession, d: str) -> DataFrame:
    m = S.memories(spark, d)
    old = m.where("id % 2 = 0").select("memory_id", F.lit("old").alias("text"), "importance")
    done = M.sync_index(old, m.where("id % 3 = 0"))
    return done.select("memory_id", F.md5("text").alias("text_md5"), M.original_text(F.col("text")).alias("original"), _6("importance"))


def embedding_export(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return corpus.embedding_lines(rows).select("line_index", "chunk_id", F.md5("line").alias("line_md5"))


def embedding_import(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all four reply shapes, joined to their chunks by line."""
    e = read(spark, d, "embeddings")
    v = F.to_json(F.transform("embedding", lambda x: x.cast("double")))
    raw = F.when(F.col("vec_id") % 4 == 0, F.concat(F.lit('{"embedding": '), v, F.lit("}"))).when(F.col("vec_id") % 4 == 1, F.concat(F.lit('{"output": {"embedding": '), v, F.lit("}}"))).when(F.col("vec_id") % 4 == 2, F.concat(F.lit('{"embeddings": [{"embedding": '), v, F.lit("}]}"))).otherwise(F.concat(F.lit('{"embeddings": ['), v, F.lit("]}")))
    good, _ = corpus.read_vectors(e.select(F.col("vec_id").alias("line_index"), raw.alias("raw")))
    lines = e.select(F.col("vec_id").alias("line_index"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("chunk_id"))
    joined = corpus.attach_vectors(lines, good)
    return joined.select("chunk_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from a deterministic function: shares of four letters in the text, shown in ten-thousandths."""

    def letters(texts: list[str]) -> list[list[float]]:
        return [[t.count(c) / max(1, len(t)) for c in "aeio"] for t in texts]

    got = embed(read(spark, d, "documents").select("doc_id", "text"), letters)
    return got.select("doc_id", *[F.floor(F.col("embedding")[i] * 10000).alias(c) for i, c in enumerate("aeio")])


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    changes = e.where("chunk_id % 3 = 0").select(F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id")).otherwise(F.col("chunk_id") + 1_000_000).alias("chunk_id"), (F.col("label") + 100).alias("label"))
    return index.remove(index.upsert(e, changes), e.where("chunk_id % 10 = 1"))


FUNCTIONS: list[Callable[[SparkSession, str], DataFrame]] = [
    tokenize_counts, dense_topk, visible_topk, scoped_topk, bm25_pool, bm25_corpus, minmax_routes, fuse_routes, hybrid_retrieve, hybrid_profiles, rerank_topn, stage_audit,
    sections, chunk_fixed, chunk_recursive, chunk_ids, corpus_chunks, stage_infer, entity_mentions, skip_markers, chunk_report,
    profile_sections, profile_text, profile_metadata, enrich_profiles, inventory_check, profile_lookup, relation_lookup,
    build_query, routing_digests, route_parse, route_defaults, mode_names, turn_validation, entity_slugs, assemble_context,
    threads_upsert, thread_list, session_keys, append_messages, recent_buffer, thread_history, history_clean, cascade_delete, archive_export,
    turn_memories, memory_ids, memory_list, memory_boost, memory_touch, memory_upsert, memory_recall, memory_recall_fallback, memory_summary, memory_forget, memory_delete, memory_index,
    embedding_export, embedding_import, embed_documents, index_upsert,
]

QUERIES = {f.__name__: f for f in FUNCTIONS}
