"""Registered queries that go through files and streams, or through several plans, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from . import standins as S
from .functions.dictionary import find_names
from .functions.tables import kept, new_path, read
from .functions.text import piped
from .operators import chunks as C
from .operators import memory as M
from .operators import profiles as P
from .operators import threads as H
from .operators.vectors import nearest
from .plans import context as X
from .plans import retrieval as V
from .queries import GOAL, HEADINGS
from .sources import corpus, index
from .sources.store import Store
from .streaming import turns as T

#: Documents in one text file.
PER_FILE = 50


def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents are written as text files, some to a file, and read back, a row a file."""
    path = new_path(spark, "texts")
    docs = read(spark, d, "documents").select(F.floor(F.col("doc_id") / PER_FILE).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    got = corpus.read_texts(spark, path, work="w", source_type="text")
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return got.select(part.alias("part"), "work", "source_type", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def section_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents are written as text files, some to a file, read line by line, and cut into sections by splits of the files."""
    path = new_path(spark, "books")
    docs = read(spark, d, "documents").select(F.floor(F.col("doc_id") / PER_FILE).alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    file = F.regexp_extract("doc_id", r"part=(\d+)", 1).cast("long")
    bodies = C.section_bodies(corpus.read_lines(spark, path).withColumn("doc_id", file), HEADINGS, segment=F.col("line_no.block"))
    return C.number_sections(bodies.withColumns({"n_chars": F.char_length("body"), "body_md5": F.md5("body")}).drop("body")).withColumnRenamed("doc_id", "file")


#: Names that one dictionary may have; its automaton is built in every task.
MOST_NAMES = 100_000


def entity_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """All long words of the benchmark, found in all documents by one pass over each."""
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{6,}"), F.lit(0))).alias("w")).distinct()
    names = [r.w for r in words.orderBy("w").limit(MOST_NAMES + 1).collect()]
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names: cut the dictionary into several")
    found = read(spark, d, "documents").select("doc_id", find_names(F.col("text"), names).alias("names"))
    return found.select("doc_id", F.md5(piped(F.col("names"))).alias("names_md5"), F.size("names").alias("n"))


def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    """Chunks are written as JSON lines by collection and read back."""
    path = new_path(spark, "chunks")
    rows = S.chunks(spark, d).select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), "entity", "stage_order", "stage")
    corpus.write_chunks(rows, path, ["entity", "stage_order"], "stage")
    good, _ = corpus.read_chunks(spark, path)
    return good.select("chunk_id", F.md5("text").alias("text_md5"), F.col("metadata.entity").alias("entity"), F.col("metadata.stage_order").cast("int").alias("stage_order"))


def chunk_file_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = S.chunks(spark, d).select("chunk_id", "text", "entity", "stage")
    return corpus.write_chunks(rows, new_path(spark, "chunks"), ["entity"], "stage")


def profile_files(spark: SparkSession, d: str) -> DataFrame:
    """Profiles are written as JSON lines, read back, and shown as text; the last row of a stage counts."""
    path = new_path(spark, "profiles")
    corpus.write_profiles(S.profiles(spark, d).drop("file"), path)
    good, _ = corpus.read_profiles(spark, path, "*.json")
    asked = read(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("character"), F.concat(F.lit("T"), F.col("n_regionkey").cast("string")).alias("stage_id"))
    found, _ = P.profile_for(asked, good, "character", "stage_id")
    return P.profile_text(found).select("skill_id", F.md5("text").alias("text_md5"))


def collection_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A collection is built, and built anew from fewer chunks: nothing of the first stays."""
    path, rows = new_path(spark, "collection"), S.chunks(spark, d).select("chunk_id", "text", "embedding", "stage_order")
    index.rebuild(rows, path)
    return index.rebuild(rows.where("stage_order <> 3"), path)


def collection_upserts(spark: SparkSession, d: str) -> DataFrame:
    """A stored collection is changed in place: an upsert, the same again, which makes no version, and a removal; what is there then."""
    rows = S.chunks(spark, d).select("chunk_id", "doc_id", F.md5("text").alias("text_md5"), "stage_order")
    held = Store(spark, new_path(spark, "collection"), ["chunk_id"], 16)
    held.replace(rows)
    some = rows.where("doc_id % 5 = 3").withColumn("stage_order", F.lit(9))
    changed = some.where("doc_id % 2 = 0").unionByName(some.where("doc_id % 2 = 1").withColumn("chunk_id", F.concat("chunk_id", F.lit("_new"))))
    for _ in range(2):
        held.upsert(changed)
    held.remove(rows.where("doc_id % 20 = 8").select("chunk_id"))
    return held.read().select("chunk_id", "text_md5", "stage_order", F.lit(held.manifest()["version"]).cast("long").alias("versions"))


def hybrid_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks mention their source; of equally good ones those come first that mention whom the question is about."""
    c = S.chunks(spark, d).withColumn("mentions", F.array("entity"))
    return _ranked(V.hybrid(S.questions(spark, d), c, V.corpus_settings()))


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The fused candidates of each question, reranked by given relevances."""
    q, c, s = S.questions(spark, d), S.chunks(spark, d), V.corpus_settings()
    near = nearest(q, c, s.dense_k, s.visible).select("query_id", "chunk_id").join(c.select("chunk_id", "doc_id"), "chunk_id")
    relevance = near.select("query_id", "chunk_id", (((F.col("query_id") * 31 + F.col("doc_id") * 17) % 1000) / 1000.0).alias("relevance"))
    return _ranked(V.hybrid(q, c, s, relevance))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "chunk_id", F.round("fused_score", 6).alias("fused_score"), F.round("rerank_score", 6).alias("rerank_score"), "rank")


def prepared_requests(spark: SparkSession, d: str) -> DataFrame:
    """Questions end to end: their profile, the text to retrieve by, and both retrievals."""
    c = S.chunks(spark, d)
    profiles = c.where("stage is not null").select("entity", "stage").distinct().select("entity", "stage", F.concat(F.lit("stage "), "stage").alias("stage_name"), F.array("entity", F.lit("event")).alias("known_events"))
    built, scoped, so_far = X.prepare(S.questions(spark, d).withColumnRenamed("text", "query"), profiles, c, c, GOAL)
    both = scoped.withColumn("block", F.lit("profile")).unionByName(so_far.withColumn("block", F.lit("corpus")))
    return both.join(built.select("query_id", F.md5("search_text").alias("search_md5")), "query_id").select("query_id", "block", "search_md5", "chunk_id", F.round("fused_score", 6).alias("fused_score"), "rank")


def memory_search(spark: SparkSession, d: str) -> DataFrame:
    """Recall by callers that name memory types: every other asks for one that there is none of."""
    q, m = S.recall_queries(spark, d), S.with_vectors(spark, d, S.memories(spark, d))
    some = M.ACTIONS["search"](q.where("query_id % 40 = 1"), m, S.now(), ["semantic", "episodic"])
    none = M.ACTIONS["search"](q.where("query_id % 40 <> 1"), m, S.now(), ["semantic"])
    return some.unionByName(none).select("query_id", "memory_id", F.round("score", 6).alias("score"), "rank")


#: Batches of the streams.
BATCHES = 6


def _batches(rows: DataFrame, batch: Column, n: int) -> DataFrame:
    """``rows`` as a stream of ``n`` micro-batches: a file each, written in order of the number ``batch``."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "arriving")
    numbered = kept(rows.withColumn("__batch", batch))
    for b in range(n):
        numbered.where(F.col("__batch") == b).drop("__batch").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(rows: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    spark, path = rows.sparkSession, new_path(rows.sparkSession, "stream")
    # State lives in RocksDB, which timers need.
    key, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        writer = rows.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True)
        writer.start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def stream_appends(spark: SparkSession, d: str) -> DataFrame:
    """Messages come in six batches, every fifth twice and some of these days later; they count once in the threads' tables."""
    m = S.messages(spark, d).withColumn("received_at", F.col("created_at"))
    again = m.where("message_id % 5 = 0").withColumn("received_at", F.col("created_at") + F.expr("make_interval(0, 0, 0, if(message_id % 2 = 0, 3, 0), 0, 10)"))
    m = m.unionByName(again)
    first, last = m.agg(F.min("received_at").cast("long"), F.max("received_at").cast("long")).first()
    stream = _batches(m, F.floor((F.col("received_at").cast("long") - F.lit(first)) * BATCHES / F.lit((last or 0) - (first or 0) + 1)).cast("int"), BATCHES)
    kept_in = T.Conversations(spark, new_path(spark, "conversations"), 16)
    _run(T.received_once(stream), kept_in.append)
    n = kept_in.messages.read().groupBy("thread_id").agg(F.count(F.lit(1)).alias("messages"))
    return kept_in.threads.read().join(n, "thread_id").select("thread_id", F.unix_seconds("updated_at").alias("updated_at"), "messages")


def stream_memories(spark: SparkSession, d: str) -> DataFrame:
    """Memories come in six batches, each of which makes its scopes forget what is over their capacity: what is left."""
    path, rows = new_path(spark, "memories"), S.memories(spark, d)
    _run(_batches(rows, (F.col("id") % BATCHES).cast("int"), BATCHES), T.after_turns(spark, path, S.now(), 10, 0.4, 16))
    return T.memories_after(spark, path).select("id", F.round("importance", 6).alias("importance"))


#: Turns come a batch each, some two batches later; there are eight turns at most.
TURN_BATCHES = 10


def stream_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Sessions' recent messages after ten batches: late messages are not held, and sessions whose timer has fired hold none."""
    path = new_path(spark, "buffers")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    turn = F.col("message_id") % 1000
    arrives = (turn + F.when((F.col("thread_id") % 7 == 3) & (turn % 3 == 1), 2).otherwise(0)).cast("int")
    _run(T.recent_buffers(_batches(S.messages(spark, d), arrives, TURN_BATCHES), cap=3, late="1 hour"), write, "update")
    return T.last_buffers(spark.read.parquet(path)).select("session_key", "message_id", "role", F.col("place").cast("long").alias("place"))


FUNCTIONS: list[Callable[[SparkSession, str], DataFrame]] = [text_files, section_files, entity_dictionary, chunk_files, chunk_file_counts, profile_files, collection_rebuild, collection_upserts, hybrid_mentions, hybrid_rerank, prepared_requests, memory_search, stream_appends, stream_memories, stream_buffers]

QUERIES = {f.__name__: f for f in FUNCTIONS}

_RANKED = "select query_id, chunk_id, round(fused, 6) fused_score, 0.0::double rerank_score, cast(row_number() over (partition by query_id order by fused desc, (entity = q_entity) desc, chunk_id) as integer) rank from named qualify rank <= 5"


def _fused(condition: str, pool_k: int, dense: float, sparse: float, questions: str = O.QUESTIONS) -> str:
    """The common table expressions of hybrid retrieval, up to ``fused``."""
    whole = O._hybrid(condition, pool_k, dense, sparse).replace(O.QUESTIONS, questions)
    return whole[: whole.rindex("select query_id, chunk_id, round(coalesce(dense")].rstrip()


_ABOUT = """'角色：' || 'src' || (item_id % 20) || chr(10) || '时间线阶段：T' || (item_id % 7) || chr(10) || '阶段名称：stage T' || (item_id % 7) || chr(10) || '当前阶段已知事件：src' || (item_id % 20) || '；event' || chr(10) || '用户问题：' || text || chr(10) || 'goal' as text"""
_ASKED = O.QUESTIONS.replace("item_id query_id, text,", f"item_id query_id, {_ABOUT},")[:-1] + " where exists (select 1 from chunks where chunks.entity = 'src' || (item_id % 20) and chunks.stage = 'T' || (item_id % 7)))"
_TOP = "select query_id, '{}' block, md5(q.text) search_md5, chunk_id, round(fused, 6) fused_score, cast(row_number() over (partition by query_id order by fused desc, chunk_id) as integer) rank from fused join questions q using (query_id) qualify rank <= 5"

SQL: dict[str, str] = {
    "text_files": f"select doc_id // {PER_FILE} part, 'w' work, 'text' source_type, cast(length(string_agg(coalesce(text, '') || chr(10), '')) as integer) n_chars, md5(string_agg(coalesce(text, '') || chr(10), '' order by doc_id)) text_md5 from documents group by 1",
    "section_files": f"""with files as (select doc_id // {PER_FILE} doc_id, string_agg(coalesce(text, '') || chr(10), '' order by doc_id) as text from documents group by 1), {O._SECTIONS.replace("from documents", "from files")}
        select doc_id file, cast(row_number() over (partition by doc_id order by section) as integer) section_index, book, part, coalesce(title, 'front_matter') section_title,
        cast(length(body) as integer) n_chars, md5(body) body_md5 from whole where body <> '' and (title is null or length(body) >= 500)""",
    "entity_dictionary": """with w as (select distinct unnest(regexp_extract_all(text, '[a-z]{6,}')) w from benchmark),
        f as (select doc_id, string_agg(w, '|' order by w) names, count(*) n from documents join w on contains(text, w) group by 1)
        select doc_id, md5(coalesce('|' || names || '|', '')) names_md5, cast(coalesce(n, 0) as integer) n from documents left join f using (doc_id)""",
    "chunk_files": f"with {O.CHUNKS} select chunk_id, md5(coalesce(text, '')) text_md5, entity, stage_order from chunks",
    "chunk_file_counts": f"with {O.CHUNKS} select stage collection, count(*) chunks from chunks group by 1",
    "profile_files": "select skill_id, md5(text) text_md5 from (" + O.SQL["profile_text"] + ")",
    "collection_rebuild": f"with {O.CHUNKS} select stage_order, count(*) chunks from chunks where stage_order <> 3 group by 1",
    "collection_upserts": f"""with {O.CHUNKS}, c as (select chunk_id, doc_id, md5(text) text_md5, stage_order from chunks)
        select chunk_id, text_md5, case when doc_id % 10 = 8 then 9 else stage_order end stage_order, 3::bigint versions from c where doc_id % 20 <> 8
        union all select chunk_id || '_new', text_md5, 9, 3 from c where doc_id % 10 = 3""",
    "hybrid_mentions": _fused(O._SO_FAR, 20, 0.65, 0.35) + f", named as (select f.*, c.entity, q.entity q_entity from fused f join chunks c using (chunk_id) join questions q using (query_id)) {_RANKED}",
    "hybrid_rerank": _fused(O._SO_FAR, 20, 0.65, 0.35) + """, best as (select *, row_number() over (partition by query_id order by fused desc, chunk_id) r from fused qualify r <= 30),
        rel as (select b.*, ((query_id * 31 + cast(substr(chunk_id, 5) as bigint) * 17) % 1000) / 1000.0::double rel from best b)
        select query_id, chunk_id, round(fused, 6) fused_score, round(rel, 6) rerank_score, cast(row_number() over (partition by query_id order by rel desc, chunk_id) as integer) rank from rel qualify rank <= 5""",
    "prepared_requests": "select * from (" + _fused(O._SCOPE, 40, 0.7, 0.3, _ASKED) + " " + _TOP.format("profile") + ") union all select * from (" + _fused(O._SO_FAR, 20, 0.65, 0.35, _ASKED) + " " + _TOP.format("corpus") + ")",
    "memory_search": "select query_id, memory_id, score, rank from (" + O.SQL["memory_recall"] + ") where query_id % 40 = 1",
    "stream_appends": f"with {O.MESSAGES} select thread_id, max(at_s) updated_at, count(*) messages from messages group by 1",
    "stream_memories": "select id, round(importance, 6) importance from (" + O.SQL["memory_forget"] + ") join (select event_id id, round(least(1.0, value / 100), 4) importance from events) using (id) where not forgotten",
    "stream_buffers": f"""with {O.MESSAGES}, b as (select *, message_id % 1000 + case when thread_id % 7 = 3 and message_id % 1000 % 3 = 1 then 2 else 0 end batch from messages),
        mark as (select n.batch, (select max(at_s) from b where b.batch <= n.batch - 2) - 3600 late from (select distinct batch from b) n),
        held as (select b.* from b join mark using (batch) where late is null or at_s > late), g as (select *, sum(case when at_s - prev >= 43200 then 1 else 0 end) over (partition by session_key order by at_s, message_id) run from (select *, lag(at_s) over (partition by session_key order by at_s, message_id) prev from held)),
        l as (select *, row_number() over (partition by session_key order by at_s desc, message_id desc) back, first_value(run) over (partition by session_key order by at_s desc, message_id desc) last_run, max(at_s) over (partition by session_key) last_at from g)
        select session_key, message_id, role, row_number() over (partition by session_key order by at_s, message_id) - 1 place from l where back <= 3 and run = last_run and last_at + 43200 > (select max(at_s) from messages) - 3600""",
}
