from hashlib import md5

import pytest
from pyspark.sql import functions as F

from timeloom import queries as Q
from timeloom import standins as S
from timeloom.operators import chunks as C
from timeloom.operators import memory as M


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of driver tables, each from rows and a schema."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, source string"
VECTORS = "vec_id long, embedding array<float>, label int"


def test_all_documents_have_a_vector_and_count(spark, tables):
    docs = [(0, "red fox", "a"), (1, "red hen", "a"), (2, "red red dog with a long text", "b"), (3, "blue", "b")]
    d = tables(documents=(docs, DOCS), embeddings=([(0, [0.0, 1.0], 0), (1, [1.0, 0.0], 0)], VECTORS), benchmark=([(0, "red")], "item_id long, text string"), nation=([(1,)], "n_nationkey long"))
    assert sorted(r.doc_id for r in S.chunks(spark, d).collect()) == [0, 1, 2, 3]
    assert {r.chunk_id for r in Q.dense_topk(spark, d).collect()} == {f"doc_00000{i}" for i in range(4)}
    # ln(1 + 1.5 / 3.5), times 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 3)): 4 documents, 3 with the term, 3 words on average.
    assert {r.chunk_id: r.score for r in Q.bm25_corpus(spark, d).collect()} == {"doc_000000": pytest.approx(0.419609, abs=1e-5), "doc_000001": pytest.approx(0.419609, abs=1e-5), "doc_000002": pytest.approx(0.356675, abs=1e-5)}


def test_ids_of_seven_digits_stay_whole(spark, tables):
    ids = (7, 123456, 1234567)
    vectors = [(k, [float(k), 1.0], 0) for k in range(4)]
    d = tables(documents=([(i, "text", "a") for i in ids], DOCS), embeddings=(vectors, VECTORS), benchmark=([(0, "text")], "item_id long, text string"))
    assert sorted(r.chunk_id for r in S.chunks(spark, d).collect()) == ["doc_000007", "doc_123456", "doc_1234567"]
    assert {r.chunk_id: r.rerank_score for r in Q.rerank_topn(spark, d).collect()} == {"doc_000007": 0.119, "doc_123456": 0.752, "doc_1234567": 0.639}


def test_more_than_a_million_chunks_have_ids_of_their_own(spark):
    rows = spark.range(1_000_020).selectExpr("id div 1000 as doc_id", "id % 1000 as piece", "'T1' as stage")
    ids = C.number_chunks(rows, ["doc_id", "piece"]).agg(F.countDistinct("chunk_id"), F.max(F.length("chunk_id"))).first()
    assert tuple(ids) == (1_000_020, len("novel_T1_1000019"))


EVENTS = "event_id long, ts string, user_id long, event_type string, value double, props string"


def test_every_twentieth_event_asks_over_all_vectors(spark, tables):
    events = [(i, "2024-01-30 00:00:00", 1, "view", 50.0, '{"k": 1}') for i in range(1300)]
    # 600 vectors, of which one is missing at its place.
    vectors = [(i, [float(i)], 0) for i in range(601) if i != 7]
    d = tables(events=(events, EVENTS), embeddings=(vectors, VECTORS))
    asked = S.recall_queries(spark, d).collect()
    assert sorted(r.query_id for r in asked) == list(range(1, 1300, 20))
    got = {r.id: r.embedding for r in S.with_vectors(spark, d, S.memories(spark, d)).collect()}
    assert len(got) == 1300 and got[7] is None and got[599] == [599.0] and got[600] == [0.0]
    assert Q.memory_recall(spark, d).select("query_id").distinct().count() == 65


def test_summaries_of_many_scopes_make_no_table_of_scopes(spark, tables, monkeypatch):
    """Scopes grow with the events, so no row a scope, let alone copies of them, may be sent to all tasks."""
    events = [(i, "2024-01-30 00:00:00", i // 40, "view", 50.0, '{"k": 1}') for i in range(2000)]
    d = tables(events=(events, EVENTS), embeddings=([(i, [float(i)], 0) for i in range(50)], VECTORS))
    plans, write = [], M.kept
    monkeypatch.setattr(M, "kept", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or write(rows))
    got = Q.memory_summary(spark, d).collect()
    assert len(plans) == 1 and "FlatMapCoGroupsInArrow" in plans[0] and "Generate" not in plans[0]
    assert sorted(r.query_id for r in got) == list(range(1, 2000, 20)) and {r.memories for r in got} == {20}


def test_contexts_hold_whole_texts_and_pages(spark, tables):
    text, html = "long text " * 30 + "end", "<p>" + "page " * 20 + "</p>"
    d = tables(documents=([(0, text, "src0")], DOCS), embeddings=([(0, [1.0], 0)], VECTORS), benchmark=([(0, "q")], "item_id long, text string"), pages=([(50, "u", html)], "page_id long, url string, html string"))
    corpus = f"[doc_000000] 阶段=T0 章节=src0\n{text}"
    outside = f"[web_search:u] 标题=page 50\nURL=u\n{html}"
    bodies = {"memory": "无", "relations": "无", "profile": f"[doc_000000] {text}", "corpus": corpus, "external": outside}
    context = "\n\n".join(f"[{b}]\n{bodies[b]}" for b in bodies)
    assert [(r.context_md5, r.n_chars) for r in Q.assemble_context(spark, d).collect()] == [(md5(context.encode()).hexdigest(), len(context))]


def test_profiles_know_all_customers(spark, tables):
    customers = [(i, f"C{i:02}", 0, "seg") for i in range(25)]
    d = tables(nation=([(0, "N", 1)], "n_nationkey long, n_name string, n_regionkey int"), customer=(customers[::-1], "c_custkey long, c_name string, c_nationkey long, c_mktsegment string"))
    line = "已知事件：" + "；".join(c[1] for c in customers)
    assert line in Q.profile_text(spark, d).first().text.split("\n")
    assert line in Q.profile_sections(spark, d).where("chunk_kind = 'knowledge_boundary'").first().text.split("\n")
