import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timeloom.operators import ranking as R
from timeloom.operators.vectors import embed, nearest
from timeloom.plans import retrieval as V

Q = "query_id long, text string, entity string, stage string, stage_order int, embedding array<double>"
C = "chunk_id string, text string, entity string, stage string, stage_order int, embedding array<double>"


@pytest.fixture
def tables(spark):
    q = spark.createDataFrame([(1, "red fox fox", "a", "T1", 1, [0.0, 0.0]), (2, "", "b", "T0", 0, [1.0, 1.0]), (3, "no vector", "a", "T1", 1, None)], Q)
    rows = [(f"c{i}", t, e, f"T{s}", s, [float(i), 0.0]) for i, (t, e, s) in enumerate([("red fox", "a", 1), ("fox", "a", 1), ("", "a", 0), ("blue", "b", 2), ("red red red", "b", 0)])]
    return q, spark.createDataFrame(rows, C)


def test_nearest_under_each_filter_and_in_blocks(tables):
    q, c = tables
    for size in (1 << 20, 1):
        got = lambda v: [(r.query_id, r.chunk_id, r.dense_rank) for r in nearest(q, c, 2, v, size).orderBy("query_id", "dense_rank").collect()]  # noqa: E731, B023
        assert got("all") == [(1, "c0", 1), (1, "c1", 2), (2, "c1", 1), (2, "c0", 2)]
        assert got("so_far") == [(1, "c0", 1), (1, "c1", 2), (2, "c2", 1), (2, "c4", 2)]
        assert got("scope") == [(1, "c0", 1), (1, "c1", 2), (2, "c4", 1)]


def test_bm25_by_hand(tables):
    q, c = tables
    pool = c.select(F.lit(1).cast("long").alias("query_id"), "chunk_id", "text")
    docs = {r.chunk_id: r.text.split() for r in c.collect()}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for k, d in docs.items():
        s = 0.0
        for term in ["red", "fox", "fox"]:
            tf, df = Counter(d)[term], sum(term in x for x in docs.values())
            s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        if s:
            want[k] = s
    for corpus in (None, c):
        got = {r.chunk_id: r.score for r in R.bm25(q, pool, corpus=corpus).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.bm25(q.where("query_id = 2"), pool).count() == 0


def test_min_max_and_fusion(spark):
    s = spark.createDataFrame([(1, "a", "x", 2.0), (1, "b", "x", 4.0), (1, "c", "x", -2.0), (1, "a", "y", 7.0), (2, "a", "x", 1.0), (2, "b", "x", 1.0)], "query_id int, chunk_id string, route string, score double")
    n = R.min_max(s, ["query_id", "route"])
    assert {(r.query_id, r.chunk_id, r.route): round(r.norm, 4) for r in n.collect()} == {(1, "a", "x"): 0.6667, (1, "b", "x"): 1.0, (1, "c", "x"): 0.0, (1, "a", "y"): 0.5, (2, "a", "x"): 0.5, (2, "b", "x"): 0.5}
    f = {(r.query_id, r.chunk_id): round(r.fused_score, 4) for r in R.fuse(n, {"x": 0.6, "y": 0.4}).collect()}
    assert f == {(1, "a"): 0.6, (1, "b"): 0.6, (1, "c"): 0.0, (2, "a"): 0.3, (2, "b"): 0.3}
    with pytest.raises(ValueError):
        R.fuse_lists([n], [0.5, 0.5])


def test_rerank_and_replies(spark):
    c = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query_id int, chunk_id string")
    rel = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9), (1, "zz", 1.0)], "query_id int, chunk_id string, relevance double")
    assert [(r.chunk_id, r.rerank_rank) for r in R.rerank(c, rel, 5).orderBy("rerank_rank").collect()] == [("b", 1), ("a", 2)]
    raw = ['{"results": [{"index": 2, "relevance_score": 0.5}]}', '{"output": {"results": [{"index": 0, "relevance_score": 0.25}]}}']
    got = R.relevance_of(spark.createDataFrame(list(enumerate(raw)), "query_id int, raw string"))
    assert [tuple(r) for r in got.orderBy("query_id").collect()] == [(0, 2, 0.5), (1, 0, 0.25)]
    pairs = c.withColumn("query_text", F.lit("q")).withColumn("text", F.col("chunk_id"))
    assert {r.chunk_id: r.relevance for r in R.score_pairs(pairs, lambda f: f["text"].map(ord)).collect()} == {"a": 97.0, "b": 98.0, "c": 99.0}


def test_hybrid_orders_named_chunks_first_and_passes_the_audit(tables):
    q, c = tables
    c = c.withColumn("mentions", F.array("entity"))
    out = V.hybrid(q, c, V.corpus_settings(2))
    rows = out.where("query_id = 1").orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["c0", "c1"] and rows[0].bm25_score > 0 and rows[0].rerank_score == 0
    assert V.beyond_stage(out, q, c).count() == 0
    rel = out.select("query_id", "chunk_id", F.when(F.col("chunk_id") == "c1", 0.9).otherwise(0.2).alias("relevance"))
    assert [r.chunk_id for r in V.hybrid(q, c, V.corpus_settings(2), rel).where("query_id = 1").orderBy("rank").collect()] == ["c1", "c0"]
    assert (V.corpus_settings().dense_k, V.corpus_settings().pool_k, V.profile_settings().pool_k) == (30, 20, 40)


def test_embedding_in_batches(spark):
    seen = embed(spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, text string"), lambda texts: [[len(t), len(texts)] for t in texts], batch=3)
    assert all(r.embedding[0] == r.id and r.embedding[1] <= 3 for r in seen.collect())


def test_nearest_like_brute_force_with_ties_and_many_batches(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(300)]
    rows = [(f"c{i:03}", "t", rng.choice(["a", "b", None]), f"T{i % 2}", rng.choice([0, 1, 2, None]), v) for i, v in enumerate(vectors)]
    asks = [(i, "q", rng.choice(["a", "b"]), f"T{i % 2}", i % 3, [rng.uniform(0, 2) if i % 2 else 1.0 for _ in range(3)]) for i in range(40)]
    q, c = spark.createDataFrame(asks, Q), spark.createDataFrame(rows, C).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    for visible, sees in (("all", lambda a, r: True), ("so_far", lambda a, r: r[4] is not None and r[4] <= a[4]), ("scope", lambda a, r: r[2] == a[2] and r[3] == a[3])):
        want = {(a[0], r[0]) for a in asks for r in sorted((r for r in rows if sees(a, r)), key=lambda r: (sum((x - y) ** 2 for x, y in zip(a[5], r[5], strict=True)), r[0]))[:7]}  # noqa: B023
        assert {(r.query_id, r.chunk_id) for r in nearest(q, c, 7, visible).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
