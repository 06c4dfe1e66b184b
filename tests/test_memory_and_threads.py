import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from timeloom.operators import memory as M
from timeloom.operators import threads as H
from timeloom.operators.vectors import nearest_in_groups

AT = dt.datetime(2024, 1, 31)


@pytest.fixture(autouse=True)
def _now(spark):
    global NOW
    NOW = F.lit("2024-01-31 00:00:00").cast("timestamp")


ROW = "id long, memory_id string, user_id long, entity string, stage string, mode string, thread_name string, importance double, original_importance double, summary string, content string, metadata string, created_at timestamp, updated_at timestamp, last_used_at timestamp"


def memories(spark, *rows):
    full = [(i, f"m{i}", r.get("user", 1), "e", "T1", "temporal", "t", r["imp"], r.get("orig"), r.get("summary"), f"c{i}", "{}", AT - dt.timedelta(days=r.get("age", 1)), AT, r.get("used")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ROW)


def test_forgetting_at_over_and_above(spark):
    low = [{"imp": 0.4 - i / 1000} for i in range(41)]
    at, over = memories(spark, *low[:40]), memories(spark, *low)
    assert M.forget(at, NOW).where("forgotten").count() == 0
    assert [r.id for r in M.forget(over, NOW).where("forgotten").collect()] == [40]
    assert M.forget(memories(spark, *[{"imp": 0.41}] * 50), NOW).where("forgotten").count() == 0
    mixed = M.forget(memories(spark, *([{"imp": 0.9}] * 44 + [{"imp": 0.4}] * 2)), NOW)
    assert sorted(r.id for r in mixed.where("forgotten").collect()) == [44, 45] and mixed.count() == 46


def test_retention_keeps_future_times_and_rounds(spark):
    m = memories(spark, {"imp": 0.2, "orig": 0.33335, "used": AT + dt.timedelta(days=7)}, {"imp": 0.2, "age": 30})
    got = [round(r.retention, 6) for r in M.forget(m, NOW).orderBy("id").collect()]
    assert got == [round(0.12 + 0.5 + 0.15 * 0.3334, 6), round(0.12 + 0.03, 6)]


def test_boost_caps_and_lowers(spark):
    m = memories(spark, {"imp": 0.93}, {"imp": 0.97}, {"imp": 0.4}, {"imp": 0.4})
    hits = spark.createDataFrame([("m0",), ("m1",), ("m2",), ("m2",)], "memory_id string")
    assert [round(r.importance, 4) for r in M.boost(m, hits, NOW).orderBy("id").collect()] == [0.95, 0.95, 0.5, 0.4]


def test_recall_uses_rows_falls_back_and_ranks(spark):
    m = memories(spark, {"imp": 0.9}, {"imp": 0.5, "summary": "s"}, {"imp": 0.1}, {"imp": 0.7, "user": 2})
    index = m.where("user_id = 1").withColumn("embedding", F.array(F.col("id").cast("double")))
    q = spark.createDataFrame([(1, 1, "e", "T1", "temporal", "t", [1.0]), (2, 2, "e", "T1", "temporal", "t", [0.0]), (3, 9, "e", "T1", "temporal", "t", [0.0])], "query_id long, user_id long, entity string, stage string, mode string, thread_name string, embedding array<double>")
    got = M.recall(q, index, NOW, rows=m).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.memory_id, r.text) for r in got] == [(1, "m1", "s"), (1, "m0", "c0"), (2, "m3", "c3")]
    recency = 1 - 1 / 7
    assert abs(got[0].score - (0.8 + 0.2 * recency) * (0.8 + 0.2)) < 1e-9 and got[2].score == 0.7
    assert M.search(q, index, NOW, ["semantic"]).count() == 0
    assert M.result_lines(M.recall(q, index, NOW, rows=m)).where("query_id = 2").first().line == "1. [情景记忆] c3 (重要性: 0.70, 相关度: 0.70)"


def test_lines_round_by_the_exact_value(spark):
    found = [(1, 0.945, 0.125), (2, 0.305, 0.375), (3, 0.295, 1.0)]
    rows = spark.createDataFrame([(q, "m", s, i, "t", 1) for q, i, s in found], "query_id long, memory_id string, score double, importance double, text string, rank int")
    got = [r.line for r in M.result_lines(rows).orderBy("query_id").collect()]
    assert got == [f"1. [情景记忆] t (重要性: {i:.2f}, 相关度: {s:.2f})" for _, i, s in found]


def test_recency_edges(spark):
    f = lambda t: spark.range(1).select(M.recency(NOW, F.lit(t).cast("timestamp")).alias("x")).first().x
    assert f(None) == 0.5 and f("2024-02-05") == 1.0 and f("2023-01-01") == 0.0


def test_upsert_keeps_scope_and_clamps(spark):
    m = memories(spark, {"imp": 0.5, "orig": 0.5})
    new = m.withColumns({"importance": F.lit(1.7), "entity": F.lit("other"), "content": F.lit("new"), "original_importance": F.lit(None).cast("double")}).unionByName(m.withColumn("memory_id", F.lit("n")))
    got = {r.memory_id: r for r in M.upsert(m, new, NOW).collect()}
    assert (got["m0"].entity, got["m0"].content, got["m0"].importance, got["m0"].original_importance) == ("e", "new", 1.0, 1.0)
    assert set(got) == {"m0", "n"}


def test_turns_ids_index_text_and_delete(spark):
    c = spark.createDataFrame([(1, 0, "user", "q" * 200), (1, 1, "assistant", "a"), (1, 2, "user", "unanswered"), (2, 0, "assistant", "x")], "conv_id long, turn long, role string, text string")
    got = M.turn_memories(c, speaker="Ann").collect()
    assert len(got) == 1 and got[0].summary == "用户提问：" + "q" * 160 + " | Ann回答：a" and got[0].importance == 0.4
    text = M.index_text(F.lit(" body "), F.lit(""), F.lit("e"), F.lit("T1"), F.lit("t"))
    row = spark.range(1).select(text.alias("t"), M.original_text(text).alias("o"), M.original_text(F.lit("plain")).alias("p")).first()
    assert row.t.split("\n")[4] == "摘要： body " and row.o == "body" and row.p == "plain"
    m = memories(spark, {"imp": 0.1}, {"imp": 0.1, "user": 2}).withColumn("thread_id", F.lit(5))
    left, ids = M.delete_for_threads(m, spark.createDataFrame([(1, 5), (1, 5), (2, -5), (3, 5)], "user_id long, thread_id int"))
    assert [r.memory_id for r in left.collect()] == ["m1"] and [r.memory_id for r in ids.collect()] == ["m0"]


MSG = "session_key string, message_id long, role string, content string, created_at timestamp"


def turns(n, gap=60, key="k", start=AT):
    return [(key, i, "user" if i % 2 == 0 else "assistant", f"msg-{i}", start + dt.timedelta(seconds=gap * i)) for i in range(n)]


def test_buffer_of_21_messages_and_time_to_live(spark):
    late = lambda s: F.lit(str(AT + dt.timedelta(seconds=s))).cast("timestamp")
    got = H.recent_buffer(spark.createDataFrame(turns(21), MSG), late(1300)).orderBy("place").collect()
    assert [len(got), got[0].content, got[-1].content] == [20, "msg-1", "msg-20"]
    two = spark.createDataFrame(turns(2, 43_200) + turns(2, 43_199, "j"), MSG)
    assert sorted((r.session_key, r.message_id) for r in H.recent_buffer(two, late(43_300)).collect()) == [("j", 0), ("j", 1), ("k", 1)]
    assert H.recent_buffer(two, late(43_200 * 3)).count() == 0


def test_buffer_is_what_sorting_whole_sessions_says(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", "c", None]), i, "user", "", AT + dt.timedelta(seconds=rng.choice([0, 50, 120, 300, 1000]) * rng.randrange(4))) for i in range(90)]
    rows += [("d", i, "user", "", AT + dt.timedelta(seconds=i)) for i in range(2000)]
    for cap, ttl, at in ((3, 130, 3100), (20, 300, 2100), (40, 1500, 3000)):
        want = set()
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[4], r[1]))
            run = own[-1:]
            for before in reversed(own[:-1]):
                if (run[0][4] - before[4]).total_seconds() >= ttl:
                    break
                run.insert(0, before)
            if (AT + dt.timedelta(seconds=at) - run[-1][4]).total_seconds() < ttl:
                want |= {(key, r[1], i) for i, r in enumerate(run[-cap:])}
        found = H.recent_buffer(spark.createDataFrame(rows, MSG), F.lit(str(AT + dt.timedelta(seconds=at))).cast("timestamp"), cap, ttl)
        assert {(r.session_key, r.message_id, r.place) for r in found.collect()} == want
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_threads_history_and_cascade(spark):
    t = spark.createDataFrame([(7, 1, "e", "T1", "temporal", "a", AT, AT), (9, 2, "e", "T1", "temporal", "a", AT, AT)], "thread_id long, user_id long, entity string, stage string, mode string, thread_name string, created_at timestamp, updated_at timestamp")
    wanted = spark.createDataFrame([(1, "e", "T1", "temporal", " a "), (1, "e", "T1", "temporal", ""), (1, "e", "T1", "temporal", None), (3, "e", "T1", "temporal", "b")], "user_id long, entity string, stage string, mode string, thread_name string")
    made = {(r.user_id, r.thread_name): r.thread_id for r in H.get_or_create(t, wanted, NOW).collect()}
    assert made == {(1, "a"): 7, (2, "a"): 9, (1, "线程1"): 10, (3, "b"): 11}
    m = spark.createDataFrame([(7, i, "user", f"{i}", AT, '{"a": "b"}' if i else "bad") for i in range(3)] + [(9, 5, "user", "x", AT, None)], "thread_id long, message_id long, role string, content string, created_at timestamp, metadata string")
    asked = spark.createDataFrame([(1, 7), (1, 9)], "user_id long, thread_id long")
    got = H.thread_history(m, t, asked, 2).orderBy("place").collect()
    assert [(r.message_id, r.place, r.metadata) for r in got] == [(1, 1, {"a": "b"}), (2, 2, {"a": "b"})]
    ids = spark.createDataFrame([(1, 7), (1, 7), (1, 0), (1, -9), (1, 9)], "user_id long, thread_id long")
    left, tables, gone = H.delete_threads(ids, t, messages=m)
    assert [r.thread_id for r in left.collect()] == [9] and tables["messages"].count() == 1 and gone.count() == 1
    key = spark.range(1).select(H.session_key(F.lit(1), F.lit("e"), F.lit("T1"), F.lit("m"), F.lit("　")).alias("k")).first().k
    assert key == "chat:1:e:T1:m:线程1"


def test_archive_without_messages(spark):
    t = spark.createDataFrame([(1, "e", "T1")], "thread_id long, entity string, stage string").withColumn("created_at", NOW)
    m = spark.createDataFrame([], "thread_id long, created_at timestamp")
    p = spark.createDataFrame([("e", "T1", "skill")], "entity string, stage string, skill_id string")
    assert tuple(H.archive(t, m, p).first()) == (1, "e", "T1", None, 0, "skill", "unchecked")


@pytest.mark.parametrize("parts", [1, 5])
def test_partition_count_does_not_matter(spark, parts):
    m = memories(spark, *[{"imp": 0.3, "age": i % 9} for i in range(60)]).repartition(parts)
    assert sorted(r.id for r in M.forget(m, NOW).where("forgotten").collect()) == sorted(sorted(range(60), key=lambda i: (-(i % 9) if i % 9 < 7 else -7, -(i % 9), i))[:20])


def test_nearest_in_groups_like_brute_force(spark):
    """Small cells, a hot group, ties, unusable vectors and other lengths: the rows of all pairs."""
    rng = random.Random(3)
    vector = lambda: [float(rng.randrange(4)) for _ in range(3)]
    rows = [(f"m{i}", "hot" if i % 3 else f"g{i % 5}", i % 2, vector()) for i in range(200)]
    rows += [("nan", "hot", 1, [float("nan"), 0.0, 0.0]), ("inf", "hot", 1, [float("inf"), 0.0, 0.0]), ("hole", "hot", 1, [None, 0.0, 0.0]), ("none", "hot", 1, None), ("short", "hot", 1, [1.0]), ("nowhere", None, 1, vector())]
    asked = [(i, rng.choice(["hot", "hot", "g1", "g2", "gone"]), i % 2, vector()) for i in range(60)] + [(90, "hot", 1, None), (91, None, 1, vector()), (92, "hot", 1, [2.0])]
    schema = "{} {}, user_id string, stage int, embedding array<double>"
    q, m = spark.createDataFrame(asked, schema.format("query_id", "long")), spark.createDataFrame(rows, schema.format("memory_id", "string"))
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    want = set()
    for i, g, s, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, h, t, w in rows if g and (g, s) == (h, t) and usable(v) and usable(w) and len(v) == len(w))
        want |= {(i, n, d, r + 1) for r, (d, n) in enumerate(near[:7])}
    for sizes in ((8192, 2048), (9, 4)):
        got = nearest_in_groups(q, m, ["user_id", "stage"], "memory_id", 7, *sizes, salts=3)
        assert {tuple(r) for r in got.collect()} == want and got.columns == ["query_id", "memory_id", "distance", "dense_rank"]
    assert nearest_in_groups(q, m.limit(0), ["user_id", "stage"], "memory_id", 7).count() == 0 == nearest_in_groups(q.limit(0), m, ["user_id", "stage"], "memory_id", 7).count()


def test_groups_are_no_broadcast_but_few_hot_ones(spark):
    """What says where a group's rows go must not grow in the driver with the number of groups."""
    rows = spark.range(4000).selectExpr("id", "id div 4 as user_id", "array(cast(id % 7 as double)) as embedding")
    hot = rows.unionByName(spark.range(4000, 4100).selectExpr("id", "-1 - id % 5 as user_id", "array(cast(id % 7 as double)) as embedding"))
    search = lambda r, **few: nearest_in_groups(r.withColumnRenamed("id", "query_id"), r, ["user_id"], "id", 2, 16, 8, salts=3, **few)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan(search(rows))
    one, many = search(hot), search(hot, few=4)
    assert "Broadcast" in plan(one) and "Broadcast" not in plan(many)
    want = {(q, *t) for g in hot.groupBy("user_id").agg(F.collect_list("id")).collect() for q in g[1] for t in [(i, float((q % 7 - i % 7) ** 2), n + 1) for n, i in enumerate(sorted(g[1], key=lambda i: ((q % 7 - i % 7) ** 2, i))[:2])]}
    assert {tuple(r) for r in one.collect()} == want == {tuple(r) for r in many.collect()}
