import datetime as dt

import pytest
from pyspark.sql import functions as F

from timeloom.operators import memory as M
from timeloom.operators import threads as H
from timeloom.sources import index
from timeloom.sources.store import Store
from timeloom.streaming import turns as T

AT = dt.datetime(2024, 1, 1)
MSG = "session_key string, message_id long, role string, content string, created_at timestamp"


def test_stream_of_turns_ends_like_the_batch(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rows = [(f"k{k}", i, "user", f"m{i}", AT + dt.timedelta(minutes=i * (k + 1) * 60)) for k in range(3) for i in range(14)]
    for part in range(2):
        spark.createDataFrame([r for r in rows if r[1] // 7 == part], MSG).coalesce(1).write.mode("append").json(f"{tmp_path}/in{part}")
    stream = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in*")
    last = {}

    def take(batch, epoch):
        for r in batch.collect():
            last.setdefault(r.session_key, {}).setdefault(epoch, []).append((r.place, r.message_id))

    query = T.recent_buffers(stream, cap=5, ttl=7200, late="30 days").writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    now = F.lit(str(AT)).cast("timestamp")
    want = {}
    for r in H.recent_buffer(spark.createDataFrame(rows, MSG), now, 5, 7200).collect():
        want.setdefault(r.session_key, []).append((r.place, r.message_id))
    got = {k: sorted(v[max(v)]) for k, v in last.items()}
    assert got == {k: sorted(v) for k, v in want.items()} and len(got["k0"]) == 5 and len(got["k1"]) == 1


ROW = "id long, memory_id string, user_id long, entity string, stage string, mode string, thread_name string, importance double, original_importance double, summary string, content string, metadata string, created_at timestamp, updated_at timestamp, last_used_at timestamp"


def test_stream_of_memories_forgets_per_scope_and_reruns(spark, tmp_path):
    def batch(ids, user):
        return spark.createDataFrame([(i, f"m{i}", user, "e", "T1", "temporal", "t", 0.3, None, "s", "c", "{}", AT + dt.timedelta(hours=i), AT, None) for i in ids], ROW)

    now = F.lit("2024-01-20").cast("timestamp")
    run = T.after_turns(spark, str(tmp_path), now, capacity=3, threshold=0.4)
    run(batch(range(5), 1), 0)
    run(batch(range(10, 12), 2), 1)
    run(batch(range(10, 12), 2), 1)
    run(batch([5], 1), 2)
    left = T.memories_after(spark, str(tmp_path))
    assert sorted(r.id for r in left.collect()) == [3, 4, 5, 10, 11]
    # A batch that came twice made one version, the last one rewrote the bucket of the first user only.
    before, last = (Store(spark, str(tmp_path), M.SCOPE).manifest(v)["folders"] for v in (3, 4))
    assert sum(last[b] != before.get(b) for b in last) == 1
    assert M.forget(left, now, 3, 0.4).where("forgotten").count() == 0
    # However many batches there were, two versions stay.
    run(batch([6], 1), 3)
    assert len(list((tmp_path / "manifest").glob("*.json"))) == 2 and len(list((tmp_path / "data").glob("*"))) <= 3
    assert sorted(r.id for r in T.memories_after(spark, str(tmp_path)).collect()) == [4, 5, 6, 10, 11]


def test_forgetting_does_not_depend_on_the_batches(spark, tmp_path):
    rows = [(i, f"m{i}", i % 3, "e", "T1", "temporal", "t", (i * 37 % 100) / 100, None, "s", "c", "{}", AT + dt.timedelta(hours=i * 7 % 50), AT, None) for i in range(60)]
    now = F.lit("2024-01-05").cast("timestamp")
    run = T.after_turns(spark, str(tmp_path), now, capacity=6, threshold=0.4, parts=4)
    for b in range(5):
        run(spark.createDataFrame([r for r in rows if r[0] * 13 % 5 == b], ROW), b)
    want = M.forget(spark.createDataFrame(rows, ROW), now, 6, 0.4).where("not forgotten")
    assert sorted(r.id for r in T.memories_after(spark, str(tmp_path)).collect()) == sorted(r.id for r in want.collect())


def _stream_of(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_resent_messages_count_once_in_threads_and_messages(spark, tmp_path):
    schema = "message_id long, thread_id long, created_at timestamp, received_at timestamp"
    row = lambda i, t, h, later=0.0: (i, t, AT + dt.timedelta(hours=h), AT + dt.timedelta(hours=h + later))
    batches = [[row(1, 1, 0), row(1, 1, 0, 0.2)], [row(2, 1, 1), row(1, 1, 0, 1.5)], [row(3, 2, 2)], [row(4, 1, 30), row(3, 2, 2, 29)], [row(5, 2, 31)]]
    kept_in, seen = T.Conversations(spark, f"{tmp_path}/c", 4), []

    def each(batch, epoch):
        seen.append(epoch)
        kept_in.append(batch, epoch)
        kept_in.append(batch, epoch)  # as after a failure

    T.received_once(_stream_of(spark, tmp_path, batches, schema)).writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination(120)
    assert len(seen) >= 5 and sorted(r.message_id for r in kept_in.messages.read().collect()) == [1, 2, 3, 4, 5]
    assert {r.thread_id: r.updated_at for r in kept_in.threads.read().collect()} == {1: AT + dt.timedelta(hours=30), 2: AT + dt.timedelta(hours=31)}


def test_late_messages_and_expired_sessions(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    row = lambda k, i, h: (k, i, "user", f"m{i}", AT + dt.timedelta(hours=h))
    batches = [
        [row("idle", 1, 0), row("back", 2, 0), row("late", 3, 0)],
        [row("busy", 4, 20), row("late", 5, 0.5)],
        [row("busy", 6, 21), row("back", 7, 21)],  # timers fire, but that of "back" is set anew before
        [row("late", 8, 1), row("busy", 9, 21.5)],  # an hour-old message: nothing is held any more, and it is too late
        [row("busy", 10, 22), row("busy", 9, 21.5)],  # one is sent again
    ]
    rows = []

    def take(batch, epoch):
        rows.extend((epoch, r.session_key, r.message_id, r.place) for r in batch.collect())

    T.recent_buffers(_stream_of(spark, tmp_path, batches, MSG), cap=3, ttl=10 * 3600).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start().awaitTermination(120)
    frame = spark.createDataFrame(rows, "epoch int, session_key string, message_id long, place int")
    assert {(r.session_key, r.message_id, r.place) for r in T.last_buffers(frame).collect()} == {("busy", 6, 0), ("busy", 9, 1), ("busy", 10, 2), ("back", 7, 0)}
    assert {k for _, k, m, p in rows if p == -1 and m is None} == {"idle", "late"}
    assert not [r for r in rows if r[2] == 8]


def test_index_rebuild_upsert_remove(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("c", None, 1)], "chunk_id string, text string, stage_order int")
    assert {r.stage_order: r.chunks for r in index.rebuild(rows, f"{tmp_path}/i").collect()} == {0: 1, 1: 2}
    assert index.rebuild(rows.limit(1), f"{tmp_path}/i").count() == 1
    new = spark.createDataFrame([("b", None, 5), ("d", "w", 2)], rows.schema)
    got = {r.chunk_id: (r.text, r.stage_order) for r in index.upsert(rows, new).collect()}
    assert got == {"a": ("x", 0), "b": (None, 5), "c": (None, 1), "d": ("w", 2)}
    assert sorted(r.chunk_id for r in index.remove(rows, new).collect()) == ["a", "c"]


def test_entry_works_without_the_subpackage(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("timeloom.llm"):
            raise ModuleNotFoundError(name, name=name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "hybrid_retrieve" in entry.queries() and "pipeline" not in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.undo()
    sys.modules.pop("__spark_entry__", None)
