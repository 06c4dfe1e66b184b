import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from timeloom.sources.store import Store


def rows(store, version=None):
    return sorted(tuple(r) for r in store.read(version).collect())


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"), ["k"], buckets=8)
    s.replace(spark.createDataFrame([(i, f"v{i}", None) for i in range(200)], "k long, v string, extra int"))
    return s


def test_an_upsert_rewrites_its_buckets_only(spark, store):
    before = files(store.path)
    touched = store.upsert(spark.createDataFrame([(5, "new", 1), (1000, "added", None)], "k long, v string, extra int"))
    after = files(store.path)
    assert len(touched) in (1, 2)
    stay = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert stay and stay <= after  # files of other buckets are the same files
    assert {f.split("/")[1] for f in after - before} == {store.manifest()["folders"][str(b)] for b in touched}
    want = {i: (i, f"v{i}", None) for i in range(200)} | {5: (5, "new", 1), 1000: (1000, "added", None)}
    assert rows(store) == sorted(want.values(), key=lambda r: r[0])


def test_a_repeat_changes_nothing(spark, store):
    change = spark.createDataFrame([(5, "new", None)], "k long, v string, extra int")
    assert store.upsert(change) and not store.upsert(change)
    assert store.manifest()["version"] == 2
    assert not store.upsert(spark.createDataFrame([(7, "v7", None)], "k long, v string, extra int"))
    assert not store.remove(spark.createDataFrame([], "k long"))


def test_readers_see_one_version(spark, store):
    held = store.read()  # opened before the change
    store.remove(spark.createDataFrame([(i,) for i in range(100)], "k long"))
    assert held.count() == 200 and store.read().count() == 100 and store.read(1).count() == 200


def test_old_versions_and_their_files_go(spark, store):
    for n in range(6):
        store.upsert(spark.createDataFrame([(n, f"again {n}", n)], "k long, v string, extra int"))
    assert store.versions() == [6, 7]
    named = {f for v in store.versions() for f in store.manifest(v)["folders"].values()}
    assert {f.split("/")[1] for f in files(store.path)} == named
    assert store.read().count() == 200 and store.read(6).where("extra = 5").count() == 0


def test_a_batch_counts_once(spark, store):
    def add(old, new):
        return old.unionByName(new)

    change = spark.createDataFrame([(3, "twice", None)], "k long, v string, extra int")
    assert store.merge(change, add, batch=4) and not store.merge(change, add, batch=4) and not store.merge(change, add, batch=3)
    assert store.read().where("k = 3").count() == 2 and store.merge(change, add, batch=5)


def test_a_half_written_manifest_is_passed_over(spark, store):
    Path(store.path, "manifest", f"{9:012d}.json").write_text(json.dumps(store.manifest())[:40])
    assert store.read().count() == 200


def test_a_second_writer_is_refused(spark, store):
    before = store.manifest()
    store.upsert(spark.createDataFrame([(1, "first", None)], "k long, v string, extra int"))
    with pytest.raises(Exception, match="exist"):
        store._commit(before | {"version": before["version"] + 1})
    assert store.read().where("v = 'first'").count() == 1


def test_nulls_empty_tables_and_other_keys(spark, tmp_path):
    s = Store(spark, str(tmp_path / "n"), ["a", "b"], buckets=4)
    with pytest.raises(ValueError, match="no table"):
        s.read()
    s.upsert(spark.createDataFrame([(None, "x", 1), (1, "y", 2)], "a int, b string, bucket2 int"))
    s.upsert(spark.createDataFrame([(None, "x", 3), (1, "y", 5)], "a int, b string, bucket2 int"))  # a null key matches none
    assert sorted((r.a or 0, r.b, r.bucket2) for r in s.read().collect()) == [(0, "x", 1), (0, "x", 3), (1, "y", 5)]
    s.replace(spark.createDataFrame([], "a int, b string, bucket2 int"))
    assert s.read().count() == 0 and s.read().columns == ["a", "b", "bucket2"]
    assert Store(spark, s.path, ["a", "b"], buckets=99).buckets == 4
    assert s.upsert(s.read().withColumn("a", F.lit(1))) == set()
