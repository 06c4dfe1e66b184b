import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.operators.vectors import nearest
from timeloom.sources import vector_index
from timeloom.sources.vector_index import VectorIndex

CHUNKS = "chunk_id string, entity string, stage string, stage_order int, embedding array<double>"
QUERIES = CHUNKS.replace("chunk_id string", "query_id long")


def made(spark, n, dim=6, clusters=9, seed=0, schema=CHUNKS, spread=0.1):
    r = np.random.default_rng(seed)
    centres = np.random.default_rng(7).normal(size=(clusters, dim))
    key = (lambda i: f"c{i:04d}") if schema is CHUNKS else int
    rows = [(key(i), f"e{i % 3}", f"T{i % 4}", i % 4, (centres[i % clusters] + spread * r.normal(size=dim)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted((r.query_id, r.dense_rank, r.chunk_id, round(r.distance, 9)) for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    return VectorIndex(spark, str(tmp_path / "index"), buckets=4)


@pytest.mark.parametrize("visible", ["all", "scope", "so_far"])
def test_search_is_exact(spark, index, visible, monkeypatch):
    monkeypatch.setattr(vector_index, "ROWS", 10)
    monkeypatch.setattr(vector_index, "ASKED", 4)
    chunks, queries = made(spark, 300), made(spark, 25, seed=1, schema=QUERIES)
    index.build(chunks)
    assert got(index.search(queries, 4, visible, first=2)) == got(nearest(queries, chunks, 4, visible))


def test_few_rows_are_compared_where_vectors_have_clusters(spark, index):
    chunks, queries = made(spark, 900, clusters=30, spread=0.01), made(spark, 20, clusters=30, seed=2, schema=QUERIES, spread=0.01)
    index.build(chunks)
    compared, all_pairs = index.rows_read(queries, 5, first=2)
    assert compared < 0.2 * all_pairs and got(index.search(queries, 5, first=2)) == got(nearest(queries, chunks, 5))


def test_upserts_and_removals(spark, index):
    chunks, queries = made(spark, 200), made(spark, 10, seed=1, schema=QUERIES)
    index.build(chunks)
    moved = made(spark, 30, seed=9).withColumn("entity", F.lit("e9"))  # other vectors for known ids
    added = made(spark, 40, seed=4).withColumn("chunk_id", F.concat(F.lit("new"), "chunk_id"))
    without = spark.createDataFrame([("c0050", "e", "T0", 0, None)], CHUNKS)
    touched = index.upsert(moved.unionByName(added).unionByName(without))
    index.remove(spark.createDataFrame([("c0060",), ("unknown",)], "chunk_id string"))
    left = chunks.join(moved.select("chunk_id"), "chunk_id", "left_anti").where("chunk_id not in ('c0050', 'c0060')")
    now = left.unionByName(moved).unionByName(added)
    again = VectorIndex(spark, index.path)  # as another program opens it
    assert touched and got(again.search(queries, 6, first=3)) == got(nearest(queries, now, 6))
    assert {(r.cell, r.n) for r in again.extent.read().collect()} == {(r.cell, r["count"]) for r in again.cells.read().groupBy("cell").count().collect()}
    assert sorted(tuple(r) for r in again.places.read().collect()) == sorted(tuple(r) for r in again.cells.read().select("chunk_id", "cell").collect())


def test_an_upsert_of_one_row_rewrites_one_or_two_cells(spark, index):
    index.build(made(spark, 200))
    before = index.cells.manifest()["folders"]
    index.upsert(made(spark, 1, seed=9))
    after = index.cells.manifest()["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2


def test_nulls_equal_vectors_repeated_questions_and_empty(spark, index):
    rows = [(f"c{i}", "e", "T0", 0, [1.0, 2.0]) for i in range(30)] + [("n", "e", "T0", 0, None), ("f", None, None, None, [9.0, 9.0])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(1, "e", "T0", 0, [1.0, 2.0]), (1, "e", "T0", 0, [9.0, 9.0]), (2, None, None, None, [1.0, 2.0]), (3, "e", "T0", 0, None)], QUERIES)
    index.build(chunks)
    assert [x[:3] for x in got(index.search(queries, 2))] == [(1, 1, "c0"), (1, 1, "f"), (1, 2, "c0"), (1, 2, "c1"), (2, 1, "c0"), (2, 2, "c1")]
    assert got(index.search(queries.where("query_id = 2"), 2, "so_far")) == []
    index.build(chunks.limit(0))
    assert got(index.search(queries, 2)) == []
