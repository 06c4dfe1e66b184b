import numpy as np
import pytest
from pyspark.sql import functions as F

from timeloom.llm.multi_index import nearest_vectors, walk

VECTORS = "vec_id long, embedding array<double>"


def found(spark, rows, asked="vec_id % 20 = 0", schema=VECTORS, **kwargs):
    got = nearest_vectors(spark.createDataFrame(rows, schema), F.expr(asked), **kwargs).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def brute(rows, k=20):
    good = [(i, np.array(v)) for i, v in rows if i is not None]
    out = []
    for q, a in good:
        if q % 20 == 0:
            near = sorted(((-float((a * b).sum()), i) for i, b in good if i != q))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


def vectors(n, dim, clusters, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim)) * 3
    return [(i, (centres[i % clusters] + r.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dim", "clusters"), [(16, 12), (7, 1)])
def test_recall_and_exact_scores(spark, dim, clusters):
    rows = vectors(1500, dim, clusters)
    true = {q: {i for p, _, i, _ in brute(rows) if p == q} for q in range(0, 1500, 20)}
    got = found(spark, rows, block_rows=200, part_rows=16, probe=40)
    at = dict(rows)
    assert all(s == float((np.array(at[q]) * np.array(at[i])).sum()) for q, _, i, s in got)
    assert all(sorted(n for p, n, _, _ in got if p == q) == list(range(1, 21)) for q in true)
    assert sum(i in true[q] for q, _, i, _ in got) >= 0.9 * 20 * len(true)
    assert all(x[3] >= y[3] for x, y in zip(got, got[1:]) if x[0] == y[0])


def test_walking_all_cells_is_exact(spark):
    rows = vectors(400, 9, 5)
    got, true = found(spark, rows, recall=1.0, probe=1000, block_rows=64, part_rows=4), brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in true]


def test_equal_vectors_fill_a_cell(spark):
    """A third of the rows is one vector: they are spread over blocks, and ties go to the smaller ids."""
    rows = vectors(300, 8, 4) + [(1000 + i, [4.0] * 8) for i in range(900)]
    got, true = found(spark, rows, recall=1.0, block_rows=100, part_rows=10), brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in true]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, None), (60, [-1.0, 2.0])]
    assert found(spark, rows) == [(0, 1, 1, 1.0), (0, 2, 60, -1.0), (60, 1, 1, 1.0), (60, 2, 0, -1.0)]


def test_repeated_rows_and_queries(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (3, [1.0, 2.0]), (3, [1.0, 2.0])]
    assert found(spark, rows) == [(0, 1, 3, 1.0), (0, 1, 3, 2.0), (0, 2, 3, 1.0), (0, 2, 3, 2.0)]


def test_empty_one_dimension_and_no_query(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert found(spark, [(0, [-2.0]), (1, [1.0]), (2, [-3.0])]) == [(0, 1, 2, 6.0), (0, 2, 1, -2.0)]


def test_extra_columns(spark):
    rows = [(*r, 1, "x", 3) for r in vectors(50, 4, 2)]
    got = found(spark, rows, schema=VECTORS + ", vector int, CELL string, row int", recall=1.0)
    assert [x[:3] for x in got] == [x[:3] for x in brute([r[:2] for r in rows])]


def test_the_heap_visits_cells_in_order_of_their_sums():
    r = np.random.default_rng(1)
    a, b, n = r.normal(size=9), r.normal(size=13), r.integers(0, 5, (9, 13))
    order = np.argsort(-np.add.outer(a, b).ravel())
    for stop in (1, 20, 100, n.sum()):
        last = order[np.searchsorted(np.cumsum(n.ravel()[order]), stop)]
        assert walk(a, b, n, stop) == np.add.outer(a, b).ravel()[last]
