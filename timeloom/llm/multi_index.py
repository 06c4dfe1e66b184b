"""Approximate nearest neighbours by an inverted multi-index: cells are pairs of centroids of two vector halves."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import top
from .common import cut

_VECTOR = "array<double>"


class Model(NamedTuple):
    """The centroids of the first and of the second half."""

    one: np.ndarray
    two: np.ndarray

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of the vectors' halves with the centroids; a cell's sum is its nearness to the vector."""
        h = self.one.shape[1]
        return x[:, :h] @ self.one.T, x[:, h:] @ self.two.T

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Number of the cell whose centroids are nearest to each half."""
        first, second = ((c**2).sum(1) - 2 * p for c, p in zip(self, self.parts(x), strict=True))
        return first.argmin(1) * len(self.two) + second.argmin(1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def usable(vectors: DataFrame, asked: Column, id_col: str, vector_col: str) -> DataFrame:
    """id, vector, asked of the rows that take part: with an id, of the commonest length, all components finite, not all zero."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(_VECTOR).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked")).where("id is not null and size(vector) > 0")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(fine)
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (length.n if length else 0))


def fit(rows: DataFrame, centroids: int, sample: int, rounds: int = 12, seed: int = 5) -> Model:
    """Centroids of each half by Lloyd's rounds over at most ``sample`` rows, those with the smallest hashes; equal vectors count once."""
    drawn = rows.select("vector").orderBy(F.xxhash64("id", "vector"), "id").limit(sample).toArrow()
    x = np.unique(_matrix(drawn.column("vector")), axis=0)
    h, random, found = (x.shape[1] + 1) // 2, np.random.default_rng(seed), []
    for half in (x[:, :h], x[:, h:]):
        c = half[random.choice(len(x), min(centroids, len(x)), replace=False)]
        for _ in range(rounds):
            near = ((c**2).sum(1) - 2 * half @ c.T).argmin(1)
            n = np.bincount(near, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, near, half)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        found.append(c)
    return Model(*found)


def _assign(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = model.cells(_matrix(batch.column("vector"))) if batch.num_rows else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(cells, pa.int32()))

    return run


def _counts(rows: DataFrame, cells: int) -> np.ndarray:
    """Rows a cell; there are at most as many cells as pairs of centroids, whatever the input."""
    n = np.zeros(cells, np.int64)
    for r in rows.groupBy("cell").count().collect():
        n[r.cell] = r["count"]
    return n


def _in_blocks(rows: DataFrame, counts: np.ndarray, size: int, out: str) -> DataFrame:
    """``rows`` with a block of about ``size`` rows: cells in order share blocks, and a cell with more rows is spread over several."""
    spark = rows.sparkSession
    starts = np.cumsum(counts) - counts
    table = spark.createDataFrame([(int(c), int(starts[c]), int(counts[c])) for c in np.flatnonzero(counts)], "cell int, __start long, __n long")
    place = F.col("__start") + F.pmod(F.xxhash64("row"), F.col("__n"))
    return rows.join(F.broadcast(table), "cell").withColumn(out, F.floor(place / size).cast("int")).drop("__start", "__n")


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, stop: int) -> float:
    """Visit cells in order of first[i] + second[j], largest first, until they hold ``stop`` rows; the last sum.

    The heap has the next cell of each row of the grid that has been entered: (i, j) is followed by
    (i, j + 1), and the first of a row by the first of the next.
    """
    by_one, by_two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b, n = first[by_one].tolist(), second[by_two].tolist(), counts[by_one][:, by_two].tolist()
    heap, seen, last = [(-(a[0] + b[0]), 0, 0)], 0, 0.0
    while heap and seen < stop:
        last, i, j = heapq.heappop(heap)
        seen += n[i][j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return -last


#: What two sums of the same products may differ by; cells that near to the last one are visited too.
SLACK = 1e-9


def _probes(model: Model, counts: np.ndarray, size: int, stop: int):
    """Queries to a row for each block that holds a cell they visit, with the sum of the last cell."""
    ends = np.cumsum(counts)
    grid, low, high = counts.reshape(len(model.one), len(model.two)), (ends - counts) // size, np.maximum(ends - 1, 0) // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, blocks, lasts = [], [], []
            for i, (first, second) in enumerate(zip(*model.parts(_matrix(batch.column("vector"))), strict=True)):
                last = walk(first, second, grid, stop) - SLACK
                cells = np.flatnonzero((np.add.outer(first, second) >= last).ravel() & (counts > 0))
                met = np.unique(low[cells])
                spread = cells[high[cells] > low[cells]]  # cells of several blocks
                met = np.unique(np.concatenate([met, *[np.arange(low[c], high[c] + 1) for c in spread]]))
                rows += [i] * len(met)
                blocks += met.tolist()
                lasts += [last] * len(met)
            out = batch.select(["row", "id", "vector", "part"]).take(pa.array(rows, pa.int32()))
            yield out.append_column("last", pa.array(lasts, pa.float64())).append_column("block", pa.array(blocks, pa.int32()))

    return run


def _search(model: Model, k: int):
    """The ``k`` nearest entries of a block for each of its queries, over the cells that these visit."""

    def run(asked: pa.Table, entries: pa.Table) -> pa.Table:
        q, q_row, q_id, last = _matrix(asked.column("vector")), *(asked.column(c).to_numpy() for c in ("row", "id", "last"))
        x, ids, cell = _matrix(entries.column("vector")), entries.column("id").to_numpy(), entries.column("cell").to_numpy()
        if not len(q) or not len(x):
            return pa.table({c: pa.array([], t) for c, t in (("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        # Of equal vectors only the k smallest ids, and one in place of the query's own, can be among the first.
        same = np.unique(x, axis=0, return_inverse=True)[1].ravel()
        order = np.lexsort((ids, same))
        nth = np.arange(len(order)) - np.searchsorted(same[order], same[order])
        stay = order[nth <= k]
        stay = stay[np.argsort(cell[stay], kind="stable")]
        x, ids, cell = x[stay], ids[stay], cell[stay]
        first, second = model.parts(q)
        score = np.full((len(q), len(x)), -np.inf)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        for at, end in zip(starts, [*starts[1:], len(cell)], strict=True):
            i, j = divmod(int(cell[at]), len(model.two))
            here = np.flatnonzero(first[:, i] + second[:, j] >= last)
            score[here, at:end] = q[here] @ x[at:end].T
        score[q_id[:, None] == ids[None, :]] = -np.inf
        kth = np.partition(score, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
        # A product of matrices may differ in its last digits for equal vectors: what may be among the first is computed anew.
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        a, b = np.nonzero((score >= (kth - slack)[:, None]) & np.isfinite(score))
        exact = np.concatenate([(q[a[s : s + 65_536]] * x[b[s : s + 65_536]]).sum(1) for s in range(0, len(a), 65_536)] or [np.zeros(0)])
        order = np.lexsort((ids[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        best = np.arange(len(a)) - np.searchsorted(a, a) < k
        return pa.table({"row": q_row[a[best]], "query_id": q_id[a[best]], "vec_id": ids[b[best]], "score": exact[best]})

    return run


def _best_cells(asked: pa.Table, k: int):
    """For a few queries the scores and cells of their ``k`` nearest rows of a task, by comparing with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own = _matrix(asked.column("vector")), asked.column("id").to_numpy()
        best, cells = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int32)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = q @ _matrix(batch.column("vector")).T
            new[own[:, None] == batch.column("id").to_numpy()[None, :]] = -np.inf
            score, cell = np.hstack([best, new]), np.hstack([cells, np.broadcast_to(batch.column("cell").to_numpy(), new.shape)])
            at = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best, cells = np.take_along_axis(score, at, 1), np.take_along_axis(cell, at, 1)
        i, j = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_pydict({"query": pa.array(i, pa.int32()), "score": best[i, j], "cell": pa.array(cells[i, j], pa.int32())})

    return run


def rows_to_visit(index: DataFrame, asked: DataFrame, model: Model, counts: np.ndarray, k: int, recall: float, probe: int) -> int:
    """How many rows a walk has to see for a share ``recall`` of the true neighbours to be among them.

    It is measured: the ``k`` nearest of ``probe`` queries, those with the smallest hashes, are found among all
    rows by comparing with each, and the rows of the cells up to that of each neighbour are counted.
    """
    drawn = asked.select("id", "vector").orderBy(F.xxhash64("id", "vector"), "id").limit(probe).toArrow()
    if not drawn.num_rows:
        return 0
    near = index.select("id", "vector", "cell").mapInArrow(_best_cells(drawn, k), "query int, score double, cell int")
    found = top(near, ["query"], [F.desc("score"), F.col("cell")], k).select("query", "cell").toArrow()
    sums = np.add.outer(np.zeros(drawn.num_rows), counts) * 0.0
    for i, (first, second) in enumerate(zip(*model.parts(_matrix(drawn.column("vector"))), strict=True)):
        sums[i] = np.add.outer(first, second).ravel()
    order = np.argsort(-sums, axis=1, kind="stable")
    seen = np.empty_like(order)
    np.put_along_axis(seen, order, np.cumsum(counts[order], axis=1), 1)
    depth = seen[found.column("query").to_numpy(), found.column("cell").to_numpy()]
    return int(np.ceil(np.quantile(depth, recall))) if len(depth) else 0


def nearest_vectors(vectors: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96, probe: int = 128, sample: int = 20_000, per_cell: int = 8, most_centroids: int = 256, block_rows: int = 4096, part_rows: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``asked`` holds for, the ``k`` others with the largest inner product that are found.

    Each half of a vector is quantised by its own centroids, as many as make cells (pairs of centroids) of about ``per_cell``
    rows, ``most_centroids`` at most; they are fitted on ``sample`` rows, every row is indexed. A query walks the pairs in order of
    the summed products with a heap until it has met as many rows as ``rows_to_visit`` measured to reach ``recall``, and the
    entries of the visited cells are ranked by their true inner product.

    Neither queries nor entries pass through the driver: entries are dealt over blocks of whole cells (a cell with more rows
    is spread over several), queries over parts by their own cell, and a block meets only the parts with a query that visits it.
    All that is broadcast is the centroids and a number a cell.

    Rows whose vector is null, empty, zero or of an uncommon length, or holds null or non-finite components, and rows without an
    id, take no part. Rows with the query's id are its own; other repeated rows are found as often as they are there, and a
    repeated query is answered as often. Ties go to the smaller id. Fewer rows are found where there are
    fewer. Other columns are not used, except by ``asked``, which may name the id; an empty table gives an empty table.
    """
    rows = usable(vectors, asked, id_col, vector_col)
    out = "query_id long, rank int, vec_id long, score double"
    n = rows.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], out)
    model = fit(rows, max(1, min(most_centroids, round((n / per_cell) ** 0.5))), sample)
    index = cut(rows.mapInArrow(_assign(model), f"id long, vector {_VECTOR}, asked boolean, cell int").withColumn("row", F.monotonically_increasing_id()))
    queries = index.where("asked")
    counts, q_counts = (_counts(x, len(model.one) * len(model.two)) for x in (index, queries))
    stop = rows_to_visit(index, queries, model, counts, k, recall, probe)
    dealt = _in_blocks(queries, q_counts, part_rows, "part")
    probes = cut(dealt.select("row", "id", "vector", "part").mapInArrow(_probes(model, counts, block_rows, stop), f"row long, id long, vector {_VECTOR}, part int, last double, block int"))
    meeting = probes.select(F.col("block").alias("met_block"), F.col("part").alias("met_part")).distinct()
    blocks = _in_blocks(index, counts, block_rows, "block")
    entries = blocks.join(meeting, F.col("block") == F.col("met_block")).select("block", F.col("met_part").alias("part"), "id", "vector", "cell")
    met = probes.groupBy("block", "part").cogroup(entries.groupBy("block", "part")).applyInArrow(_search(model, k), "row long, query_id long, vec_id long, score double")
    return top(met, ["row"], [F.desc("score"), F.col("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
