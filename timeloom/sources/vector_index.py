"""A stored index of chunk vectors: cells around centroids, searched exactly by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept, top
from ..operators.vectors import FILTERS, _block_search, _matrix
from .store import Store

#: Columns that a search may filter by, besides the chunk's id and vector.
COLUMNS = ("entity", "stage", "stage_order")

#: Rows of a cell, and questions, that one task compares at a time.
ROWS, ASKED = 8192, 2048


def centroids(x: np.ndarray, n: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``n`` centroids of the rows of ``x`` by Lloyd's rounds; fewer where there are fewer different rows."""
    x = np.unique(x, axis=0)
    c = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)] if len(x) else x
    for _ in range(rounds if len(x) else 0):
        near = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
        held = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))


def _place(c: np.ndarray):
    """Rows to their cell, that of the nearest centroid, and how far away from it they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = _distances(_matrix(batch.column("embedding")), c) if batch.num_rows else np.zeros((0, 1))
            cell = far.argmin(1)
            yield batch.append_column("cell", pa.array(cell, pa.int32())).append_column("away", pa.array(far[np.arange(len(far)), cell], pa.float64()))

    return run


def _probe(c: np.ndarray, least: np.ndarray, most: np.ndarray, first: int, start: int):
    """Questions to a row for each cell they have to look into.

    ``start`` 0: the ``first`` nearest cells that have rows. Otherwise: those after these that can hold a row as near as ``limit``.
    A row ``away`` from a centroid that is D from the question is at least D - away and away - D from the question.
    """
    full = np.flatnonzero(np.isfinite(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(full):
                continue
            x = _matrix(batch.column("embedding"))
            far = _distances(x, c[full])
            order = np.argsort(far, axis=1, kind="stable")[:, start : start + first if not start else None]
            d = np.take_along_axis(far, order, 1)
            i, j = np.nonzero(np.ones(order.shape, bool))
            cells = full[order[i, j]]
            if start:
                bound = np.maximum(d[i, j] - most[cells], least[cells] - d[i, j])
                limit = np.sqrt(batch.column("limit").to_numpy())
                # Distances by products are right to about half of their digits.
                near = bound <= limit[i] + 1e-6 * (1 + np.abs(x).max())
                i, cells = i[near], cells[near]
            yield batch.take(pa.array(i)).append_column("cell", pa.array(cells, pa.int32()))

    return run


class VectorIndex:
    """Vectors of chunks under ``path``, dealt over cells by their nearest centroid.

    ``build`` fits the centroids on at most ``sample`` rows and places every row that has a vector; ``upsert`` and
    ``remove`` rewrite only the buckets of the cells that gain or lose rows (``Store``); ``search`` reads the
    cells that can hold one of a question's nearest. The centroids are not fitted again by an upsert: that makes cells
    uneven in time, not results wrong.

    Tables: ``centroids`` (cell, centroid), ``cells`` (the rows, by cell), ``places`` (chunk_id, cell: where a
    row is to be found; made by the first change) and ``extent`` (cell, n, least, most: rows and how far they are from the centroid).
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path
        self.cells = Store(spark, f"{path}/cells", ["cell"], buckets)
        self.places = Store(spark, f"{path}/places", ["chunk_id"], buckets)
        self.extent = Store(spark, f"{path}/extent", ["cell"], 1)

    def build(self, chunks: DataFrame, cells: int | None = None, most_cells: int = 1024, sample: int = 20_000) -> VectorIndex:
        """Index ``chunks`` (chunk_id, embedding, and those of ``COLUMNS`` that it has); the square root of their number makes the cells."""
        rows = self._rows(chunks)
        drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(sample).toArrow()
        wanted = cells or max(1, min(most_cells, round(rows.count() ** 0.5)))
        c = centroids(_matrix(drawn.column("embedding")), wanted) if drawn.num_rows else np.zeros((0, 0))
        self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, centroid array<double>").write.mode("overwrite").parquet(f"{self.path}/centroids")
        self.cells.replace(self._placed(rows, c))
        self.extent.replace(self._extents(self.cells.read()))
        if self.places.manifest():
            self.places.replace(self.cells.read().select("chunk_id", "cell"))
        return self

    def _rows(self, chunks: DataFrame) -> DataFrame:
        own = [c for c in COLUMNS if c in chunks.columns]
        return chunks.where("embedding is not null").select("chunk_id", *own, F.col("embedding").cast("array<double>").alias("embedding"))

    def _placed(self, rows: DataFrame, c: np.ndarray) -> DataFrame:
        fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
        return rows.mapInArrow(_place(c), f"{fields}, cell int, away double")

    @staticmethod
    def _extents(placed: DataFrame) -> DataFrame:
        return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most"))

    def _centroids(self) -> np.ndarray:
        """At most ``most_cells`` rows."""
        return np.array([r.centroid for r in self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()])

    def _change(self, ids: DataFrame, new: DataFrame) -> set[int]:
        """Take out the rows of ``ids`` and put in ``new`` placed ones; the buckets of cells rewritten."""
        if not self.places.manifest():
            self.places.replace(self.cells.read().select("chunk_id", "cell"))
        old = kept(self.places.read(buckets={r.b for r in ids.select(self.places.bucket().alias("b")).distinct().collect()}).join(ids, "chunk_id"))
        columns = self.cells.read().columns
        gone = old.select("cell", "chunk_id").withColumn("__new", F.lit(None).cast(new.select(F.struct(*columns)).schema[0].dataType))
        changes = gone.unionByName(new.select("cell", "chunk_id", F.struct(*columns).alias("__new")))

        def put(rows: DataFrame, changed: DataFrame) -> DataFrame:
            left = rows.join(changed.select("chunk_id").distinct(), "chunk_id", "left_anti").select(*columns)
            return left.unionByName(changed.where("__new is not null").select("__new.*").select(*columns))

        touched = self.cells.merge(changes, put)
        hit = changes.select("cell").distinct()
        now = self._extents(self.cells.read(buckets=touched).join(F.broadcast(hit), "cell"))
        self.extent.merge(hit.join(now, "cell", "left"), lambda rows, changed: rows.join(changed.select("cell"), "cell", "left_anti").unionByName(changed.where("n > 0").select(*rows.columns)))
        self.places.remove(old.select("chunk_id").join(new.select("chunk_id"), "chunk_id", "left_anti"))
        self.places.upsert(new.select("chunk_id", "cell"))
        return touched

    def upsert(self, chunks: DataFrame) -> set[int]:
        """Chunks in place of those with their id, new ones added; one without a vector leaves the index.

        The cells come first and the places after them, so an upsert that was cut short is done again as a whole.
        """
        c = self._centroids()
        if not len(c):
            self.build(chunks)  # nothing was there to fit cells on
            return {int(b) for b in self.cells.manifest()["folders"]}
        new = kept(self._placed(self._rows(chunks), c))
        return self._change(kept(chunks.select("chunk_id").distinct()), new)

    def remove(self, ids: DataFrame) -> set[int]:
        return self._change(kept(ids.select("chunk_id").distinct()), self.cells.read().where("false"))

    def search(self, queries: DataFrame, k: int, visible: str = "all", first: int = 4) -> DataFrame:
        """query_id, chunk_id, distance, dense_rank: what ``vectors.nearest`` gives, from the cells that matter.

        A question looks into its ``first`` nearest cells; its k-th nearest there bounds what is still of interest,
        and the triangle inequality tells which other cells can hold it. Where fewer than ``k`` rows
        may be seen so far, all cells can. Questions stay in tables: cells and the questions
        that look into them are met in blocks of ``ROWS`` rows and ``ASKED`` questions, so a hot cell or a crowd of
        questions is many tasks. What is broadcast is the centroids and their extents.
        """
        by = FILTERS[visible]
        seen = " and ".join(f"{c} is not null" for c in ["embedding", *by])
        asked = kept(queries.where(seen).select("query_id", *by, F.col("embedding").cast("array<double>").alias("embedding")).withColumn("ask", F.monotonically_increasing_id()))
        c, (least, most, n) = self._centroids(), self._extent_arrays()
        fields = ", ".join(f"`{x}` {t}" for x, t in asked.dtypes)
        near = self._meet(asked.withColumn("limit", F.lit(float("inf"))).mapInArrow(_probe(c, least, most, first, 0), f"{fields}, limit double, cell int"), k, visible, n)
        if np.isfinite(least).sum() > first:
            near = kept(near)
            bound = near.groupBy("ask").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("limit"))
            open_ = asked.join(bound, "ask", "left").withColumn("limit", F.when(F.col("n") >= k, F.col("limit")).otherwise(float("inf"))).drop("n").select(*asked.columns, "limit")
            probes = open_.mapInArrow(_probe(c, least, most, first, first), f"{fields}, limit double, cell int")
            near = near.unionByName(self._meet(probes, k, visible, n))
        return top(near, ["ask"], [F.col("distance"), F.col("chunk_id")], k, "dense_rank").select("query_id", "chunk_id", "distance", "dense_rank")

    def _extent_arrays(self) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
        rows = self.extent.read().collect()  # one a cell
        size = len(self._centroids())
        least, most = np.full(size, np.inf), np.full(size, -np.inf)
        for r in rows:
            least[r.cell], most[r.cell] = r.least, r.most
        return least, most, {r.cell: r.n for r in rows}

    def _meet(self, probes: DataFrame, k: int, visible: str, n: dict[int, int]) -> DataFrame:
        """ask, query_id, chunk_id, distance: the k nearest of each question among the rows of each cell block it looks into."""
        by = FILTERS[visible]
        probes = kept(probes)
        looked = {r.cell: r["count"] for r in probes.groupBy("cell").count().collect()}  # one a cell
        sizes = self.spark.createDataFrame([(cell, -(-n[cell] // ROWS), -(-m // ASKED)) for cell, m in looked.items()], "cell int, blocks int, parts int")
        stored = self.cells.read(buckets=None if len(looked) == len(n) else self._buckets_of(sizes))
        kinds = dict(stored.dtypes) | dict(probes.dtypes)
        seen = " and ".join(f"{c} is not null" for c in ["cell", *by])
        rows = stored.where(seen).join(F.broadcast(sizes), "cell").select("cell", F.pmod(F.xxhash64("chunk_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk_id", *by, "embedding")
        asks = probes.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("ask"), "parts").cast("int").alias("part"), "ask", "query_id", "limit", *by, "embedding")
        group = ["cell", "block", "part"]
        schema = f"ask long, query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, distance double"
        found = asks.groupBy(*group).cogroup(rows.groupBy(*group)).applyInArrow(_met(k, visible), schema)
        return top(found, ["ask"], [F.col("distance"), F.col("chunk_id")], k, "__nth").drop("__nth")

    def _buckets_of(self, cells: DataFrame) -> set[int]:
        return {r.b for r in cells.select(self.cells.bucket().alias("b")).distinct().collect()}

    def rows_read(self, queries: DataFrame, k: int, first: int = 4) -> tuple[int, int]:
        """Pairs of question and row that ``search`` over all rows compares, and those there are."""
        c, (least, most, n) = self._centroids(), self._extent_arrays()
        asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        last = self.search(queries, k, first=first).groupBy("query_id").agg(F.max("distance").alias("limit"))
        kind = dict(asked.dtypes)["query_id"]
        near = asked.withColumn("limit", F.lit(0.0)).mapInArrow(_probe(c, least, most, first, 0), f"query_id {kind}, embedding array<double>, limit double, cell int")
        more = asked.join(last, "query_id").mapInArrow(_probe(c, least, most, first, first), f"query_id {kind}, embedding array<double>, limit double, cell int")
        compared = sum(n[r.cell] * r["count"] for r in near.unionByName(more).groupBy("cell").count().collect())
        return compared, asked.count() * sum(n.values())


def _met(k: int, visible: str):
    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = [("ask", pa.int64()), ("query_id", asked.schema.field("query_id").type), ("chunk_id", rows.schema.field("chunk_id").type), ("distance", pa.float64())]
        schema = pa.schema(kinds)
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        # The search names questions by the key of their row.
        keyed = asked.drop_columns(["query_id"]).rename_columns(["query_id" if c == "ask" else c for c in asked.column_names if c != "query_id"])
        batches = [*_block_search(SimpleNamespace(value=keyed), k, visible)(iter(rows.to_batches()))]
        if not batches:
            return schema.empty_table()
        found = pa.Table.from_batches(batches)
        at = dict(zip(asked.column("ask").to_pylist(), asked.column("query_id").to_pylist(), strict=True))
        asks = found.column("query_id").to_pylist()
        return pa.table([asks, [at[a] for a in asks], found.column("chunk_id"), found.column("distance")], schema=schema)

    return run
