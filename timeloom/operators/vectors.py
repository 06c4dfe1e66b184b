"""Vectors: computing them in batches, and exact nearest neighbours under a filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept, top

#: Most bytes of query vectors that one pass over the chunks carries.
QUERY_BYTES = 32 << 20

#: Columns that must agree, or for "so_far" not lie after the query's, for a chunk to be seen.
FILTERS = {"all": [], "scope": ["entity", "stage"], "so_far": ["stage_order"]}


def embed(rows: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]], text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with the vector of their text, ``batch`` texts a call; ``embed_fn`` is given and loaded once a worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                yield part.assign(**{out: [list(map(float, v)) for v in embed_fn(part[text].fillna("").tolist())]})

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != out)
    return rows.drop(out).mapInPandas(run, f"{fields}, {out} array<double>")


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    """1 / (1 + distance), distances below 0 as 0; null for null."""
    return F.when(distance.isNotNull(), 1 / (1 + F.greatest(distance, F.lit(0.0))))


def nearest(queries: DataFrame, chunks: DataFrame, k: int, visible: str = "all", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, chunk_id, distance, dense_rank: for each query its ``k`` nearest chunks by squared distance.

    ``visible`` says which chunks a query may see: "all", "scope" (its entity
    and stage) or "so_far" (stage_order up to its own). Equally near ones come
    by chunk_id. Queries without a vector find nothing, chunks without one are
    not found.

    The stated queries are few beside the chunks and go to all tasks in blocks
    of bounded size; each task keeps its own ``k`` best per query, so what is
    shuffled is k rows a query and task.
    """
    by = FILTERS[visible]
    seen = " and ".join(f"{c} is not null" for c in ["embedding", *by])
    asked = queries.where(seen).select("query_id", *by, F.col("embedding").cast("array<double>").alias("embedding"))
    rows = chunks.where(seen).select("chunk_id", *by, F.col("embedding").cast("array<double>").alias("embedding"))
    total, n = asked.agg(F.sum(F.size("embedding") * 8 + 64), F.count(F.lit(1))).first()
    blocks = max(1, min(-(-(total or 0) // query_bytes), n))
    q_kind, c_kind = dict(asked.dtypes)["query_id"], dict(rows.dtypes)["chunk_id"]
    found = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows and (found is not None or b + 1 < blocks):
            continue  # a block that no question fell into needs no pass
        shared = queries.sparkSession.sparkContext.broadcast(part)
        near = rows.mapInArrow(_block_search(shared, k, visible), f"query_id {q_kind}, chunk_id {c_kind}, distance double")
        found = near if found is None else found.unionByName(near)
    return top(found, ["query_id"], [F.col("distance"), F.col("chunk_id")], k, "dense_rank")


#: Most distances of one block of questions and one batch of chunks.
BLOCK = 1 << 22


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _block_search(shared, k: int, visible: str):
    by = FILTERS[visible]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        if not asked.num_rows:
            return
        q = _matrix(asked.column("embedding"))
        q_len = (q**2).sum(1)
        own = [np.array(asked.column(c).to_pylist(), object) for c in by]
        # Where the k-th nearest found so far is known, farther rows are of no interest.
        best, limit = None, asked.column("limit").to_numpy().copy() if "limit" in asked.column_names else np.full(len(q), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("embedding"))
            x_len = (x**2).sum(1)
            theirs = [np.array(batch.column(c).to_pylist(), object) for c in by]
            for at in range(0, len(q), step := max(1, BLOCK // len(x))):
                part = slice(at, at + step)
                d = q_len[part, None] - 2 * q[part] @ x.T + x_len
                for a, b in zip(own, theirs, strict=True):
                    codes, places = np.unique(np.concatenate([a[part], b]), return_inverse=True)
                    a, b = places[: len(d), None], places[len(d) :]
                    d[b > a if visible == "so_far" else b != a] = np.inf
                # The product is only near to the distance: what may be among the k nearest, ties too, is computed anew.
                kth = np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
                slack = 1e-9 * (q_len[part] + x_len.max() + 1)
                i, j = np.nonzero((d <= (np.minimum(kth, limit[part]) + slack)[:, None]) & np.isfinite(d))
                exact = ((x[j] - q[part][i]) ** 2).sum(1)
                new = pa.table({"i": i + at, "chunk_id": batch.column("chunk_id").take(pa.array(j)), "distance": exact})
                best = new if best is None else pa.concat_tables([best, new])
            best = _first(best, k)
            i, d = best.column("i").to_numpy(), best.column("distance").to_numpy()
            full = np.flatnonzero(np.bincount(i, minlength=len(q)) == k)
            limit[full] = np.minimum(limit[full], d[np.searchsorted(i, full, "right") - 1])
        if best is not None:
            ids = asked.column("query_id").combine_chunks().take(pa.array(best.column("i").to_numpy()))
            yield from pa.table({"query_id": ids, "chunk_id": best.column("chunk_id"), "distance": best.column("distance")}).combine_chunks().to_batches()

    return run


def _first(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest rows of each question, by question, distance and chunk."""
    found = found.sort_by([("i", "ascending"), ("distance", "ascending"), ("chunk_id", "ascending")])
    i = found.column("i").to_numpy()
    return found.take(pa.array(np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) < k)))


def nearest_in_groups(queries: DataFrame, rows: DataFrame, by: list[str], id_col: str, k: int, block_rows: int = 8192, block_queries: int = 2048, salts: int = 16, few: int = 10_000) -> DataFrame:
    """query_id, ``id_col``, distance, dense_rank: for each query the ``k`` nearest rows of its own group, which all of ``by`` name.

    Equally near ones come by id. Rows and queries whose vector is null, or has
    a component that is null or not finite, take no part, nor do those with a
    null in ``by``; vectors of different lengths do not meet. ``id_col`` is a key.

    A group is cut into cells of about ``block_rows`` rows and ``block_queries``
    queries, and small groups share cells of that size. A cell is one cogroup: it
    fits a task whatever the group's size, compares each group's vectors by
    matrix products and hands on its own ``k`` best a query, so no pair becomes a
    row but these. The hash of its key names a small group's cell; only the hot
    ones, at most as many as there are blocks, are looked up, and go to all tasks
    only if they are ``few``.
    """
    whole = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    for c in by:
        whole = whole & F.col(c).isNotNull()
    key = [*by, "__dim"]
    narrow = lambda rows, c: rows.where(whole).select(F.col(c).alias("__id"), *by, F.size("embedding").alias("__dim"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked, had = narrow(queries, "query_id"), narrow(rows, id_col)
    count = lambda rows, a, b: rows.groupBy(*key).agg(F.count(F.lit(1)).alias(a)).withColumn(b, F.lit(0).cast("long"))
    both = count(asked, "__asked", "__had").unionByName(count(had, "__had", "__asked"))
    groups = kept(both.groupBy(*key).agg(F.sum("__asked").alias("__asked"), F.sum("__had").alias("__had")).withColumn("__group", F.monotonically_increasing_id()))
    small = (F.col("__asked") <= block_queries) & (F.col("__had") <= block_rows)
    n_asked, n_had, n_hot = groups.agg(F.sum(F.when(small, F.col("__asked"))), F.sum(F.when(small, F.col("__had"))), F.count_if(~small)).first()
    shared = max(1, -(-(n_asked or 0) // block_queries), -(-(n_had or 0) // block_rows))
    hot = groups.where(~small).select(*key, "__group", F.ceil(F.col("__asked") / block_queries).cast("int").alias("__q"), F.ceil(F.col("__had") / block_rows).cast("int").alias("__m"))
    kinds = dict(groups.dtypes)

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.select("__id", *[F.col(c).cast(kinds[c]).alias(c) for c in key], "embedding")
        cell = -1 - F.pmod(F.xxhash64(*key), F.lit(shared))
        if not n_hot:
            return rows.withColumns({"__cell": cell, "__q": F.lit(0), "__m": F.lit(0)})
        if n_hot <= few:
            placed = rows.join(F.broadcast(hot), key, "left")
        else:  # salted copies, so that the join has no task for one hot group
            salted = hot.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            placed = rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int")).join(salted.hint("merge"), [*key, "__salt"], "left")
        alone = F.col("__group").isNull()
        at = {own: F.when(alone, 0).otherwise(F.pmod(F.xxhash64(F.lit(1), "__id"), F.col(own)).cast("int")), other: F.explode(F.when(alone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(other) - 1)))}
        # Both sides read the same hot groups, so their columns get names of their own.
        return placed.where(alone | ((F.col("__q") > 0) & (F.col("__m") > 0))).select("__id", *key, "embedding", F.coalesce("__group", cell).alias("__cell"), at["__q"].alias("__q"), at["__m"].alias("__m"))

    cell = ["__cell", "__q", "__m"]
    cells = dealt(asked, "__q", "__m").groupBy(*cell).cogroup(dealt(had, "__m", "__q").groupBy(*cell))
    near = cells.applyInArrow(_cell_search(k, id_col, key), f"query_id {dict(asked.dtypes)['__id']}, `{id_col}` {dict(had.dtypes)['__id']}, distance double")
    return top(near, ["query_id"], [F.col("distance"), F.col(id_col)], k, "dense_rank")


def _numbered(asked: pa.Table, had: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number a row of both: rows that agree in all of ``key`` have the same."""
    numbers = np.zeros(len(asked) + len(had), np.int64)
    for c in key:
        codes = pa.chunked_array([*asked.column(c).chunks, *had.column(c).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        numbers = np.unique(numbers * (codes.max() + 1) + codes, return_inverse=True)[1]
    return numbers[: len(asked)], numbers[len(asked) :]


def _cell_search(k: int, id_col: str, key: list[str]):
    def run(asked: pa.Table, had: pa.Table) -> pa.Table:
        found = [pa.table({"i": pa.array([], pa.int64()), "chunk_id": had.column("__id").slice(0, 0), "distance": pa.array([], pa.float64())})]
        fresh = 0
        if len(asked) and len(had):
            ids, theirs = _numbered(asked, had, key)
            order, other = np.argsort(ids), np.argsort(theirs)
            asked, had, ids, theirs = asked.take(order).combine_chunks(), had.take(other).combine_chunks(), ids[order], theirs[other]
        else:
            ids = np.zeros(0, np.int64)
        for g in np.unique(ids):
            a, b = np.searchsorted(ids, [g, g + 1]), np.searchsorted(theirs, [g, g + 1])
            if b[0] == b[1]:
                continue
            q, x = (_matrix(t.column("embedding").slice(s[0], s[1] - s[0])) for t, s in ((asked, a), (had, b)))
            for i, j, d in _closest(q, x, k):
                found.append(pa.table({"i": i + a[0], "chunk_id": had.column("__id").take(pa.array(j + b[0])), "distance": d}))
                fresh += len(d)
                if fresh > BLOCK // 4:
                    found, fresh = [_first(pa.concat_tables(found), k)], 0
        best = _first(pa.concat_tables(found), k)
        return pa.table({"query_id": asked.column("__id").take(best.column("i")), id_col: best.column("chunk_id"), "distance": best.column("distance")})

    return run


def _closest(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``q`` and ``x`` and their distance: for each row of ``q`` its ``k`` nearest of ``x``, ties and near ties too."""
    q_len, x_len = (q**2).sum(1), (x**2).sum(1)
    room = max(1, BLOCK // max(1, x.shape[1]))
    for at in range(0, len(q), step := max(1, BLOCK // len(x))):
        part = slice(at, at + step)
        # The product is only near to the distance, so what it leaves is computed anew.
        d = q_len[part, None] - 2 * q[part] @ x.T + x_len
        kth = np.partition(d, k - 1, 1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
        i, j = np.nonzero(d <= (kth + 1e-9 * (q_len[part] + x_len.max() + 1))[:, None])
        for s in range(0, len(i), room):
            i_, j_ = i[s : s + room], j[s : s + room]
            yield i_ + at, j_, ((x[j_] - q[part][i_]) ** 2).sum(1)
