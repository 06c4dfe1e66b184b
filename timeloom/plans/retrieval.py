"""Filtered hybrid retrieval for a table of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import kept, top
from ..operators.ranking import bm25, fuse, min_max, rerank
from ..operators.vectors import nearest, similarity


@dataclass(frozen=True)
class Settings:
    """What a retriever takes: the filter, k, the pool's size and the weights of its routes."""

    visible: str
    pool_k: int
    k: int = 5
    dense_weight: float = 0.7
    sparse_weight: float = 0.3

    @property
    def dense_k(self) -> int:
        return max(6 * self.k, self.k)


def profile_settings(k: int = 5) -> Settings:
    return Settings("scope", max(8 * k, 20), k)


def corpus_settings(k: int = 5) -> Settings:
    return Settings("so_far", max(4 * k, 12), k, 0.65, 0.35)


def candidates(queries: DataFrame, chunks: DataFrame, s: Settings) -> DataFrame:
    """The nearest chunks of each query, one search for both uses: in_dense and in_pool say which."""
    near = nearest(queries, chunks, max(s.dense_k, s.pool_k), s.visible)
    return near.withColumns({"dense_score": similarity(F.col("distance")), "in_dense": F.col("dense_rank") <= s.dense_k, "in_pool": F.col("dense_rank") <= s.pool_k})


def hybrid(queries: DataFrame, chunks: DataFrame, s: Settings, relevance: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, dense_score, bm25_score, fused_score, rerank_score, rank: the best ``s.k`` chunks of each query.

    Dense similarity and BM25 over the query's pool are normalised and summed
    by weight; the best ``s.dense_k`` are cut to k, or reranked by a table
    (query_id, chunk_id, relevance). A score that a chunk lacks shows as 0.
    Where the fused scores are equal, chunks that mention the query's entity
    come first if ``chunks`` has mentions and the queries an entity, then those
    with the smaller chunk_id.
    """
    found = kept(candidates(queries, chunks, s))
    dense = found.where("in_dense").select("query_id", "chunk_id", F.lit("dense").alias("route"), F.col("dense_score").alias("score"))
    pool = found.where("in_pool").select("query_id", "chunk_id")
    sparse = bm25(queries.select("query_id", "text"), pool, texts=chunks.select("chunk_id", "text")).select("query_id", "chunk_id", F.lit("bm25").alias("route"), "score")
    both = fuse(min_max(dense.unionByName(sparse), ["query_id", "route"]), {"dense": s.dense_weight, "bm25": s.sparse_weight}, keep="score")
    order = [F.desc("fused_score"), F.col("chunk_id")]
    if "mentions" in chunks.columns and "entity" in queries.columns:
        asked = queries.select("query_id", F.col("entity").alias("__entity"))
        both = both.join(asked, "query_id").join(chunks.select("chunk_id", "mentions"), "chunk_id").withColumn("__named", F.array_contains("mentions", F.col("__entity"))).drop("mentions", "__entity")
        order = [F.desc("fused_score"), F.desc("__named"), F.col("chunk_id")]
    cut = top(both, ["query_id"], order, s.dense_k, "rank").drop("__named")
    if relevance is None:
        out = cut.where(F.col("rank") <= s.k).withColumn("rerank_score", F.lit(0.0))
    else:
        out = rerank(cut.drop("rank"), relevance, s.k).withColumnRenamed("rerank_rank", "rank")
    return out.select("query_id", "chunk_id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "fused_score", "rerank_score", "rank")


def beyond_stage(results: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results that lie after the asker's stage: an audit that has to be empty."""
    seen = results.join(queries.select("query_id", F.col("stage_order").alias("asked")), "query_id").join(chunks.select("chunk_id", "stage_order"), "chunk_id")
    return seen.where("stage_order > asked")
