"""BM25 over candidate pools, normalising, fusing and reranking of scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept, top
from ..functions.text import tokens


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, times: the different terms of each query's text."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def bm25_weight(k1: float, b: float) -> Column:
    """What one asked term adds: from tf, df, len, docs and mean. A mean length of 0 counts as 1."""
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    return idf * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean)))


def bm25(queries: DataFrame, pool: DataFrame, k1: float = 1.5, b: float = 0.75, corpus: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score of the candidates ``pool`` (query_id, chunk_id, text) for ``queries`` (query_id, text).

    Document counts and mean length are those of the query's own pool, or of
    ``corpus`` (chunk_id, text) if given. A query's repeated terms count as
    often as they stand in it; candidates without any of them are left out. A
    mean length of 0 counts as 1. With ``texts`` (chunk_id, text) the pool needs no texts of its own, and a
    chunk of several pools is taken apart once.

    Of a candidate's tokens only those that its query asks for become rows, and one row more, without a
    term, for its length.
    """
    terms = query_terms(queries)
    names = terms.groupBy("query_id").agg(F.collect_list("term").alias("names"))
    if texts is None:
        cut = pool.select("query_id", "chunk_id", tokens(F.col("text")).alias("tokens"))
    else:
        wanted = texts.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi").repartition("chunk_id")
        cut = pool.select("query_id", "chunk_id").join(wanted.select("chunk_id", tokens(F.col("text")).alias("tokens")), "chunk_id")
    length = F.array(F.lit(None).cast("string"))
    hits = cut.join(names, "query_id").select("query_id", "chunk_id", F.size("tokens").alias("len"), F.explode(F.concat(F.filter("tokens", lambda t: F.array_contains("names", t)), length)).alias("term"))
    tf = hits.groupBy("query_id", "chunk_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    if corpus is None:
        # All that follows goes by query: one exchange.
        own, of_term = W.partitionBy("query_id"), W.partitionBy("query_id", "term")
        is_length = F.col("term").isNull()
        counted = tf.withColumns({"docs": F.count(F.when(is_length, 1)).over(own), "mean": F.avg(F.when(is_length, F.col("len"))).over(own), "df": F.count(F.lit(1)).over(of_term)}).join(terms, ["query_id", "term"])
    else:
        # One pass: every chunk gives its length, without a term, and each of its terms once; those not asked for go.
        whole = corpus.select(tokens(F.col("text")).alias("tokens")).select(F.size("tokens").alias("len"), F.explode(F.concat(F.array_distinct("tokens"), length)).alias("term"))
        asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
        found = kept(whole.join(asked, "term", "left").where("term is null or asked").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.avg("len").alias("mean")))
        stats = found.where("term is null").first()
        docs, mean = (stats.df, stats["mean"]) if stats else (0, 0.0)
        counted = tf.join(terms, ["query_id", "term"]).join(found.select("term", "df"), "term").withColumns({"docs": F.lit(docs), "mean": F.lit(mean)})
    return counted.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * bm25_weight(k1, b)).alias("score")).where("score <> 0")


def min_max(scores: DataFrame, by: list[str], score: str = "score", out: str = "norm") -> DataFrame:
    """Scores from 0 to 1 in each group; 0.5 for all of a group in which they are equal."""
    w = W.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    norm = F.when(F.col("__high") > F.col("__low"), (F.col(score) - F.col("__low")) / (F.col("__high") - F.col("__low"))).otherwise(0.5)
    return scores.withColumns({"__low": low, "__high": high}).withColumn(out, norm).drop("__low", "__high")


def fuse(scores: DataFrame, weights: dict[str, float], keep: str | None = None) -> DataFrame:
    """query_id, chunk_id, fused_score: weighted sum over routes (query_id, chunk_id, route, norm); a missing route is 0.

    The column ``keep`` of each route, if named, comes along as ``{route}_{keep}``, null where the route is missing.
    """
    known = scores.where(F.col("route").isin(*weights))
    weight = F.coalesce(*[F.when(F.col("route") == r, F.lit(float(w))) for r, w in weights.items()])
    own = [F.max(F.when(F.col("route") == r, F.col(keep))).alias(f"{r}_{keep}") for r in weights] if keep else []
    return known.groupBy("query_id", "chunk_id").agg(F.sum(F.col("norm") * weight).alias("fused_score"), *own)


def fuse_lists(maps: list[DataFrame], weights: list[float]) -> DataFrame:
    """The same for one table (query_id, chunk_id, norm) a route; as many weights as routes are needed."""
    if len(maps) != len(weights):
        raise ValueError("each route needs a weight")
    rows = None
    for i, m in enumerate(maps):
        part = m.select("query_id", "chunk_id", F.lit(str(i)).alias("route"), "norm")
        rows = part if rows is None else rows.unionByName(part)
    return fuse(rows, {str(i): w for i, w in enumerate(weights)})


def rerank(candidates: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """``candidates`` (query_id, chunk_id, ...) with rerank_score and rerank_rank, the best ``k`` of each query.

    ``relevance`` (query_id, chunk_id, relevance) comes from outside; a pair
    that it lacks is not ranked. Equal ones come by chunk_id.
    """
    scored = candidates.join(relevance.select("query_id", "chunk_id", F.col("relevance").cast("double").alias("rerank_score")), ["query_id", "chunk_id"])
    return top(scored, ["query_id"], [F.desc("rerank_score"), F.col("chunk_id")], k, "rerank_rank")


def score_pairs(pairs: DataFrame, score_fn: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """query_id, chunk_id, relevance of pairs (query_id, chunk_id, query_text, text) by a given model, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["query_id", "chunk_id"]].assign(relevance=score_fn(f).astype(float))

    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, relevance double")


def relevance_of(replies: DataFrame, raw: str = "raw") -> DataFrame:
    """query_id, index, relevance from a rerank service's replies, results at the top or under ``output``."""
    kind = "array<struct<index: int, relevance_score: double>>"
    found = F.coalesce(F.from_json(raw, f"results {kind}")["results"], F.from_json(raw, f"output struct<results: {kind}>")["output"]["results"])
    return replies.select("query_id", F.explode(found).alias("r")).select("query_id", F.col("r.index").alias("index"), F.col("r.relevance_score").alias("relevance"))
