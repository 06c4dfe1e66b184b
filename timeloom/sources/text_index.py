"""A stored inverted index of chunk texts for BM25 with the counts of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import kept
from ..functions.text import tokens
from ..operators.ranking import bm25_weight, query_terms
from .store import Store

#: Most pairs of a candidate and an asked term that go to all tasks.
FEW = 1 << 19


class TextIndex:
    """Postings of chunks under ``path``; texts are tokenised when they come in and never again.

    Tables (``Store``): ``postings`` (term, chunk_id, tf) by term, so a question reads the buckets of its
    terms, and ``forward`` (chunk_id, len, terms) by chunk, which tells an upsert the terms whose buckets it
    has to touch. Ids are unique; a chunk without tokens counts as a document of length 0.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.postings = Store(spark, f"{path}/postings", ["term"], buckets)
        self.forward = Store(spark, f"{path}/forward", ["chunk_id"], buckets)

    @staticmethod
    def _counted(texts: DataFrame) -> DataFrame:
        """term, chunk_id, tf. Texts are dealt by chunk before they are taken apart, so tokens themselves are not shuffled."""
        words = texts.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", F.explode(tokens(F.col("text"))).alias("term"))
        return words.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("tf")).select("term", "chunk_id", "tf")

    @staticmethod
    def _forward(texts: DataFrame) -> DataFrame:
        words = texts.select("chunk_id", "text").repartition("chunk_id").select("chunk_id", tokens(F.col("text")).alias("words"))
        return words.select("chunk_id", F.size("words").cast("long").alias("len"), F.array_distinct("words").alias("terms"))

    def build(self, texts: DataFrame) -> TextIndex:
        """Index ``texts`` (chunk_id, text) in place of what is there."""
        self.postings.replace(self._counted(texts))
        self.forward.replace(self._forward(texts))
        return self

    def upsert(self, texts: DataFrame) -> set[int]:
        """Texts in place of those of the same chunks, others added; the buckets of terms rewritten.

        Postings change before ``forward``, so an upsert that was cut short finds the same old terms again.
        """
        new = kept(self._counted(texts))
        changed = self._swap(texts.select("chunk_id"), new)
        self.forward.upsert(self._forward(texts))
        return changed

    def remove(self, ids: DataFrame) -> set[int]:
        changed = self._swap(ids.select("chunk_id"), self.postings.read().where("false"))
        self.forward.remove(ids.select("chunk_id"))
        return changed

    def _swap(self, ids: DataFrame, new: DataFrame) -> set[int]:
        hit = {r.b for r in ids.select(self.forward.bucket().alias("b")).distinct().collect()}
        old = self.forward.read(buckets=hit).join(ids.distinct(), "chunk_id").select(F.explode("terms").alias("term"), "chunk_id", F.lit(None).cast("long").alias("tf"))

        def put(rows: DataFrame, changes: DataFrame) -> DataFrame:
            left = rows.join(changes.select("chunk_id").distinct(), "chunk_id", "left_anti")
            return left.unionByName(changes.where("tf is not null"))

        return self.postings.merge(old.unionByName(new), put)

    def bm25(self, queries: DataFrame, pool: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """query_id, chunk_id, score of the candidates ``pool`` (query_id, chunk_id), as ``ranking.bm25`` with this corpus gives.

        Only the buckets of asked terms are read: counted by term, and joined with the pairs of a candidate and a term.
        """
        terms = kept(query_terms(queries))
        asked = terms.select("term").distinct()
        hit = {r.b for r in asked.select(self.postings.bucket().alias("b")).distinct().collect()}
        stored = self.postings.read(buckets=hit)
        df = stored.join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        stats = self.forward.read().agg(F.count(F.lit(1)).alias("docs"), F.avg("len").alias("mean")).first()
        pairs = kept(pool.select("query_id", "chunk_id").join(self.forward.read().select("chunk_id", "len"), "chunk_id").join(terms, "query_id"))
        # Postings stay where they are while the pairs are few; both are dealt by term and chunk beyond that.
        hits = stored.join(F.broadcast(pairs), ["term", "chunk_id"]) if pairs.count() <= FEW else stored.hint("merge").join(pairs, ["term", "chunk_id"])
        scored = hits.join(df, "term").withColumns({"docs": F.lit(stats.docs), "mean": F.lit(stats.mean)})
        return scored.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * bm25_weight(k1, b)).alias("score")).where("score <> 0")
