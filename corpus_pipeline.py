"""A training corpus from raw documents: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timeloom.llm import langid
from timeloom.llm.common import new_path, table
from timeloom.llm.decontaminate import decontaminate
from timeloom.llm.minhash import keep_one
from timeloom.llm.mixing import mix
from timeloom.llm.sharding import shuffle_to_shards


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and drops those without any language."""
    return langid.keep_known(docs, langid.train(docs.select("text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies: shingles of five words, similarity 0.8."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that repeat ten words of a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents as often as its share asks for."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the shards; a row for each document taken, with its shard and slot."""
    return shuffle_to_shards(docs).drop("bucket", "grown_shard")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("sharding", sharding)]

#: The stages learn, hash and draw in ways that SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are left after all stages, as often as the mixture takes them, with shard and slot.

    A document without text or letters has no language and goes. Without an id
    a document stays as it is; rows that share one are documents of their own,
    of which near_dedup drops only near copies.
    Texts of any length are read whole; an empty table gives an empty table.
    Stages keep all columns of documents, whatever their names (sharding's own
    are overwritten).
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
