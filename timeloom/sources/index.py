"""Collections: index tables of chunks with their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rebuild(rows: DataFrame, path: str, partition: str = "stage_order") -> DataFrame:
    """Drop the collection at ``path`` and write it anew; the counts of what was written."""
    rows.write.mode("overwrite").partitionBy(partition).parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy(partition).agg(F.count(F.lit(1)).alias("chunks"))


def upsert(collection: DataFrame, changes: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The collection with changed rows in place of old ones and new ones added; keys of changes are unique.

    One join on the key, for tables at hand; a stored collection that takes small changes is a ``Store``, which
    rewrites only the buckets that they touch.
    """
    columns = collection.columns
    new = changes.select(key, F.struct(*[c for c in columns if c != key]).alias("__new"))
    both = collection.select(key, F.struct(*[c for c in columns if c != key]).alias("__old")).join(new, key, "full_outer")
    one = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("__old"))
    return both.select(key, one.alias("__row")).select(key, "__row.*").select(*columns)


def remove(collection: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return collection.join(ids.select(key), key, "left_anti")
