"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept, new_path

#: Lineage is cut with a table written to the shared folder.
cut = kept

__all__ = ["attach_group", "bit_filter", "cut", "new_path", "pass_filter", "running_numbers", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach_group(members: DataFrame, key: list[str], salt: str, partial: dict[str, Column], total: dict[str, Column]) -> DataFrame:
    """Give every row of ``members`` the aggregates of its group.

    Groups may hold a third of all rows, so nothing is dealt by ``key`` alone
    while it still has a row for each member: rows are first reduced by
    (key, salt), these by key, and the result goes back the same way. ``total``
    is written over the columns of ``partial``. Null keys form no group.
    """
    pieces = members.groupBy(*key, salt).agg(*[c.alias(n) for n, c in partial.items()])
    groups = pieces.groupBy(*key).agg(*[c.alias(n) for n, c in total.items()])
    return members.join(pieces.select(*key, salt).join(groups, key), [*key, salt])


def bit_filter(keys: DataFrame, column: str, bits: int) -> DataFrame:
    """A Bloom-style bitmap of ``column`` as (word, mask): at most 2**bits / 64 rows."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    return (
        keys.select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).alias("__word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("__mask"))
    )


def pass_filter(rows: DataFrame, column: str, words: DataFrame, bits: int) -> DataFrame:
    """The rows whose key may be in the filter: all true ones, and a few others.

    Only the bitmap is broadcast, and ``bits`` bounds it whatever the input; a
    full bitmap lets all rows through, and a later join is exact in any case.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    return (
        rows.withColumn("__at", at)
        .withColumn("__word", F.shiftright("__at", 6))
        .join(F.broadcast(words), "__word")
        .where(F.expr("shiftright(__mask, cast(__at & 63 as int)) & 1") == 1)
        .drop("__word", "__mask", "__at")
    )


def running_numbers(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``rows`` numbered from 1 in order of ``keys``, which tell all rows apart.

    Rows are dealt by ranges of the keys and sorted there; a range's rows are numbered on their own and
    lifted by the sum of the ranges before it, so no task sees all rows: only one number a range is summed up.
    """
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id())
    placed = cut(sorted_rows.withColumns({"__range": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__range").withColumn(out, F.col("__start") + F.col("__at") + 1).drop("__range", "__at", "__start")
