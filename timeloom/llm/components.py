"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group, cut


def _stars(pairs: DataFrame, salts: int) -> DataFrame:
    """Rows (u, v) with the smallest v of each u as ``least``, however many v a u has."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)))
    return attach_group(salted, ["u"], "salt", {"least": F.min("v")}, {"least": F.min("least")}).withColumn("least", F.least("u", "least"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node at most, and none on a node that itself hangs on another."""
    ends = edges.select("u", F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1").isEmpty()


def components(links: DataFrame, salts: int = 32) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``links`` (a, b).

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest neighbour, until all hang on a root; the rounds grow with the logarithm
    of the longest chain. Self links and repeated links are allowed. Links stay
    in tables all the way.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, salts).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        small = _stars(large, salts)
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nodes.unionByName(roots)
