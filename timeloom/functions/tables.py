"""Helpers for tables that are used more than once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder stands in where the setting is missing and all tasks run
    in the driver, as in tests; a cluster without it is refused.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timeloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_written: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the table there, which outlives executors.

    Unlike a checkpoint, the table tells the optimiser its true size, so later
    joins are planned by it; it goes when the driver ends.
    """
    spark = df.sparkSession
    path = new_path(spark, "kept")
    if not _written:
        atexit.register(_clear, spark)
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _clear(spark: SparkSession) -> None:
    """Remove what ``kept`` has written, if there still is a session to do it."""
    with contextlib.suppress(Exception):
        for path in _written:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def top(rows: DataFrame, by: list[str], order: list, k, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def refuse(rows: DataFrame, what: str, show: list[str]) -> None:
    """An error that names the first of ``rows``, if there is any."""
    first = rows.select(*show).limit(3).collect()
    if first:
        raise ValueError(f"{what}: " + ", ".join(str(tuple(r)) for r in first))
