"""Sharding by a two-pass external shuffle, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, new_path


def _draws(id_col: str, shards: int, seed: int) -> Column:
    hashes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.col(id_col), i, F.lit(seed)).alias("h"), i.alias("i")))
    return F.array_max(hashes)


def _scattered(docs: DataFrame, own: list[str], shards: int, id_col: str, text_col: str, seed: int) -> DataFrame:
    """shard and grown_shard of each row, its bytes, a seeded hash of id and text (mixed), and the row itself."""
    new = F.struct(F.xxhash64(F.col(id_col), F.lit(shards), F.lit(seed)), F.lit(shards))
    placed = docs.select(
        _draws(id_col, shards, seed).alias("top"),
        new.alias("new"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("bytes"),
        F.xxhash64(F.col(id_col), F.xxhash64(text_col), F.lit(seed + 1)).alias("mixed"),
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"),
    )
    return placed.select(F.col("top.i").alias("shard"), F.when(F.col("new") > F.col("top"), F.lit(shards)).otherwise(F.col("top.i")).alias("grown_shard"), "bytes", "mixed", "row")


def _small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= most else table


def _with_buckets(rows: DataFrame, bucket_bytes: int, seed: int) -> DataFrame:
    """``rows`` with bucket: a shard has one for each ``bucket_bytes`` it holds, and a seeded hash picks it.

    nth counts the buckets of all shards in order, of which there are ``all``.
    Rows that agree in id and text have one hash. Where they alone fill a
    bucket, they are dealt over all buckets of their shard by their place in the
    input; such rows are alike, but which of them comes first may then change
    with the input's files.
    """
    alike = cut(rows.groupBy("shard", "mixed").agg(F.sum("bytes").alias("bytes")))
    per = alike.groupBy("shard").agg(F.greatest(F.lit(1), F.round(F.sum("bytes") / bucket_bytes)).cast("long").alias("buckets"))
    shards = W.partitionBy(F.lit(0))
    before = shards.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumns({"before": F.coalesce(F.sum("buckets").over(before), F.lit(0)), "all": F.sum("buckets").over(shards)})
    heavy = cut(alike.where(F.col("bytes") > bucket_bytes).select("mixed", F.lit(True).alias("heavy")).distinct())
    rows = rows.join(F.broadcast(cut(per)), "shard")
    place = F.xxhash64(F.lit(seed + 2), "mixed")
    if not heavy.isEmpty():
        rows = rows.withColumn("at", F.monotonically_increasing_id()).join(_small(heavy), "mixed", "left")
        place = F.when(F.col("heavy"), F.xxhash64(F.lit(seed + 3), "at")).otherwise(place)
    bucket = F.pmod(place, F.col("buckets")).cast("int")
    return rows.select("shard", bucket.alias("bucket"), (F.col("before") + bucket).alias("nth"), "all", "grown_shard", "mixed", "row")


def _in_drawn_order(dealt: DataFrame, seed: int) -> DataFrame:
    """shard, bucket, __at, grown_shard, row: the rows of each bucket in an order that is Fisher-Yates shuffled (``shuffle``).

    Rows are sorted and numbered, never gathered in an array, so that sorts may
    spill. What is shuffled are a bucket's numbers: its first row is followed by
    them, each with its new place, as rows that hold nothing else; sorted by
    number, each stands next to the row that it is for. ``dealt`` has whole
    buckets in its partitions, by ``task``.
    """
    bucket = W.partitionBy("nth", "task")
    numbered = dealt.withColumn("number", F.row_number().over(bucket.orderBy("mixed", "row"))).withColumn("n", F.count(F.lit(1)).over(bucket).cast("int"))
    draws = F.when(F.col("number") == 1, F.shuffle(F.sequence(F.lit(1), F.col("n")), F.lit(seed))).otherwise(F.array().cast("array<int>"))
    lined = numbered.select("nth", "task", "shard", "bucket", "number", "grown_shard", "row", F.posexplode(F.concat(F.array(F.lit(0)), draws)).alias("place", "of"))
    own = F.col("place") == 0
    lined = lined.select("nth", "task", "shard", "bucket", F.when(own, F.col("number")).otherwise(F.col("of")).alias("number"), "place", F.when(own, F.col("grown_shard")).alias("grown_shard"), F.when(own, F.col("row")).alias("row"))
    placed = lined.withColumn("__at", F.lead("place").over(bucket.orderBy("number", "place")) - 1).where(own)
    return placed.select("shard", "bucket", "__at", "grown_shard", "row").sortWithinPartitions("shard", "bucket", "__at")


def shuffle_to_shards(docs: DataFrame, path: str | None = None, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, task_bytes: int = 64 << 20, seed: int = 17) -> DataFrame:
    """Write the documents to ``path``, a folder per shard, and read them back.

    The columns of ``docs`` and: shard, grown_shard, bucket, slot. A column of
    ``docs`` with one of these names, in upper or lower case, is overwritten.

    *First pass*: a document's shard is that of the highest of ``shards`` seeded
    hashes of its id, so id and shard count decide, and with one more shard
    (grown_shard) rows only move into the new one. Within its shard a seeded
    hash of id and text scatters it uniformly into buckets of about
    ``bucket_bytes``. A task of about ``task_bytes`` takes buckets that follow
    each other, so there are fewer files than tasks and shards. *Second pass*:
    each bucket is put in order of its seeded hashes, Fisher-Yates shuffled
    (``shuffle``) by the numbers of its rows and written; sorts spill, and only
    the numbers of one bucket are an array. Slots count through a shard's buckets
    from 0 without gaps.

    The number of tasks follows from the bytes alone, tasks take buckets in
    order, and ``shuffle`` draws by task, so reruns agree, also after a lost
    task and for other partitions of the input.

    Null ids share one shard; null texts have no bytes; a text longer than a
    bucket is a bucket's only long one or makes it as long; equal rows stay rows
    of their own; an empty table gives an empty table. Columns must be of types
    that have an order (no maps).
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "shards")
    own = [c for c in docs.columns if c.lower() not in ("shard", "grown_shard", "bucket", "slot", "__at")]
    scattered = _with_buckets(_scattered(docs, own, shards, id_col, text_col, seed), bucket_bytes, seed)
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 16)).first()[0] or 0
    tasks = max(shards, -(-total // task_bytes))
    dealt = scattered.withColumn("task", F.floor(F.col("nth") * tasks / F.col("all")).cast("int")).drop("all").repartitionById(tasks, "task")
    shuffled = _in_drawn_order(dealt, seed)
    shuffled.select("shard", "bucket", "__at", "grown_shard", *[F.col(f"row.`{c}`") for c in own]).write.partitionBy("shard").parquet(path)
    kinds = {f.name: f for f in docs.schema.fields}
    full = StructType(StructType.fromDDL("bucket int, __at int, grown_shard int").fields + [kinds[c] for c in own] + StructType.fromDDL("shard int").fields)
    written = spark.read.schema(full).parquet(path)
    counts = written.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    return written.join(_small(offsets), ["shard", "bucket"]).withColumn("slot", F.col("__at").cast("long") + F.col("offset")).select(*own, "shard", "grown_shard", "bucket", "slot")
