"""Exact deduplication with a log-structured merge index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_group, bit_filter, cut, pass_filter


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in " \n\t\r\x0b\x0c":
        out = F.replace(out, F.lit(c))
    return out


def _best() -> Column:
    """Which of equal texts stays: most code points, then the smallest id, null last."""
    return F.struct((-F.col("n")).alias("order"), F.col("id").isNull().alias("none"), "id")


def _flush(members: DataFrame, runs: int) -> DataFrame:
    """The runs: of each memtable (a hash of the id decides) one entry a digest, one file a run, sorted by digest."""
    tables = members.withColumn("run", F.pmod("spread", F.lit(runs)).cast("int")).repartition(runs, "run")
    return cut(tables.groupBy("run", "digest").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("size")).sortWithinPartitions("run", "digest"))


def _filters(flushed: DataFrame, bits: int) -> DataFrame:
    """The filter of each run, a bitmap of its digests: (run, word, mask)."""
    at = F.pmod(F.xxhash64("digest"), F.lit(1 << bits))
    return flushed.select("run", at.alias("at")).groupBy("run", F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))


def _hits(flushed: DataFrame, bits: int) -> DataFrame:
    """The entries whose digest may be in another run too, by all runs' filters, or that stand for several rows.

    A digest that the filters of two runs have is looked up; all others are in
    one run for certain. What is broadcast has 2**bits / 64 rows at most.
    """
    start = F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice"))

    def merge(seen: Column, mask: Column) -> Column:
        return F.struct(seen["once"].bitwiseOR(mask).alias("once"), seen["twice"].bitwiseOR(seen["once"].bitwiseAND(mask)).alias("twice"))

    twice = cut(_filters(flushed, bits).groupBy("word").agg(F.aggregate(F.collect_list("mask"), start, merge)["twice"].alias("mask")).where("mask <> 0"))
    placed = flushed.withColumn("at", F.pmod(F.xxhash64("digest"), F.lit(1 << bits))).withColumn("word", F.shiftright("at", 6))
    probed = placed.join(F.broadcast(twice), "word", "left")
    return cut(probed.where(F.expr("size > 1 or coalesce(shiftright(mask, cast(at & 63 as int)) & 1, 0) = 1")).select("run", "digest", "best", "size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 1_000_000, filter_bits: int = 23, digest_bits: int = 256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal once normalised, the row with the most code points
    in its original text stays, then the smallest id. A null text is empty, a
    long one counts whole; a null id comes after all others; rows that share an
    id are one document, and all of them carry the same answer. Ids may be of
    any type that has an order; other columns of ``docs`` are not used, whatever
    their names. An empty table gives an empty table.

    *Memtables and runs*: rows are dealt over memtables of about
    ``memtable_rows`` rows; each is reduced to one entry a digest and flushed as
    a run in order of its digests. *Filters*: each run has a bitmap of its
    digests. A digest is looked up in other runs only if the filters of two runs
    have it. *Compaction*: the hits of all runs are merged by digest and the best
    entry of each is kept. *Verification*: the texts behind digests that are
    held more than once are grouped by their bytes; only if one digest has two
    texts (which takes a collision; ``digest_bits`` makes them likely in tests)
    are its documents grouped by text instead.
    """
    raw = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = _digested(raw, digest_bits)
    members = cut(texts.select("id", "n", "digest", *(["sha"] if digest_bits < 256 else []), F.xxhash64("id").alias("spread")))
    runs = max(4, -(-members.count() // memtable_rows))
    hits = _hits(_flush(members, runs), filter_bits)
    merged = cut(hits.groupBy("digest").agg(F.min("best").alias("best"), F.sum("size").alias("size")).where("size > 1"))

    run = F.pmod("spread", F.lit(runs)).cast("int")
    held = hits.select("digest", "run").join(merged, "digest")
    placed = cut(members.withColumn("run", run).join(held, ["digest", "run"], "left").withColumns({"best": F.coalesce("best", _best()), "size": F.coalesce("size", F.lit(1).cast("long"))}))
    words = cut(bit_filter(placed.where("size > 1").select("id"), "id", filter_bits))
    suspects = _digested(pass_filter(raw, "id", words, filter_bits), digest_bits)
    variants = suspects.groupBy("digest", "__norm").agg(F.count(F.lit(1)).alias("size")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    collided = cut(variants.where("texts > 1").select("digest"))

    def answer(rows: DataFrame) -> DataFrame:
        sha = F.lower(F.hex("digest")) if digest_bits == 256 else F.col("sha")
        keep = F.col("best.id")
        return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.col("size").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), sha.alias("text_sha256"))

    if collided.isEmpty():
        return answer(placed)
    again = texts.join(collided, "digest", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    exact = attach_group(again, ["digest", "__norm"], "salt", {"best": F.min(_best()), "size": F.count(F.lit(1))}, {"best": F.min("best"), "size": F.sum("size")})
    return answer(placed.join(collided, "digest", "left_anti")).unionByName(answer(exact))


def _digested(rows: DataFrame, digest_bits: int) -> DataFrame:
    """(id, text) with n, __norm and digest; a shortened digest comes with the whole one as sha."""
    texts = rows.select("id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), normalised(F.col("text")).alias("__norm"))
    whole = F.sha2("__norm", 256)
    if digest_bits == 256:
        return texts.withColumn("digest", F.unhex(whole))
    return texts.withColumn("sha", whole).withColumn("digest", F.substring(F.unhex("sha"), 1, max(1, digest_bits // 8)))
