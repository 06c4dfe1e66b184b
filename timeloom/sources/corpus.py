"""Texts, profiles, chunks and embedding exchange files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.schemas import PROFILE_FILE, PROFILE_KEYS
from ..functions.tables import kept
from ..functions.text import LINE_END


class BadRows(ValueError):
    """Input rows that do not have the agreed form."""


def _refuse(bad: DataFrame, what: str) -> None:
    first = bad.limit(3).collect()
    if first:
        raise BadRows(f"{what}: " + "; ".join(str(tuple(r)) for r in first))


def read_texts(spark: SparkSession, paths: str | list[str], **provenance: str) -> DataFrame:
    """One row per text file: doc_id (its path), text, file, and the given columns (source, work ...)."""
    files = spark.read.text(paths, wholetext=True).select("*", F.col("_metadata.file_path").alias("file"))
    return files.select(F.col("file").alias("doc_id"), F.col("value").alias("text"), "file", *[F.lit(v).alias(k) for k, v in provenance.items()])


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (the file's path), line_no, raw: text files line by line, a large file by many tasks.

    line_no is a struct that orders a file's lines: the start of the split, the
    row in its task, and the place between rarer line ends inside the row. A
    byte order mark at a file's beginning is no part of its first line.
    """
    rows = spark.read.text(paths).select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    pieces = F.posexplode(F.split("value", LINE_END)).alias("at", "raw")
    return rows.select("doc_id", "block", "row", pieces).select("doc_id", F.struct("block", "row", "at").alias("line_no"), "raw")


def read_profiles(spark: SparkSession, path: str, pattern: str = "*_temporal_persona_skill.jsonl", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Profile rows of all JSON-lines files under ``path``, and the lines that are no JSON.

    Both tables tell file and row_number, the line in its file from 1; blank
    lines count but are skipped. With ``strict`` a malformed line is an error
    that names its file, number and text; otherwise it is in the second table
    (file, row_number, row). A profile file describes one entity and is read
    whole by one task.
    """
    files = spark.read.option("pathGlobFilter", pattern).option("wholetext", True).text(path).select(F.col("value").alias("whole"), F.col("_metadata.file_path").alias("file"))
    lines = files.select("file", F.posexplode(F.split("whole", "\r\n|\n")).alias("row_number", "value")).withColumn("row_number", F.col("row_number") + 1).where(F.regexp_replace("value", r"(?U)\s+", "") != "")
    parsed = lines.withColumn("r", F.from_json("value", PROFILE_FILE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = parsed.where("r is null or r._corrupt is not null").select("file", "row_number", F.col("value").alias("row"))
    if strict:
        _refuse(bad, "invalid profile rows")
    good = parsed.where("r is not null and r._corrupt is null")
    plain = [F.col(f"r.{c}") for c in ("skill_id", "record_type", "character", "stage_id", "stage_name", "stage_order")]
    return good.select("file", "row_number", *plain, *[F.col(f"r.`{key}`").alias(name) for name, key in PROFILE_KEYS.items()]), bad


def read_chunks(spark: SparkSession, path: str, metadata: str = "map<string,string>", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Chunk rows (chunk_id, text, metadata) of JSON lines, and rows whose text is no string or metadata no object."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    kind = F.schema_of_variant
    v = lines.withColumn("v", F.try_parse_json("value"))
    good = F.coalesce(kind(F.try_variant_get("v", "$.text", "variant")) == "STRING", F.lit(False)) & F.coalesce(F.startswith(kind(F.try_variant_get("v", "$.metadata", "variant")), F.lit("OBJECT")), F.lit(False))
    bad = v.where(~good).select(F.col("value").alias("row"))
    if strict:
        _refuse(bad, "invalid chunk rows")
    row = F.from_json("value", f"chunk_id string, text string, metadata {metadata}")
    return v.where(good).select(row.alias("r")).select("r.*"), bad


def write_chunks(chunks: DataFrame, path: str, columns: list[str], collection: str | None = None) -> DataFrame:
    """Write {chunk_id, text, metadata} lines; the counts by collection of what was written."""
    shaped = chunks.select("chunk_id", "text", F.struct(*columns).alias("metadata"), *([F.col(collection).alias("collection")] if collection else []))
    writer = shaped.write.mode("overwrite")
    (writer.partitionBy("collection") if collection else writer).json(path)
    written = chunks.sparkSession.read.schema(shaped.schema).json(path)
    return (written if collection else written.withColumn("collection", F.lit("all"))).groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def write_profiles(profiles: DataFrame, path: str) -> None:
    """Profile rows as JSON lines under the keys of the format."""
    names = [F.col(c) for c in ("skill_id", "record_type", "character", "stage_id", "stage_name", "stage_order")]
    profiles.select(*names, *[F.col(c).alias(k) for c, k in PROFILE_KEYS.items()]).write.mode("overwrite").json(path)


def clean_metadata(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Scalars as they are, null as the empty text, lists, maps and structs as JSON text."""
    out = {}
    for c in columns:
        kind = dict(frame.dtypes)[c]
        if kind.startswith(("array", "map", "struct")):
            out[c] = F.coalesce(F.to_json(c), F.lit(""))
        elif kind == "string":
            out[c] = F.coalesce(F.col(c), F.lit(""))
        else:
            out[c] = F.coalesce(F.col(c).cast("string"), F.lit(""))
    return frame.withColumns(out)


def number_lines(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with line_index from 0 in the order of a unique column.

    Rows are counted by ranges of the order first, and the counts (a row per
    range) added up, so no task sees all rows.
    """
    # Ranges come from a sample, so they are written down before they are used twice.
    ranged = kept(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    ends = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = W.partitionBy("__part").orderBy(order)
    return ranged.join(offsets, "__part").withColumn("line_index", (F.col("__before") + F.row_number().over(within) - 1).cast("long")).drop("__part", "__before")


def embedding_lines(chunks: DataFrame, order: str = "chunk_id", text: str = "text") -> DataFrame:
    """line_index, chunk_id, line: one line of text a chunk, its line ends as blanks."""
    return number_lines(chunks.select("chunk_id", order, F.regexp_replace(text, r"[\r\n]", " ").alias("line")) if order != "chunk_id" else chunks.select("chunk_id", F.regexp_replace(text, r"[\r\n]", " ").alias("line")), order)


def write_embedding_lines(lines: DataFrame, path: str) -> int:
    """Write the lines in order, files named in the order of their lines; how many were written."""
    lines.repartitionByRange("line_index").sortWithinPartitions("line_index").select("line").write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).count()


def read_vectors(results: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows (line_index, embedding) of embedding replies in any of their four forms, and the rows in none."""
    forms = [
        F.from_json(raw, "embedding array<double>")["embedding"],
        F.from_json(raw, "output struct<embedding: array<double>>")["output"]["embedding"],
        F.get(F.from_json(raw, "embeddings array<struct<embedding: array<double>>>")["embeddings"], F.lit(0))["embedding"],
        F.get(F.from_json(raw, "embeddings array<array<double>>")["embeddings"], F.lit(0)),
    ]
    read = results.withColumn("embedding", F.coalesce(*forms))
    return read.where("embedding is not null").drop(raw), read.where("embedding is null").drop("embedding")


def attach_vectors(lines: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks and vectors of the same line. Unequal counts, gaps and repeats are errors."""
    a, b = (f.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("line_index").alias("d"), F.min("line_index").alias("low"), F.max("line_index").alias("high")).first() for f in (lines, vectors))
    if a != b or a.n != a.d or (a.n and a.high - a.low + 1 != a.n):
        raise BadRows(f"lines and vectors differ: {tuple(a)} and {tuple(b)}")
    return lines.join(vectors, "line_index")
