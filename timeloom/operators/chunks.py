"""Documents to titled sections to overlapping chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import kept, refuse
from ..functions.text import contains_any, mentions, padded, piped, split_lines, strip

#: Heading kinds in the order in which a line is tried against them.
KINDS = ("book", "part", "prologue", "chapter")


def classify_lines(docs: DataFrame, headings: dict[str, str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no, line (without white space at its ends), kind: a heading's, or null for body.

    ``headings`` maps kinds to patterns that a line has to begin with.
    """
    return _kinds(docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(split_lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "raw")), headings)


def _kinds(lines: DataFrame, headings: dict[str, str]) -> DataFrame:
    kind = F.coalesce(*[F.when(F.rlike("line", F.lit(f"(?U)^(?:{headings[k]})")), F.lit(k)) for k in KINDS if k in headings], F.lit(None).cast("string"))
    return lines.withColumn("line", strip(F.col("raw"))).drop("raw").withColumn("kind", kind)


def _openings() -> dict[str, Column]:
    """What a line says of the book and the part from there on, null if nothing; a struct keeps a reset's null inside."""
    line = F.struct(F.col("line").alias("v"))
    reset = F.struct(F.lit(None).cast("string").alias("v"))
    return {"book": F.when(F.col("kind") == "book", line), "part": F.when(F.col("kind").isin("book", "prologue"), reset).when(F.col("kind") == "part", line)}


def _bodies(marked: DataFrame, least: int) -> DataFrame:
    """doc_id, section, book, part, title, body of the sections that stay, from lines with section, book and part."""
    title = F.max(F.when(F.col("kind").isNotNull(), F.col("line")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    whole = marked.groupBy("doc_id", "section").agg(F.first("book").alias("book"), F.first("part").alias("part"), title.alias("title"), body.alias("joined")).withColumn("body", strip(F.col("joined"))).drop("joined")
    return whole.where((F.col("body") != "") & (F.col("title").isNull() | (F.char_length("body") >= least)))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "section_index", "book", "part", F.coalesce("title", F.lit("front_matter")).alias("section_title"), "body")


def sections(docs: DataFrame, headings: dict[str, str], least: int = 500, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, section_index, book, part, section_title, body.

    A heading opens a section and is its title; a book resets the part, and so
    does a prologue. Sections without a body go, and so do titled ones with
    fewer than ``least`` characters; what stands before any heading is
    ``front_matter`` and stays at any length. section_index counts from 1.
    A document's lines are one task's; for files too large for that there is
    ``sections_of_lines``.
    """
    lines = classify_lines(docs, headings, doc_id, text)
    so_far = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    opened = {c: F.last(v, ignorenulls=True).over(so_far)["v"] for c, v in _openings().items()}
    marked = lines.withColumns({"section": F.count("kind").over(so_far), **opened})
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("section"))
    return _shaped(_bodies(marked, least).withColumn("section_index", index))


def section_bodies(lines: DataFrame, headings: dict[str, str], least: int = 500, segment: Column | None = None, ranges: int | None = None) -> DataFrame:
    """doc_id, section, book, part, title, body from lines (doc_id, line_no, raw) of documents of any length.

    A scan in segments: each part of a document counts its headings and tells
    the last book and part, and what the parts before it say goes with its lines
    as one more row, so a segment's lines, one section's lines and narrow rows of a
    document's segments are all that meet in a task. ``segment`` says which part
    a line is in, in the order of line_no, as ``line_no.block`` does for
    ``read_lines``; without it lines are dealt over ranges of (doc_id, line_no),
    as many as ``ranges`` says or Spark finds fit, which writes them once more.

    (doc_id, line_no) is a key: where it repeats no line is lost, but a heading
    may come before or after its equals. Lines without doc_id are one document,
    null lines empty ones, other columns are not read; without lines there are
    no sections. ``section`` counts headings, from 0 for what stands before any.
    """
    at = [segment.alias("segment")] if segment is not None else []
    found = _kinds(lines.select("doc_id", "line_no", F.coalesce("raw", F.lit("")).alias("raw"), *at), headings)
    if segment is None:
        # Ranges come from a sample, so they are written down before they are used twice.
        found = kept(found.repartitionByRange(*([ranges] if ranges else []), "doc_id", "line_no").withColumn("segment", F.spark_partition_id()))
    says = _openings()
    last = [F.max(F.when(v.isNotNull(), F.struct("line_no", v.alias("o"))))["o"].alias(c) for c, v in says.items()]
    ends = found.groupBy("doc_id", "segment").agg(F.count("kind").alias("n"), *last)
    before = W.partitionBy("doc_id").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    so_far = ends.select("doc_id", "segment", F.sum("n").over(before).alias("n"), *[F.last(c, ignorenulls=True).over(before).alias(c) for c in says])
    carried = so_far.where("n is not null").select("doc_id", "segment", F.struct("n", *says).alias("carry"))  # a document's first segment has nothing before it
    rows = found.unionByName(carried, allowMissingColumns=True)
    w = W.partitionBy("doc_id", "segment").orderBy(F.col("carry").isNull(), "line_no").rowsBetween(W.unboundedPreceding, 0)
    opened = {c: F.last(F.coalesce(v, F.col(f"carry.{c}")), ignorenulls=True).over(w)["v"] for c, v in says.items()}
    section = F.sum(F.coalesce(F.col("carry.n"), F.col("kind").isNotNull().cast("long"))).over(w)
    return _bodies(rows.withColumns({"section": section, **opened}).where("carry is null"), least)


def number_sections(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, section, title and others) with section_index from 1 in each document, and section_title.

    Only (doc_id, section) of a document meet in a task; the rows are written once.
    """
    rows = kept(rows)
    index = rows.select(F.col("doc_id").alias("__doc"), F.col("section").alias("__at"), F.row_number().over(W.partitionBy("doc_id").orderBy("section")).alias("section_index"))
    both = rows.join(index, rows["doc_id"].eqNullSafe(index["__doc"]) & (rows["section"] == index["__at"]))
    return both.withColumn("section_title", F.coalesce("title", F.lit("front_matter"))).drop("__doc", "__at", "section", "title")


def sections_of_lines(lines: DataFrame, headings: dict[str, str], least: int = 500, segment: Column | None = None, ranges: int | None = None) -> DataFrame:
    """What ``sections`` gives, from lines (doc_id, line_no, raw): see ``section_bodies``."""
    return number_sections(section_bodies(lines, headings, least, segment, ranges)).select("doc_id", "section_index", "book", "part", "section_title", "body")


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """A text in pieces of at most ``size`` characters, where its separators allow.

    The first separator that occurs cuts it; neighbouring pieces are put
    together up to ``size``, longer ones cut by the separators after it. The
    separator stays with the piece after it. Chunks that follow one another
    share whole pieces of up to ``overlap`` characters; none are blank.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), None)
    if at is None:
        return [text.strip()] if text.strip() else []
    cut, rest = separators[at], separators[at + 1 :]
    if not cut:
        last = max(0, -(-(len(text) - size) // (size - overlap)))
        windows = (text[i * (size - overlap) :][:size].strip() for i in range(last + 1))
        return [w for w in windows if w]
    chunks: list[str] = []
    held: deque[tuple[int, int]] = deque()  # pieces of the text, one after the other

    def close() -> None:
        if held and (joined := text[held[0][0] : held[-1][1]].strip()):
            chunks.append(joined)

    for start, end in _pieces(text, cut):
        if end - start > size and rest:
            close()
            held.clear()
            chunks += split_recursively(text[start:end], size, overlap, rest)
            continue
        if held and end - held[0][0] > size:
            close()
            while held and (start - held[0][0] > overlap or end - held[0][0] > size):
                held.popleft()
        held.append((start, end))
    close()
    return chunks


def _pieces(text: str, cut: str) -> Iterator[tuple[int, int]]:
    """Where a text's pieces begin and end; each but the first begins with the separator."""
    start = 0
    while (end := text.find(cut, start + len(cut) if start or text.startswith(cut) else start)) >= 0:
        if end > start:
            yield start, end
        start = end
    if start < len(text):
        yield start, len(text)


def split_column(size: int, overlap: int, separators: Sequence[str]):
    """A column function text -> array of chunks; Spark has no such splitter."""
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the size")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap, separators) if t else [])

    return split


def split_fixed(text: Column, size: int, overlap: int) -> Column:
    """The same with the empty separator only: a window of ``size`` that moves on by size - overlap."""
    n = F.char_length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * (size - overlap) + 1, F.lit(size))))
    return F.filter(F.when(n > 0, parts).otherwise(F.array().cast("array<string>")), lambda x: x != "")


def infer_stage(rules: Sequence[tuple[dict[str, str], str]], default: str, text: Column | None = None, length: int = 1200) -> Column:
    """The stage of the first rule whose patterns all occur, else ``default``.

    A rule maps columns (book, part, section_title) or ``text``, the first
    ``length`` characters, to patterns. Their order is part of the rules.
    """
    out = None
    for conditions, stage in rules:
        ok = F.lit(True)
        for column, pattern in conditions.items():
            value = F.substring(text if text is not None else F.col("text"), 1, length) if column == "text" else F.coalesce(F.col(column), F.lit(""))
            ok = ok & F.rlike(value, F.lit(pattern))
        out = F.when(ok, F.lit(stage)) if out is None else out.when(ok, F.lit(stage))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def without_markers(chunks: DataFrame, markers: Sequence[str], text: str = "text") -> DataFrame:
    """Chunks without any of the boiler-plate markers."""
    return chunks.where(~contains_any(F.col(text), markers))


def with_timeline(rows: DataFrame, timeline: DataFrame, stage: str = "stage") -> DataFrame:
    """Rows with stage_order and anchor of the timeline (stage, stage_order, anchor), unknown stages as null.

    A timeline has a row per stage of one story, so Spark may broadcast it.
    """
    return rows.join(timeline, stage, "left")


def known_stages(rows: DataFrame, timeline: DataFrame, stage: str = "stage") -> DataFrame:
    """The same; a stage that the timeline doesn't have is an error."""
    found = with_timeline(rows, timeline, stage)
    refuse(found.where("stage_order is null").select(stage).distinct(), "unknown stage", [stage])
    return found


def number_chunks(chunks: DataFrame, order: Sequence[str], prefix: str = "novel", stage: str = "stage") -> DataFrame:
    """chunk_index from 0 in corpus order and chunk_id with it, given ``order`` beginning with doc_id.

    Each document's chunks are numbered on their own; documents' counts are
    added up in ranges of documents, so no task sees all chunks or documents.
    """
    doc, *rest = order
    chunks = kept(chunks)  # counted and numbered, but computed once
    own = W.partitionBy(doc).orderBy(*rest)
    counts = kept(chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(doc).withColumn("__part", F.spark_partition_id()))
    parts = counts.groupBy("__part").agg(F.sum("__n").alias("__m"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy("__part").orderBy(doc).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.join(starts, "__part").select(doc, (F.col("__start") + F.coalesce(F.sum("__n").over(within), F.lit(0))).alias("__before"))
    numbered = chunks.join(offsets, doc).withColumn("chunk_index", F.col("__before") + F.row_number().over(own) - 1).drop("__before")
    return numbered.withColumn("chunk_id", F.concat(F.lit(f"{prefix}_"), F.col(stage), F.lit("_"), padded(F.col("chunk_index"))))


def corpus_chunks(docs: DataFrame, headings: dict[str, str], size: int = 1800, overlap: int = 180, separators: Sequence[str] = ("\n\n", "\n", "。", "；", "，", ""), markers: Sequence[str] = (), rules: Sequence[tuple[dict[str, str], str]] = (), default_stage: str = "T0", names: Sequence[str] = (), aliases: dict[str, str] | None = None, least: int = 500) -> DataFrame:
    """Documents to numbered chunks with section, stage and mentions: the whole of corpus preparation."""
    split = F.posexplode(split_column(size, overlap, separators)("body")).alias("piece", "text")
    cut = sections(docs, headings, least).select("doc_id", "section_index", "book", "part", "section_title", split)
    stay = without_markers(cut, markers)
    tagged = stay.withColumn("stage", infer_stage(rules, default_stage)).withColumn("mentions", mentions(F.col("text"), names, aliases)).withColumn("character_mentions", piped(F.col("mentions")))
    return number_chunks(tagged, ["doc_id", "section_index", "piece"])


def chunk_counts(*collections: tuple[str, DataFrame]) -> DataFrame:
    """The number of chunks of each collection, for the report of a run."""
    parts = [f.agg(F.count(F.lit(1)).alias("chunks")).select(F.lit(name).alias("collection"), "chunks") for name, f in collections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
