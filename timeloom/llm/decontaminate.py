"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bytes that words are made of once A-Z is lower case: 0-9, a-z and all of UTF-8 beyond ASCII.
_TO_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

FOUND = "n_words long, hits array<struct<start:int,end:int>>, item_ids array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().translate(_TO_WORDS).split() if text else []


class WuManber:
    """Patterns are tuples of words of one length; a block is two words (one, if the length is one).

    ``shift`` says how far the window may move when a block is read at its end,
    ``buckets`` has the patterns by their last block and then by their first.
    """

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[tuple, set[str]]]]] = {}

    def add(self, pattern: tuple, item: str) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = pattern[end - b : end]
            self.shift[key] = min(self.shift.get(key, m), m - end)
        bucket = self.buckets.setdefault(pattern[m - b :], {}).setdefault(pattern[:b], [])
        for known, items in bucket:
            if known == pattern:
                items.add(item)
                return
        bucket.append((pattern, {item}))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """The start of each occurrence, with the items that have it."""
        m, b, n = self.length, self.block, len(words)
        far, shift, buckets, end = m - b + 1, self.shift.get, self.buckets, m
        while end <= n:
            last = tuple(words[end - b : end])
            step = shift(last, far)
            if step:
                end += step
                continue
            start = end - m
            for pattern, items in buckets[last].get(tuple(words[start : start + b]), ()):
                if tuple(words[start:end]) == pattern:
                    yield start, items
            end += 1


def build(items: list[tuple[str, bytes | None]], window: int) -> list[WuManber]:
    """One search for each length of pattern: short items would shrink the shifts of all others."""
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            m = min(window, len(words))
            search = by_length.setdefault(m, WuManber(m))
            for i in range(len(words) - m + 1):
                search.add(tuple(words[i : i + m]), item)
    return list(by_length.values())


def _merge(spans: list[tuple[int, int]]) -> list[dict]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [{"start": s, "end": e} for s, e in merged]


def _scan(searches: list[WuManber], text: bytes | None) -> tuple[int, list[dict], list[str]]:
    words, spans, items = words_of(text), [], set()
    for search in searches:
        for start, names in search.search(words):
            spans.append((start, start + search.length))
            items |= names
    return len(words), _merge(spans), sorted(items)


#: Spans of different blocks may overlap or touch; merged, they are those of one block.
_SPANS = "array<struct<start:int,end:int>>"


def _merged(hits: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda spans: _merge([(s["start"], s["end"]) for s in spans]))

    return F.pandas_udf(run, _SPANS)(hits)


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 2 << 20) -> DataFrame:
    """Where texts repeat ``window`` consecutive words of an item: id, n_words, n_hit, hits, item_ids.

    hits are the merged word spans [start, end), item_ids the items (as text,
    sorted) with an occurring window. An item of fewer words, but not none, is
    one window. Null and empty texts have no words and no hits; items without
    an id or words are never found; repeated rows give repeated results; items
    repeated under one id count once.

    The items go to the tasks in blocks of at most about ``block_bytes`` of
    text, one pass over the documents for each block, so what is broadcast is
    bounded for any benchmark: a word of an item takes some 300 bytes in the
    tables, so a block of 2 MB about 100 MB in each worker. For
    several blocks the rows get a key and are written once, and the blocks'
    finds are merged by that key, so each row keeps its own result.
    """
    of = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    total = of.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:
        keyed = cut(texts.withColumn("key", F.monotonically_increasing_id()))
        texts = keyed.select(F.col("key").alias("id"), "text")
    schema = f"id {dict(texts.dtypes)['id']}, {FOUND}"
    parts = []
    for k in range(blocks):
        rows = of.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        searches = docs.sparkSession.sparkContext.broadcast(build([(r.item, r.text.encode()) for r in rows], window))

        def scan(batches, searches=searches):
            for batch in batches:
                found = [_scan(searches.value, t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array([x[2] for x in found], pa.list_(pa.string())),
                    ],
                    names=["id", "n_words", "hits", "item_ids"],
                )

        parts.append(texts.mapInArrow(scan, schema))
    found = parts[0]
    if blocks > 1:
        # The first block has a row for every key, the others add what they find.
        for p in parts[1:]:
            found = found.unionByName(p.where(F.size("hits") > 0))
        found = found.groupBy("id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
        found = found.withColumn("hits", _merged(F.col("hits"))).withColumnRenamed("id", "key")
        found = keyed.select("key", "id").join(found, "key").drop("key")
    n_hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"])
    return found.select(F.col("id").alias(id_col), "n_words", n_hit.cast("long").alias("n_hit"), "hits", "item_ids")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, **kwargs) -> DataFrame:
    """The documents without any occurrence of an item's window, in their own columns.

    The search runs on the rows themselves, so documents that share an id are
    judged apart.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))
    clean = find_items(rows, items, "row", "text", window=window, **kwargs).where("n_hit = 0")
    return clean.select("row.*")
