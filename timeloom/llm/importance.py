"""Target-distribution importance resampling: drawing the documents whose features look most like a target's."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running_numbers

#: Bytes of words (digits, letters in lower case, all beyond ASCII); others become spaces.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20


def buckets_of(text: bytes | None, buckets: int, grams: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of 1 to ``grams`` words that end here) for a text, a piece after the other."""
    low, at, held = (text or b"").translate(_LOWER), 0, []
    while at < len(low):
        end = low.find(b" ", at + PIECE)
        end = len(low) if end < 0 else end
        new = low[at:end].split()
        words, run, found = held + new, [], []
        for g in range(grams):
            run = [crc32(b" " + w, c) for c, w in zip(run, words[g:], strict=False)] if g else [crc32(w) for w in words]
            found += run[max(0, len(held) - g) :]
        yield len(new), np.array(found, np.int64) % buckets
        held = words[len(words) - grams + 1 :] if grams > 1 else []
        at = end


def feature_counts(texts: DataFrame, text_col: str = "text", buckets: int = 10_000, grams: int = 2) -> DataFrame:
    """bucket, n: how often features of ``texts`` fall into each bucket that has any; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, found in buckets_of(text, buckets, grams):
                    n += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": used, "n": n[used]})

    return texts.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000, grams: int = 2) -> np.ndarray:
    """floor(1000 ln of target share / source share) of each bucket, every count one more; an array as long as ``buckets``."""
    both = feature_counts(source, text_col, buckets, grams).withColumn("of", F.lit(0)).unionByName(feature_counts(target, text_col, buckets, grams).withColumn("of", F.lit(1)))
    n = np.zeros((2, buckets), np.int64)
    for r in both.collect():  # two rows a bucket at most
        n[r.of, r.bucket] = r.n
    total = n.sum(1)
    ratio = (n[1] + 1.0) * float(total[0] + buckets) / ((n[0] + 1.0) * float(total[1] + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = 2) -> DataFrame:
    """id, n_words, n_features, weight: the floored mean of the gains of a document's features, 0 for none."""
    kind = dict(docs.dtypes)[id_col]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                for words, found in buckets_of(text, len(gain), grams):
                    rows[i] += words, len(found), gain[found].sum()
            mean = np.where(rows[:, 1] > 0, rows[:, 2] // np.maximum(rows[:, 1], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (rows[:, 0], rows[:, 1], mean))], names=["id", "n_words", "n_features", "weight"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return own.mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a SHA-256 of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(-1000 * F.log(-F.log(u)))


def cutoff(rows: DataFrame, want: int, keys: list[str]) -> list[int]:
    """The last of the ``want`` first rows in order of the whole-number ``keys``, as its leading keys.

    Each key is bisected between its smallest and largest value by exact count jobs. Once all rows with
    the keys found so far are wanted, the other keys are left out; ``rows`` has at least ``want`` rows.
    """
    found: list[int] = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        while low < high:
            middle = (low + high) // 2
            if rows.where(F.col(key) <= middle).count() >= want:
                high = middle
            else:
                low = middle + 1
        found.append(low)
        want -= rows.where(F.col(key) < low).count()
        rows = rows.where(F.col(key) == low)
        if rows.count() == want:
            break
    return found


def _up_to(keys: list[str], last: list[int]) -> Column:
    """Whether a row is not after ``last`` in order of the keys."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, last, strict=False))):
        out = (F.col(key) < value) | ((F.col(key) == value) & out)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 25, least_words: int = 20, buckets: int = 10_000, grams: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (1, 2, 3... for those drawn, else null).

    Features are runs of 1 to ``grams`` words, hashed into ``buckets``; a bucket gains what it is commoner in
    ``target`` than in ``docs``. The gains are one array of fixed length that every task holds; a document's
    weight is the mean gain of its features. With Gumbel noise from its id added, the highest scores are a
    draw without replacement: ``percent`` of the documents that have ``least_words``, ties to the smaller id.

    The scores are written once. Their cutoff is found by bisection, with ties at it bisected by id and then
    by row, so nothing is sorted or ranked but the documents drawn, and those by ranges of their order.

    Null and empty texts have no features and weight 0 and are not drawn (they have no words); long texts
    are read whole, in pieces. A null id counts as the empty text and comes after all others. Rows that share
    an id share the noise, not the weight; of equal scores among them any may come first. Without a target all counts of it are
    0. Other columns are not used, whatever their names. An empty table gives an empty table. Ids are whole numbers.
    """
    gain = gains(docs, target, text_col, buckets, grams)
    scored = weights(docs, gain, id_col, text_col, grams)
    last_id = F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1))
    scored = cut(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumns({"falling": -F.col("score"), "by_id": last_id, "row": F.monotonically_increasing_id()}))
    able = scored.where(F.col("n_words") >= least_words)
    want = able.count() * percent // 100
    keys = ["falling", "by_id", "row"]
    taken = (F.col("n_words") >= least_words) & _up_to(keys, cutoff(able, want, keys)) if want else F.lit(False)
    drawn = running_numbers(scored.where(taken), keys, "rank")
    both = drawn.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")))
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
