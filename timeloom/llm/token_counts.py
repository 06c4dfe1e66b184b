"""Token counts in rollups that signed deltas keep up to date."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Published split pattern of byte-level BPE with ranks, a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

KEYS = ["source", "lang", "version"]


@functools.lru_cache(4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and ``tokens``: its tokens under the rank file ``tokenizer``.

    Every worker must find the file at that path. A null text has 0 tokens. A
    column named tokens is overwritten.
    """
    own = [c for c in docs.columns if c not in (text_col, "tokens")]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__text") + ", tokens long"

    def length(text: str | None) -> int:
        # A long text goes in pieces that start at a blank after a letter, where the pattern splits too.
        if not text:
            return 0
        count, at, e = 0, 0, encoding(tokenizer)
        while len(text) - at > 1 << 20:
            end = at + (1 << 20)
            while end < len(text) and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1 : end + 2].isalpha()):
                end += 1
            count += len(e.encode_ordinary(text[at:end]))
            at = end
        return count + len(e.encode_ordinary(text[at:]))

    def run(batches):
        for batch in batches:
            n = pa.array([length(t) for t in batch.column("__text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], n], names=[*own, "tokens"])

    return rows.mapInArrow(run, schema)


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas that add documents: rows (source, lang, version, tokens) with sign +1."""
    return counts.select(*KEYS, F.lit(1).alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas that take documents away: the same with sign -1."""
    return inserted(counts).select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(counts: DataFrame, old: str = "old_tokens") -> DataFrame:
    """Deltas of documents whose count changes from ``old`` to tokens: no document more or less."""
    return counts.select(*KEYS, F.lit(0).alias("docs"), (F.coalesce("tokens", F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("tokens"))


class Rollup:
    """Additive totals by source, language and tokenizer version, kept up to date in a folder.

    Each commit writes the totals so far plus its batch's deltas as a version
    of its own, so reading the totals reads one version, and its size follows
    the keys and not the documents or batches. A version's folder is named by its
    number and its batch; Spark's ``_SUCCESS`` file in it, written last, is the
    commit. A batch that has one is left alone, and a version without one (a
    lost job) is not seen and written anew, so a batch counts once however often
    it is sent. The data of versions before the last one go; their folders
    stay and tell which batches have been counted. One writer at a time.
    Null sources, languages and versions are keys of their own.
    """

    SCHEMA = "source string, lang string, version string, docs long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[tuple[int, str, str]]:
        """Number, batch and folder of each committed version, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        found = [(int(n.split("-", 1)[0]), bytes.fromhex(n.split("-", 1)[1]).decode(), f"{self.path}/{n}") for n in names]
        return sorted(v for v in found if fs.exists(hadoop(f"{v[2]}/_SUCCESS")))

    def committed(self, batch: str) -> bool:
        return any(b == batch for _, b, _ in self._versions())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add the deltas (``KEYS``, docs, tokens) of a batch to the totals; false if it was committed before."""
        versions = self._versions()
        if any(b == batch for _, b, _ in versions):
            return False
        number = versions[-1][0] + 1 if versions else 1
        sums = self.totals().unionByName(deltas.select(*KEYS, "docs", "tokens")).groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
        sums.where("docs <> 0 or tokens <> 0").write.mode("overwrite").parquet(f"{self.path}/{number:08d}-{batch.encode().hex()}")
        for _, _, folder in versions[:-1]:  # the last but one may still be read
            self._empty(folder)
        return True

    def _empty(self, folder: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(hadoop(folder)):
            if f.getPath().getName() != "_SUCCESS":
                fs.delete(f.getPath(), True)

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens after the last commit; keys whose documents are all gone are left out."""
        versions = self._versions()
        rows = self.spark.read.schema(self.SCHEMA)
        return rows.parquet(versions[-1][2]) if versions else self.spark.createDataFrame([], self.SCHEMA)
