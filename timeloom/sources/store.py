"""Tables that change in place: files in hash buckets under a manifest of versions."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import kept, remove


class Store:
    """A table under ``path`` whose rows are found by ``keys``; a change rewrites the buckets that it touches, no others.

    Every change is a version: its buckets are written to a folder of their own, then a manifest is created that
    names the folder of each bucket. A reader opens one manifest and so sees one version, whole, also while the
    next is written; a change that fails or is run again leaves the table as it was. Manifests are as long as there
    are buckets, and only the ``keep`` last ones stay, with the folders they name, so opening the table costs the
    same after any number of changes. One writer at a time: a second that commits the same version is refused.

    Null keys share a bucket and never match one another. An empty table is a version without buckets.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.keys, self.keep = spark, path, keys, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self.manifest() or {"count": buckets})["count"]

    # Manifests

    def versions(self) -> list[int]:
        """The versions that can still be read, oldest first."""
        folder = self._path(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, or of the last one that is whole; None before the first."""
        for v in [version] if version is not None else reversed(self.versions()):
            stream = self._fs.open(self._path(f"{self.path}/manifest/{v:012d}.json"))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except json.JSONDecodeError:
                continue  # its writer stopped half way
            finally:
                stream.close()
        return None

    def _commit(self, manifest: dict) -> None:
        file = self._path(f"{self.path}/manifest/{manifest['version']:012d}.json")
        out = self._fs.create(file, False)  # an error if another writer was faster
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # Versions before the last ones go, and what only they name.
        versions = self.versions()
        old, left = versions[: -self.keep], versions[-self.keep :]
        if old:
            needed = {x for v in left for x in (self.manifest(v) or {"folders": {}})["folders"].items()}
            gone = {x for v in old for x in (self.manifest(v) or {"folders": {}})["folders"].items()} - needed
            for bucket, folder in sorted(gone):
                remove(self.spark, f"{self.path}/data/{folder}/bucket={bucket}")
            for folder in {f for _, f in gone} - {f for _, f in needed}:
                remove(self.spark, f"{self.path}/data/{folder}")
            for v in old:
                remove(self.spark, f"{self.path}/manifest/{v:012d}.json")

    # Rows

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, the last by default; of some buckets only if they are named."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"there is no table at {self.path}")
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in found["folders"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(found["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, keys: list[str] | None = None):
        return F.pmod(F.xxhash64(*(keys or self.keys)), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, before: dict, touched: set[int] | None, batch: int | None) -> int:
        if "bucket" in map(str.lower, rows.columns):
            raise ValueError("bucket is the name of the folders, not of a column")
        folder = f"{before['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.path}/data/{folder}"
        rows.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        written = [p.getPath().getName() for p in self._fs.listStatus(self._path(path))]
        new = {n.removeprefix("bucket="): folder for n in written if n.startswith("bucket=")}
        if not new:
            remove(self.spark, path)
        stay = {} if touched is None else {b: f for b, f in before["folders"].items() if int(b) not in touched}
        schema = before.get("schema") or json.loads(T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]).json())
        self._commit({"version": before["version"] + 1, "count": self.buckets, "schema": schema, "batch": before["batch"] if batch is None else batch, "folders": stay | new})
        return before["version"] + 1

    def replace(self, rows: DataFrame) -> int:
        """Drop what is there and write ``rows``; the new version."""
        before = self.manifest() or {"version": 0, "folders": {}, "batch": -1}
        before.pop("schema", None)
        return self._write(rows, before, None, None)

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> set[int]:
        """Put ``how(old rows, changes)`` in place of the buckets that ``changes`` (with the table's keys) touch; these buckets.

        Rows of one key are in one bucket, so ``how`` sees all old rows of the keys it changes, and may touch no
        others. A ``batch`` number that is not above the last one committed is one that is run again: nothing
        happens. Without a change there is no new version.
        """
        before = self.manifest()
        if before is None:
            self.replace(changes.limit(0))
            before = self.manifest()
        if batch is not None and batch <= before["batch"]:
            return set()
        new = kept(changes.withColumn("__bucket", self.bucket()))
        touched = {r["__bucket"] for r in new.select("__bucket").distinct().collect()}  # as many as buckets at most
        if touched:
            self._write(how(self.read(before["version"], touched), new.drop("__bucket")), before, touched, batch)
        return touched

    def upsert(self, changes: DataFrame, batch: int | None = None) -> set[int]:
        """Changed rows in place of those with their keys, new ones added; the buckets rewritten.

        Rows that say what is there already change nothing, so a repeated upsert writes nothing. Keys of
        ``changes`` are unique. Columns are those of the table, of types that can be compared.
        """
        columns = self._columns(changes)
        before = self.manifest()
        if before is not None:
            # Only the buckets of the changes are compared.
            changes = kept(changes.select(*columns))
            hit = {r.b for r in changes.select(self.bucket().alias("b")).distinct().collect()}
            old = self.read(before["version"], hit).select(F.struct(*columns).alias("__old"), *[F.col(k).alias(f"__{k}") for k in self.keys])
            same = F.lit(True)
            for k in self.keys:
                same = same & (F.col(k) == F.col(f"__{k}"))
            changes = changes.join(old, same, "left").where(~F.struct(*columns).eqNullSafe(F.col("__old"))).select(*columns)

        def put(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*self.keys), self.keys, "left_anti").select(*columns).unionByName(new.select(*columns))

        return self.merge(changes.select(*columns), put, batch)

    def remove(self, ids: DataFrame, batch: int | None = None) -> set[int]:
        """The table without the rows of these keys (a column each); the buckets rewritten."""
        there = ids.select(*self.keys).distinct()
        return self.merge(there, lambda old, gone: old.join(gone, self.keys, "left_anti"), batch)

    def _columns(self, changes: DataFrame) -> list[str]:
        found = self.manifest()
        return [f["name"] for f in found["schema"]["fields"]] if found else changes.columns
