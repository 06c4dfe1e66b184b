"""WARC archives: writing, and reading by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_group, cut, new_path

_PACKED = b"\x1f\x8b"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_END = "\r\n\r\n"

#: The header line that says where a record ends, as one of a block of lines.
_LENGTH = re.compile(rb"\r\n[ \t]*content-length[ \t]*:(.*?)(?=\r\n)", re.IGNORECASE | re.DOTALL)

RECORD = "file string, at long, record_type string, id string, url string, digest string, bytes long, refers_to string"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; line ends in a value are escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def deduplicate(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 100, salts: int = 64) -> DataFrame:
    """id, url, payload, bytes, digest, record_type, refers_to for every page.

    Of records with equal payloads of at least ``least`` bytes, that with the
    smallest id is a response and the others revisit it; smaller ones are all
    responses. A null payload is empty. A null id is never referred to unless
    all ids of its payload are null, and then all of them are responses; rows
    that share the smallest id are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256), "salt": F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(salts))})
    found = attach_group(rows, ["digest"], "salt", {"first": F.min("id")}, {"first": F.min("first")})
    again = (F.col("bytes") >= least) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return found.select("id", "url", "payload", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, mean_bytes: float = 4096, file_bytes: int = 32 << 20) -> None:
    """Write the rows of ``deduplicate`` as gzip-packed WARC files under ``path``.

    Files hold about ``file_bytes`` before packing, if records have ``mean_bytes``
    on average; a partition may take several. Columns besides those of
    ``deduplicate`` are left out; an empty table writes no record. A record is header, blank line, payload (none for a
    revisit) and two line ends; the payload's digest and length are in the
    header in any case.
    """
    body = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )
    per_file = max(1, int(file_bytes / (mean_bytes + 400)))
    records.select(record.alias("value")).write.option("maxRecordsPerFile", per_file).text(path, compression="gzip", lineSep=_END)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def _urn(value: str | None) -> str | None:
    return value.removeprefix("<").removesuffix(">").removeprefix("urn:page:") if value else None


def boundaries(data: bytes) -> Iterator[tuple[int, int]]:
    """Where a closed record may start, and where the one after it would: at every magic, also inside payloads.

    No body is looked at, and header lines that several places share are
    searched once, so a file's cost follows its length and not what its payloads hold.
    """
    head_end, line, length = -1, -1, b""
    for m in _MAGIC.finditer(data):
        if head_end < m.end() - 2:
            head_end = data.find(b"\r\n\r\n", m.end() - 2)
            if head_end < 0:
                return
            line = -1
            for found in _LENGTH.finditer(data, m.end() - 2, head_end + 2):
                line, length = found.start(), found[1].strip()
        # A length of more digits is beyond any file.
        if line < m.end() - 2 or not length.isdigit() or len(length) > 15:
            continue
        end = head_end + 4 + int(length)
        if data[end : end + 4] == b"\r\n\r\n":
            yield m.start(), end + 4


def parse(file: str, data: bytes, at: int, keep: bool = False) -> tuple | None:
    """The fields of the closed record that starts at ``at`` (``RECORD``), or nothing if its payload lacks the digest it states."""
    head_end = data.find(b"\r\n\r\n", at)
    f = _fields(data[at:head_end])
    *_, length = _LENGTH.finditer(data, at, head_end + 2)
    body = data[head_end + 4 : head_end + 4 + int(length[1].strip())]
    kind = f.get("warc-type")
    stated = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
    digest = stated if kind == "revisit" else hashlib.sha256(body).hexdigest()
    if stated not in (None, digest):
        return None
    told = f.get("warc-payload-length", "")
    size = (int(told) if re.fullmatch("[0-9]{1,15}", told) else 0) if kind == "revisit" else len(body)
    return (file, at, kind, _urn(f.get("warc-record-id")), f.get("warc-target-uri"), digest, size, _urn(f.get("warc-refers-to"))) + ((body,) if keep else ())


def unpack(data: bytes) -> bytes:
    """All gzip members of a file, one for each record or for all; what follows the last whole one, such as padding, is left out.

    A member that is cut off or damaged gives what could be read of it.
    """
    whole, at = [], 0
    while data[at : at + 2] == _PACKED:
        z = zlib.decompressobj(31)
        try:
            while at < len(data) and not z.eof:
                piece = data[at : at + (1 << 16)]
                whole.append(z.decompress(piece))
                at += len(piece) - len(z.unused_data)
        except zlib.error:
            break
    return b"".join(whole)


def _opened(batches) -> Iterator[tuple[str, bytes, dict]]:
    """Path and unpacked bytes of each file of ``batches``, and its further columns."""
    for batch in batches:
        for i in range(batch.num_rows):
            more = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            file, data = more.pop("path"), more.pop("content")
            yield file, unpack(data) if data[:2] == _PACKED else data, more


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """file, at, next: all places of ``path``'s files where a closed record may start, and their successors."""

    def run(batches):
        for file, data, _ in _opened(batches):
            found = list(boundaries(data))
            at, after = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(after, pa.int64())], names=["file", "at", "next"])

    return _files(spark, path).mapInArrow(run, "file string, at long, next long")


def reachable(places: DataFrame) -> DataFrame:
    """The places (file, at) on the chain of ends from the start of each file, by pointer jumping.

    ``places`` are candidates whose record is closed by two line ends, so that
    no chain steps to an end that is not one. An empty table has no places.

    Round i joins the reached places with pointers over 2**i records, and the
    pointers with themselves, so the rounds grow with the logarithm of the most
    records of a file.
    """
    jump = cut(places.select("file", "at", "next"))
    reached = jump.where("at = 0").select("file", "at")
    valid = jump.select("file", "at")
    jump = cut(jump.join(valid.withColumnRenamed("at", "next"), ["file", "next"], "left_semi").select("file", "at", "next"))
    while not jump.isEmpty():
        reached = cut(reached.unionByName(reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))))
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jump = cut(jump.join(further, ["file", "next"]).select("file", "at", F.col("beyond").alias("next")))
    return reached


def read_archives(spark: SparkSession, path: str, payload: bool = False, batch_bytes: int = 16 << 20) -> DataFrame:
    """The records of WARC files, plain or packed (``RECORD``, with their payload if asked for).

    A chain steps over a record only if two line ends close it; so it ends where
    a file is cut off. A record whose payload does not have the digest it states
    is stepped over and left out. Empty files and files without records give
    none. A file is read by one task, so files should be of some megabytes, as
    ``write_archives`` makes them.

    Files are read twice: for places and successors, and, where the chain has
    told real records, for these records' fields and digests, which go out in
    batches of about ``batch_bytes``.
    """
    real = reachable(candidates(spark, path)).groupBy(F.col("file").alias("path")).agg(F.sort_array(F.collect_list("at")).alias("places"))
    schema = RECORD + (", payload binary" if payload else "")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    fields = [pa.field(x.split()[0], k) for x, k in zip(schema.split(", "), kinds, strict=False)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))

    def run(batches):
        for file, data, more in _opened(batches):
            rows, held = [], 0
            for at in more["places"]:
                if (row := parse(file, data, at, payload)) is None:
                    continue
                rows.append(row)
                held += 400 + (len(row[-1]) if payload else 0)
                if held > batch_bytes:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    # Files are dealt once, by path: their contents are neither broadcast nor sorted, at any size.
    return _files(spark, path).join(real.hint("shuffle_hash"), "path").mapInArrow(run, schema)
