"""The trie of conversation prefixes, by a skeleton of splitters and local sorted shards."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Ids in one piece of a list of ends that goes from a shard to the reduction.
PIECE = 4096

#: Rows that a shard holds back before it sends them.
BATCH = 8192

_PATH = "array<struct<key: binary, size: int>>"


def paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, path: a conversation's turns in order, each as a SHA-256 of role and text with the text's code points.

    Turns are ordered by number, null first, then role and text; null roles and texts become empty, rows
    without a conversation are left out. A conversation is one row, as it is one path of the trie, so what a
    task holds is bounded by the longest conversation.
    """
    own = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")
    )

    def mark(t: Column) -> Column:
        whole = F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])
        return F.struct(F.unhex(F.sha2(whole.cast("binary"), 256)).alias("key"), F.char_length(t["text"]).alias("size"))

    return own.groupBy("conv").agg(F.transform(F.sort_array(F.collect_list("t")), mark).cast(_PATH).alias("path"))


def with_shared_heads(rows: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """Paths of which conversation c begins like conversation c - c % ``block`` does, for crc32(c) % ``heads`` turns.

    Only first turns are joined, and a block's first conversation meets fewer than ``block`` others.
    """
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads)).cast("int")
    first = rows.where(F.col("conv") % block == 0).select(F.col("conv").alias("base"), F.slice("path", 1, heads - 1).alias("head"))
    both = rows.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % block}).join(first, "base", "left")
    begun = F.slice(F.coalesce("head", F.array().cast(_PATH)), F.lit(1), F.col("h"))
    rest = F.slice("path", F.col("h") + 1, F.greatest(F.size("path") - F.col("h"), F.lit(0)))
    return both.select("conv", F.concat(begun, rest).alias("path"))


class Skeleton(NamedTuple):
    """Prefixes of the splitters' paths, parents before children; node 0 is the root."""

    children: dict[tuple[int, bytes], int]
    parent: list[int]
    depth: list[int]
    size: list[int]


def _splitters(rows: DataFrame, shards: int, per_shard: int) -> tuple[list[tuple], Skeleton]:
    """Up to ``shards`` - 1 rows that split the order of (path, conv) evenly, from ``per_shard`` sampled rows a shard; and their trie.

    The sample only decides how even the shards are, not the result.
    """
    skeleton = Skeleton({}, [-1], [0], [0])
    if shards < 2:
        return [], skeleton
    sample = rows.orderBy(F.xxhash64("conv"), "conv").limit(shards * per_shard).collect()
    order = sorted((tuple(bytes(t.key) for t in r.path), r.conv, [t.size for t in r.path]) for r in sample)
    chosen = [order[i * len(order) // shards] for i in range(1, shards)] if order else []
    for keys, _, sizes in chosen:
        at = 0
        for key, size in zip(keys, sizes, strict=True):
            if (at, key) not in skeleton.children:
                skeleton.children[at, key] = len(skeleton.parent)
                skeleton.parent.append(at)
                skeleton.depth.append(skeleton.depth[at] + 1)
                skeleton.size.append(size)
            at = skeleton.children[at, key]
    return sorted({(keys, conv) for keys, conv, _ in chosen}), skeleton


def _to_shards(splitters: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("path").to_pylist()
            shard = [bisect_right(splitters, (tuple(t["key"] for t in p), c)) for p, c in zip(keys, batch.column("conv").to_pylist(), strict=True)]
            yield batch.append_column("shard", pa.array(shard, pa.int32()))

    return run


class _Node:
    """A node that is still open: its place in the skeleton (-1: none) and what is known of its subtree."""

    __slots__ = ("skeleton", "key", "size", "place", "conv", "convs", "children", "leaves", "saved", "ends", "listed")

    def __init__(self, skeleton: int, key: bytes, size: int, place: int):
        self.skeleton, self.key, self.size, self.place = skeleton, key, size, place
        self.conv, self.convs, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends, self.listed = None, []


#: kind 0: a finished node, whose parent is in the skeleton if ``skeleton`` is not null; 1: a shard's part of a skeleton node; 2: a piece of a skeleton node's ends.
_SENT = "kind int, skeleton int, depth int, conv long, parent long, convs long, children long, leaves long, saved long, ends string, shard int, place int, piece binary"
_ARROW = pa.schema(
    [("kind", pa.int32()), ("skeleton", pa.int32()), ("depth", pa.int32())]
    + [(c, pa.int64()) for c in ("conv", "parent", "convs", "children", "leaves", "saved")]
    + [("ends", pa.string()), ("shard", pa.int32()), ("place", pa.int32()), ("piece", pa.binary())]
)


class _Shard:
    """One pass over a shard's sorted rows with a stack of the open nodes, as deep as the current path."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard, self.out, self.pieces = skeleton, shard, [], 0
        self.local: list[list] = []  # nodes of the subtree under the skeleton that is open: they wait for their parents' smallest members
        self.stack = [_Node(0, b"", 0, -1)]

    def add(self, conv: int, keys: list[bytes], sizes: list[int]) -> None:
        same = 0
        while same < len(keys) and same + 1 < len(self.stack) and self.stack[same + 1].key == keys[same]:
            same += 1
        self.close(same + 1)
        for key, size in zip(keys[same:], sizes[same:], strict=True):
            above = self.stack[-1]
            known = self.skeleton.children.get((above.skeleton, key), -1) if above.skeleton >= 0 else -1
            self.stack.append(_Node(known, key, size, -1 if known >= 0 else len(self.local)))
            if known < 0:
                self.local.append([])
        end = self.stack[-1]
        end.convs, end.conv = end.convs + 1, min(end.conv, conv)
        if end.skeleton < 0:
            if end.ends is None:
                end.ends = hashlib.sha256(str(conv).encode())
            else:
                end.ends.update(f",{conv}".encode())
        else:
            end.listed.append(conv)
            if len(end.listed) == PIECE:
                self.send_ends(end)

    def send_ends(self, node: _Node) -> None:
        if node.listed:
            self.out.append((2, node.skeleton, None, None, None, None, None, None, None, None, self.shard, self.pieces, ",".join(map(str, node.listed)).encode()))
            self.pieces, node.listed = self.pieces + 1, []

    def close(self, left: int) -> None:
        """Close the open nodes but the first ``left``."""
        while len(self.stack) > left:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            depth = len(self.stack)
            if node.skeleton >= 0:
                # What is subtracted once a node, and leaves of the skeleton, follow when all shards are summed.
                node.saved += node.convs * node.size
                self.send_ends(node)
                self.out.append((1, node.skeleton, depth, node.conv, None, node.convs, node.children, node.leaves, node.saved, None, self.shard, None, None))
            else:
                node.saved += (node.convs - 1) * node.size
                node.leaves += not node.children
                above.children += 1
                ends = (node.ends or hashlib.sha256()).hexdigest()
                self.local[node.place] = [0, above.skeleton if above.skeleton >= 0 else None, depth, node.conv, above.place, node.convs, node.children, node.leaves, node.saved, ends, None, None, None]
                if above.skeleton >= 0:
                    self.out += [(*x[:4], self.local[x[4]][3] if x[4] >= 0 else None, *x[5:]) for x in self.local]
                    self.local = []
            if above:
                above.conv, above.convs = min(above.conv, node.conv), above.convs + node.convs
                above.leaves, above.saved = above.leaves + node.leaves, above.saved + node.saved

    def sent(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _finish(skeleton: Skeleton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for conv, path, number in zip(batch.column("conv").to_pylist(), batch.column("path").to_pylist(), batch.column("shard").to_pylist(), strict=True):
                if shard is None or shard.shard != number:
                    if shard:
                        shard.close(0)
                        yield shard.sent()
                    shard = _Shard(skeleton, number)
                shard.add(conv, [t["key"] for t in path], [t["size"] for t in path])
                if len(shard.out) >= BATCH:
                    yield shard.sent()
        if shard:
            shard.close(0)
            yield shard.sent()

    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order, node by node, to the SHA-256 of their ids; one piece is held at a time."""
    node, state = None, None
    for batch in batches:
        for skeleton, piece in zip(batch.column("skeleton").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if skeleton != node:
                if state:
                    yield pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends": [state.hexdigest()]})
                node, state = skeleton, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece)
    if state:
        yield pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends": [state.hexdigest()]})


def prefix_trie(rows: DataFrame, shards: int | None = None, per_shard: int = 32, most_rows: int = 100_000) -> DataFrame:
    """A row per node of the trie of ``rows`` (conv, path): depth, conv, parent, convs, children, leaves, saved, ends.

    ``conv`` is the smallest member, ``parent`` that of the parent (null for the root); ``leaves`` and ``saved``
    are sums over the subtree; ``ends`` is the SHA-256 of the comma-joined ids, ascending, of those that end here.

    Rows are dealt by ranges of (path, conv) and sorted, so equal conversations are split as well, and a node
    has members in several shards only if it is a prefix of a splitter between them. These prefixes, the
    skeleton (at most one path a splitter), go to all tasks. One pass over a shard finishes every other node
    with the nodes of one path open; of skeleton nodes each shard sends its part, and the parts are summed.
    A hash over ids in order can't be summed: pieces of 4096 ids go to one task a skeleton node, which reads
    them as a stream.

    ``shards`` is by default the number of shuffle partitions, and at most ``most_rows`` conversations on
    average make a shard. An empty path ends at the root. An empty table has no nodes, not even a root.
    Ids are unique and not null; repeated and equal paths are what is counted. Any other columns are dropped.
    """
    spark = rows.sparkSession
    rows = cut(rows.select("conv", "path"))
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most_rows))
    splitters, skeleton = _splitters(rows, shards, per_shard)
    dealt = rows.mapInArrow(_to_shards(splitters), f"conv long, path {_PATH}, shard int").repartitionById(shards, "shard").sortWithinPartitions("shard", "path", "conv")
    sent = cut(dealt.mapInArrow(_finish(skeleton), _SENT))

    ends = sent.where("kind = 2").select("skeleton", "shard", "place", "piece").repartition("skeleton").sortWithinPartitions("skeleton", "shard", "place").mapInArrow(_hash_ends, "skeleton int, ends string")
    whole = sent.where("kind = 1").groupBy("skeleton").agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in ("convs", "children", "leaves", "saved")])
    top = spark.createDataFrame(_skeleton_rows(skeleton, whole), "skeleton int, depth int, conv long, parent long, convs long, children long, leaves long, saved long")
    columns = ["depth", "conv", "parent", "convs", "children", "leaves", "saved"]
    none = hashlib.sha256().hexdigest()
    inner = top.join(ends, "skeleton", "left").select(*columns, F.coalesce("ends", F.lit(none)).alias("ends"))
    above = top.select("skeleton", F.col("conv").alias("of"))
    local = sent.where("kind = 0").join(F.broadcast(above), "skeleton", "left").withColumn("parent", F.coalesce("of", "parent"))
    return inner.unionByName(local.select(*columns, "ends"))


def _skeleton_rows(skeleton: Skeleton, whole: DataFrame) -> list[tuple]:
    """The skeleton's nodes, finished from the sums over all shards: as many rows as the skeleton has, which the driver made."""
    got = {r.skeleton: r for r in whole.collect()}
    if not got:
        return []
    n = len(skeleton.parent)
    children, leaves, fixed = [got[i].children for i in range(n)], [got[i].leaves for i in range(n)], list(skeleton.size)
    for i in range(1, n):
        children[skeleton.parent[i]] += 1
    more = [int(not c) for c in children]
    for i in range(n - 1, 0, -1):
        more[skeleton.parent[i]] += more[i]
        fixed[skeleton.parent[i]] += fixed[i]
    return [(i, skeleton.depth[i], got[i].conv, got[skeleton.parent[i]].conv if i else None, got[i].convs, children[i], leaves[i] + more[i], got[i].saved - fixed[i]) for i in range(n)]
