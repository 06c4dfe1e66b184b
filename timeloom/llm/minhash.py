"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_group, bit_filter, cut, pass_filter
from .components import components

#: Size of the universe that the two permutations act on, as a power of two.
UNIVERSE_BITS = 20

#: White space that ends a word.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_P = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _avalanche(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(16)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of ``width`` consecutive words.

    Fewer words, but not none, are one shingle. Words are runs of bytes other
    than ASCII white space, A-Z in lower case.
    """
    if not text:
        return np.zeros(0, np.uint64)
    b = _LOWER[np.frombuffer(text, np.uint8)]
    letter = ~_SPACE[b]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if letter[0]:
        edge = np.concatenate([[0], edge])
    starts = edge[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    # Whole texts in pieces that end with a word, so that memory does not follow their length.
    words = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 18))))
        piece = slice(starts[at], starts[end] if end < len(starts) else len(b))
        part, own = b[piece], starts[at:end] - starts[at]
        up, down = _powers(1 << max(12, (len(part) - 1).bit_length()))
        weighed = np.where(letter[piece], part.astype(np.uint64) + np.uint64(1), np.uint64(0)) * up[: len(part)]
        words[at:end] = _avalanche(np.add.reduceat(weighed, own) * down[own])
        at = end
    n = min(width, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = _avalanche(total + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    return np.unique(total + np.uint64(n if n < width else 0))


class Circulant:
    """Two permutations of the universe: sigma once, pi circularly shifted by one for each coordinate."""

    def __init__(self, coordinates: int, seed: int):
        rng, size = np.random.default_rng(seed), 1 << UNIVERSE_BITS
        self.sigma = rng.permutation(size).astype(np.uint32)
        pi = rng.permutation(size).astype(np.uint32)
        self.pi = np.concatenate([pi, pi[:coordinates]])
        self.coordinates = coordinates

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Coordinate k of a set is the least pi(sigma(x) + k) of its members; no set may be empty."""
        at = self.sigma[(np.concatenate(sets) >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)].astype(np.int64)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        return np.stack([np.minimum.reduceat(self.pi[k:][at], starts) for k in range(self.coordinates)], 1)


@functools.lru_cache(2)
def _circulant(coordinates: int, seed: int) -> Circulant:
    return Circulant(coordinates, seed)


#: Bits of the odd sketch of a set, and the columns that hold it.
ODD_BITS = 1024
SKETCH = [f"s{k}" for k in range(ODD_BITS // 64)]


def _lists(sets: list[np.ndarray]) -> pa.Array:
    """Arrays of hashes as one Arrow column of lists."""
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _sketch(width: int, bands: int, rows: int, seed: int):
    """Arrow batches (id, text) to (id, n, hi, lo, bands, s0, s1, ...): set size, two hashes of the set, its band keys, its odd sketch."""

    def flush(ids, sets):
        full = [i for i, s in enumerate(sets) if len(s)]
        n = np.array([len(s) for s in sets], np.int64)
        hi, lo, *sketch = (np.zeros(len(sets), np.uint64) for _ in range(2 + len(SKETCH)))
        keys: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(sets)
        if full:
            some = [sets[i] for i in full]
            starts = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
            joined = np.concatenate(some)
            hi[full], lo[full] = np.add.reduceat(_avalanche(joined), starts), np.bitwise_xor.reduceat(joined * _M2, starts)
            sig = _circulant(bands * rows, seed).signatures(some).astype(np.uint64)
            for i, band in zip(full, _band_keys(sig, bands, rows), strict=True):
                keys[i] = band
            for i, x in zip(full, some, strict=True):
                odd = np.bincount((x & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
                for word, bits in zip(sketch, np.packbits(odd.astype(np.uint8)).view(np.uint64), strict=True):
                    word[i] = bits
        columns = [ids, pa.array(n), *[pa.array(x.view(np.int64)) for x in (hi, lo)], _lists(keys), *[pa.array(x.view(np.int64)) for x in sketch]]
        return pa.RecordBatch.from_arrays(columns, names=["id", "n", "hi", "lo", "bands", *SKETCH])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").cast(pa.binary()).to_pylist()
            sets, at, held = [], 0, 0
            for i, t in enumerate(texts):
                sets.append(s := shingles(t, width))
                held += len(s)
                if held > 1 << 20:  # pieces of a batch bound the memory of a task
                    yield flush(ids.slice(at, i + 1 - at), sets)
                    sets, at, held = [], i + 1, 0
            if sets:
                yield flush(ids.slice(at), sets)

    return run


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash of each band of ``rows`` coordinates, sets x bands."""
    keys = np.zeros((len(sig), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(sig), k + 1, np.uint64)
        for c in range(rows):
            h = _avalanche(h * _M1 + sig[:, k * rows + c] + np.uint64(c))
        keys[:, k] = h
    return keys


def linked(x: np.ndarray, y: np.ndarray, both: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def difference_keys(hub: np.ndarray, x: np.ndarray, percent: int, common: np.ndarray) -> tuple[bool, np.ndarray, np.ndarray]:
    """Whether ``x`` is linked with ``hub``, and the parts of their difference by which others linked with ``x`` are found.

    Let D be what is in one of hub and x only. x and y are linked only if their
    sizes' sum, times c = (1 - p) / (1 + p), is at least what D(x) and D(y) do not
    share; while a set that is not linked with the hub has more than that in its
    own D. So if either of x and y is not linked with the hub, their D overlap,
    and by how much at least follows from x alone. Sorted in one order for all, D(x)
    then shares an element with D(y) among so many first ones that only the
    overlap less one comes after: the first list if y is not linked with the
    hub, the second if it is. The order has what x has and the hub has not
    first, and of that what few texts have (``common`` counts texts by a piece
    of the hash), so that elements which many share are seldom looked at.
    """
    new, lost = np.setdiff1d(x, hub, assume_unique=True), np.setdiff1d(hub, x, assume_unique=True)
    near = linked(hub, x, len(x) - len(new), percent)
    p = percent / 100
    c = (1 - p) / (1 + p)
    bits = np.uint64(64 - int(len(common)).bit_length() + 1)
    d = np.concatenate([part[np.lexsort((part, common[(part >> bits).astype(np.int64)]))] for part in (new, lost)])
    least_any = max(1, math.ceil(len(d) - (1 / p - 1) * len(x) - 1e-9))
    least_far = max(least_any, math.floor((len(d) + c * (len(hub) - len(x))) / 2 - 1e-9) + 1)
    return near, d[: max(0, len(d) - least_far + 1)], d[: max(0, len(d) - least_any + 1)]


def _compare(width: int, percent: int, common=None):
    """Arrow batches (a, b, met, text_a, text_b) to (a, b, met, near, far_keys, near_keys) by their full sets.

    Without ``common`` only the linked pairs come out, and no keys.
    """
    none = np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            a, b = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            last, first, near, far_keys, near_keys = None, None, [], [], []
            for x, y in zip(a, b, strict=True):
                if (t := x.as_py()) != last:
                    last, first = t, shingles(t, width)
                second = shingles(y.as_py(), width)
                if common is None:
                    near.append(linked(first, second, len(np.intersect1d(first, second, assume_unique=True)), percent))
                    continue
                yes, far, long = difference_keys(first, second, percent, common.value)
                near.append(yes)
                far_keys.append(none if yes else far)
                near_keys.append(far if yes else long)
            out = batch.select(["a", "b", "met"])
            mask = pa.array(near, pa.bool_())
            if common is None:
                yield out.filter(mask)
            else:
                yield pa.RecordBatch.from_arrays([*out.columns, mask, _lists(far_keys), _lists(near_keys)], names=["a", "b", "met", "near", "far_keys", "near_keys"])

    return run


def _count_slots(width: int, bits: int):
    """Arrow batches (text) to (slot, n): in how many texts there is a shingle whose hash begins with the slot."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for t in batch.column("text").cast(pa.binary()):
                counts += np.bincount((shingles(t.as_py(), width) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) if t.is_valid else 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["slot", "n"])

    return run


class _Search:
    """The texts, sketches and settings that all rounds of one search use."""

    def __init__(self, texts: DataFrame, facts: DataFrame, width: int, percent: int, filter_bits: int, slot_bits: int = 18):
        self.texts, self.facts, self.width, self.percent, self.filter_bits, self.slot_bits = texts, facts, width, percent, filter_bits, slot_bits
        self.kind = dict(texts.dtypes)["id"]

    def alike(self, x: str, y: str) -> Column:
        """Whether set sizes and odd sketches of two members let them be linked.

        An odd sketch has a bit for each value of a hash, set if an odd number of
        the members have the value; so the sketches of two sets differ in as many
        bits at most as the sets do in members. Linked sets differ in (100 - p) /
        (100 + p) of their sizes' sum at most. For large sets that is more than
        the bits that mostly differ then, 2**9 * (1 - exp(-d / 2**9)); these and
        five standard deviations are the limit where that is less, which a
        linked pair exceeds with a probability below 1e-6.
        """
        sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= self.percent * F.greatest(f"{x}.n", f"{y}.n")
        most = F.floor((100 - self.percent) * (F.col(f"{x}.n") + F.col(f"{y}.n")) / (100 + self.percent))
        half = ODD_BITS / 2
        usual = half * (1 - F.exp(-most / half)) + 5 * F.sqrt(half / 2 * (1 - F.exp(-2 * most / half)))
        differ = F.lit(0)
        for w in SKETCH:
            differ = differ + F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}")))
        return sizes & (differ <= F.least(most, F.ceil(usual)))

    def with_facts(self, rows: DataFrame) -> DataFrame:
        """``rows`` with set size and sketch of their id."""
        some = pass_filter(self.facts, "id", cut(bit_filter(rows, "id", self.filter_bits)), self.filter_bits)
        return rows.join(some, "id")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The candidates (a, b, met), each once, without those whose sketches exclude a link."""
        once = cut(pairs.groupBy("a", "b").agg(F.max("met").alias("met")))
        some = cut(pass_filter(self.facts, "id", cut(bit_filter(once.select(F.explode(F.array("a", "b")).alias("id")), "id", self.filter_bits)), self.filter_bits))
        both = once.join(some.alias("x"), F.col("a") == F.col("x.id")).join(some.alias("y"), F.col("b") == F.col("y.id"))
        return cut(both.where(self.alike("x", "y")).select("a", "b", "met"))

    def _some(self, ids: DataFrame) -> DataFrame:
        """The texts of a bitmap's worth of ids: all of ``ids``, and a few others."""
        return pass_filter(self.texts, "id", cut(bit_filter(ids, "id", self.filter_bits)), self.filter_bits)

    def _with_texts(self, pairs: DataFrame) -> DataFrame:
        some = self._some(pairs.select(F.explode(F.array("a", "b")).alias("id")))
        # A hub's pairs come last together, when their rows are long enough for Spark to split them.
        first = pairs.join(some.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return first.join(some.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "met", "text_a", "text_b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the candidates (a, b, met) that are linked."""
        return cut(self._with_texts(pairs).mapInArrow(_compare(self.width, self.percent), f"a {self.kind}, b {self.kind}, met long"))

    def differences(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, met) of hub and member with the keys of their difference."""
        common = self.texts.sparkSession.sparkContext.broadcast(self._commonness(pairs.select(F.explode(F.array("a", "b")).alias("id"))))
        schema = f"a {self.kind}, b {self.kind}, met long, near boolean, far_keys array<long>, near_keys array<long>"
        return cut(self._with_texts(pairs).mapInArrow(_compare(self.width, self.percent, common), schema))

    def _commonness(self, ids: DataFrame) -> np.ndarray:
        """Counts by 2**slot_bits slots, whatever the number of texts; they only decide an order."""
        counted = self._some(ids).select("text").mapInArrow(_count_slots(self.width, self.slot_bits), "slot long, n long")
        found = np.zeros(1 << self.slot_bits, np.int64)
        rows = counted.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        found[rows["slot"]] = rows["n"]
        return found


def _buckets(banded: DataFrame) -> DataFrame:
    """(key, id, met) of buckets with more than one member; ``met`` counts whom an id meets in all its buckets."""
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    level = cut(banded.join(shared, "key"))
    return cut(level.select("key", "id").join(level.groupBy("id").agg(F.sum("held").alias("met")), "id"))


def _with_hubs(level: DataFrame) -> DataFrame:
    """Pairs (a, b, met): a is the hub of a bucket that b is in too, which meets most others (met), then has the smallest id.

    Who meets many others is near the middle of its group, so most of the group is linked with it.
    """
    hubs = level.groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("order"), "id")).alias("hub"))
    return level.join(cut(hubs), "key").select(F.col("hub.id").alias("a"), F.col("id").alias("b"), (-F.col("hub.order")).alias("met")).where("a <> b")


def _labels(links: DataFrame) -> DataFrame:
    """node, label: the best hub that a member is linked with, or that one's; equal labels are one component."""
    best = cut(links.groupBy(F.col("b").alias("node")).agg(F.min(F.struct((-F.col("met")).alias("order"), "a")).alias("hub")).select("node", F.col("hub.a").alias("label")))
    further = best.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return cut(best.join(further, "label", "left").select("node", F.coalesce("further", "label").alias("label")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")


def _open_buckets(level: DataFrame, labels: DataFrame) -> DataFrame:
    """``level`` without buckets whose members are one component by now, with comp, main, and others: how many are outside the main one."""
    current = cut(_labelled(level, labels))
    per = current.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("held"))
    buckets = per.groupBy("key").agg(F.max_by("comp", F.struct("held", "comp")).alias("main"), (F.sum("held") - F.max("held")).alias("others"), F.count(F.lit(1)).alias("comps"))
    return cut(current.join(cut(buckets.where("comps > 1").drop("comps")), "key"))


def _across(search: _Search, rows: DataFrame) -> DataFrame:
    """Pairs of ``rows`` (key, id, comp, one, two) with the same key and different comp, one of which has ``one`` and the other ``two``, if their sketches are alike."""
    rows = cut(search.with_facts(rows))
    x, y = rows.where("one").alias("x"), rows.where("two").alias("y")
    once = F.expr("x.comp <> y.comp and (x.id < y.id or not (x.two and y.one))")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & once & search.alike("x", "y"))
    return pairs.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.lit(0).cast("long").alias("met"))


def _by_difference(search: _Search, large: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of large buckets' members with their hubs, and the likely pairs among those that are not both linked with one hub."""
    pairs = cut(_with_hubs(large).groupBy("a", "b").agg(F.max("met").alias("met")))
    found = search.differences(pairs)
    far = found.select("a", F.col("b").alias("id"), F.explode("far_keys").alias("e"), F.lit(True).alias("one"), F.lit(True).alias("two"), F.lit(0).alias("kind"))
    both = found.select("a", F.col("b").alias("id"), F.explode("near_keys").alias("e"), (~F.col("near")).alias("one"), F.col("near").alias("two"), F.lit(1).alias("kind"))
    rows = cut(far.unionByName(both).select(F.xxhash64("a", "e", "kind").alias("key"), "id", "one", "two"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.max("one").alias("one"), F.max("two").alias("two")).where("held > 1 and one and two").select("key")
    return found.where("near").select("a", "b", "met"), _across(search, _labelled(rows.join(cut(shared), "key", "left_semi"), labels))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 28, rows: int = 4, few: int = 512, seed: int = 11, filter_bits: int = 23) -> DataFrame:
    """One row per document: id, n_shingles, component_id.

    Documents are linked if their sets of ``width``-word shingles have
    100 * intersection >= percent * union; a component is what can be reached
    over links and is named by its smallest id. Null, empty and blank texts have
    an empty set and are linked with nothing; a null id is its own component;
    rows that share an id are one document. An empty table gives an empty table.
    Ids may be of any type that has an order.

    Documents with the same set become one member each. Members that share a
    band are candidates; at 0.8 and 28 bands of 4 a linked pair shares none with
    probability 4e-7. No pair counts before its full sets are compared, and
    none is compared if the odd sketches of its sets differ too much (``alike``).

    First, each bucket's members are compared with its hub, the one of them that
    meets most others in its buckets; what is linked with one hub has one label.
    A bucket that then still holds several labels is gone through again. If at
    most ``few`` members are outside its most frequent label, they are compared
    with all others, as far as sketches let them. If more are, its members are
    dealt by what they have and the hub has not, or the other way round
    (``difference_keys``): members that are linked with each other, but not both
    with the hub, meet under one such key for certain, so this loses no link;
    and what all members have in common brings none of them together.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = ", ".join(f"{w} long" for w in SKETCH)
    sketched = texts.mapInArrow(_sketch(width, bands, rows, seed), f"id {kind}, n long, hi long, lo long, bands array<long>, {words}")
    salted = cut(sketched.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)).cast("int")))
    same = attach_group(salted.where("n > 0 and id is not null").select("id", "n", "hi", "lo", "salt"), ["hi", "lo", "n"], "salt", {"rep": F.min("id")}, {"rep": F.min("rep")})
    members = cut(same.select("id", "n", "rep"))
    reps = cut(salted.where("n > 0").join(members.where("id = rep").select("id").distinct(), "id", "left_semi").select("id", "n", "bands", *SKETCH))

    search = _Search(texts.where("id is not null"), reps.drop("bands"), width, percent, filter_bits)
    level = _buckets(reps.select("id", F.explode("bands").alias("key")))
    links = search.links(search.likely(_with_hubs(level)))
    labels = _labels(links)
    still = _open_buckets(level, labels)
    near = still.where(F.col("others") <= few)
    likely = _across(search, near.select("key", "id", "comp", (F.col("comp") != F.col("main")).alias("one"), F.lit(True).alias("two")))
    large = still.where(F.col("others") > few)
    if not large.isEmpty():
        with_hubs, more = _by_difference(search, large.select("key", "id", "met"), labels)
        links, likely = links.unionByName(with_hubs), likely.unionByName(more)
    links = links.unionByName(search.links(cut(likely.distinct())))

    comps = components(links.select("a", "b"))
    named = members.select("id", "n", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    # A component's name is its smallest id, and a representative is the smallest of its set.
    alone = salted.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    found = named.select("id", "n", F.col("comp").alias("component_id")).unionByName(alone)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, **kwargs) -> DataFrame:
    """The documents, in their own columns, of which each group keeps the one with the smallest id.

    Groups are found among rows: rows that share an id are documents of their own, so of
    equal or near texts under one id one row stays, and texts that are nobody's copy all stay. Of rows with the
    smallest id of a group the first of the input stays. Rows without an id stay, and so do null, empty and blank texts, which are
    nobody's copy. Long texts are compared whole; an empty table gives an empty table; columns may have any name but ``__row``.
    """
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = near_groups(rows.where(F.col(id_col).isNotNull()), "__row", text_col, **kwargs).select("__row", F.col("component_id").alias("group"))
    members = groups.join(rows.select("__row", F.col(id_col).alias("id")), "__row").withColumn("salt", F.pmod(F.xxhash64("__row"), F.lit(salts)))
    first = attach_group(members.select("__row", "group", "id", "salt"), ["group"], "salt", {"least": F.min(F.struct("id", "__row"))}, {"least": F.min("least")})
    stay = first.where(F.col("least")["__row"] == F.col("__row")).select("__row")
    return rows.join(stay, "__row", "left_semi").unionByName(rows.where(F.col(id_col).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])
