import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from timeloom.llm.prefix_trie import paths, prefix_trie, with_shared_heads

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["depth", "conv", "parent", "convs", "children", "leaves", "saved", "ends"]


def brute(rows, shared):
    """The same nodes from dictionaries of prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    if shared:
        h = {c: crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + own[c][h[c] :] for c in own}
    nodes = defaultdict(list)
    for c, p in own.items():
        for d in range(len(p) + 1):
            nodes[tuple(p[:d])].append(c)
    kids = defaultdict(set)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    out = []
    for k, convs in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in convs if len(own[c]) == len(k))))
        out.append((len(k), min(convs), min(nodes[k[:-1]]) if k else None, len(convs), len(kids[k]), sum(not kids[x] for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes(spark, rows, shared=True, **kwargs):
    found = paths(spark.createDataFrame(rows, TURNS))
    return sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie(with_shared_heads(found) if shared else found, **kwargs).collect()), key=str)


def made(seed, n, copies):
    """Conversations of few different turns, so that they share heads; some are copies of one."""
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        same = random.Random(1 if pick.random() < copies else c + 1000 * seed)
        for t in range(same.randint(1, 7)):
            rows.append((c, t, same.choice(["user", "assistant", None]), same.choice(["a", "äö", "", None, "long " * 5])))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shared", "shards"), [(True, 1), (True, 7), (False, 40)])
def test_same_as_brute_force(spark, shared, shards):
    rows = made(shards, 230, 0.4)
    assert nodes(spark, rows, shared, shards=shards, per_shard=8) == brute(rows, shared)


def test_one_conversation_holds_most_rows_and_spans_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(4)] + [(c, 0, "user", "turn 0") for c in range(300, 330)]
    assert nodes(spark, rows, False, shards=9) == brute(rows, False)


def test_pieces_of_ends_join(spark, monkeypatch):
    """Ids of one node in several pieces and several shards, in numeric order."""
    rows = [(c, 0, "user", "same") for c in range(-5, 9500)]
    found = nodes(spark, rows, False, shards=2)
    ids = ",".join(map(str, range(-5, 9500)))
    assert (1, -5, -5, 9505, 0, 1, 9504 * 4, hashlib.sha256(ids.encode()).hexdigest()) in found and len(found) == 2


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(1, None, "b", "x"), (1, 0, None, None), (1, 0, "a", "y"), (1, 0, "a", "y"), (None, 0, "a", "y"), (100, 1, "a", "y"), (7, 0, "a", "z" * 100_000)]
    assert nodes(spark, rows, True) == brute(rows, True)
    assert nodes(spark, rows, False, shards=5) == brute(rows, False)
    assert nodes(spark, [], True) == []


def test_a_conversation_without_turns_left_is_a_member_of_the_root(spark):
    """Its head comes from a conversation that is not there, and it has no turns after it."""
    c = next(c for c in range(201, 300) if crc32(str(c).encode()) % 6 == 5)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone")]
    assert nodes(spark, rows) == [(0, c, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())] == brute(rows, True)


def test_role_and_text_do_not_run_into_each_other(spark):
    rows = [(1, 0, "us", "er: hi"), (2, 0, "user", ": hi")]
    assert len(nodes(spark, rows, False)) == 3


def test_extra_columns(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a")]
    more = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], TURNS + ", path string, conv string, SHARD int")
    found = prefix_trie(paths(more)).collect()
    assert sorted(r.convs for r in found) == [2, 2]
