import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from timeloom.llm import importance
from timeloom.llm.importance import cutoff, resample

DOCS = "doc_id long, text string"


def features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target):
    s, t = Counter(), Counter()
    for rows, n in ((docs, s), (target, t)):
        for _, x in rows:
            n.update(features(x)[1])
    big_s, big_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for i, x in docs:
        w, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return out, able[: 25 * len(able) // 100]


def found(spark, docs, target, **kwargs):
    got = resample(spark.createDataFrame(docs, DOCS), spark.createDataFrame(target, DOCS), **kwargs).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str), [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])], sorted(r["rank"] for r in got if r["rank"])


def made(n, seed=3):
    pick = random.Random(seed)
    words = ["Alpha", "beta", "ä", "x9", "Straße", "東京", "tion"]
    return [(i, " ".join(pick.choices(words, k=pick.choice([0, 5, 19, 20, 21, 60])))) for i in range(n)]


@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_same_as_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(importance, "PIECE", piece)
    docs, target = made(300), made(12, 5)
    docs += [(-4, "one. two, THREE " * 30), (999, "a" * 50_000 + " b" * 30), (1000, None), (1001, "")]
    rows, drawn = brute(docs, target)
    got, order, ranks = found(spark, docs, target)
    assert got == sorted((r[:4] for r in rows), key=str)
    assert order == [(r[0], r[3]) for r in drawn] and ranks == list(range(1, len(drawn) + 1))


def test_pieces_of_a_text_give_what_the_whole_gives(monkeypatch):
    text = ("Ab cd, " * 40 + "x" * 300 + " end").encode()
    whole = sorted(f for _, b in importance.buckets_of(text, 1000, 3) for f in b)
    monkeypatch.setattr(importance, "PIECE", 7)
    pieces = [*importance.buckets_of(text, 1000, 3)]
    assert len(pieces) > 9 and sorted(f for _, b in pieces for f in b) == whole and sum(n for n, _ in pieces) == 82


def test_ties_repeats_and_null_ids(spark):
    """Equal rows, without and with an id: as many are drawn as are wanted, ids before no ids."""
    text = "same words " * 10
    docs = [(None, text)] * 9 + [(5, text)] * 40
    _, order, ranks = found(spark, docs, [(1, "other")])
    assert len(order) == 12 and ranks == list(range(1, 13))
    assert set(order) == {max({(r[0], r[3]) for r in brute(docs, [(1, "other")])[0]}, key=lambda x: x[1])} or len(set(order)) == 2


def test_fewer_than_a_draw_and_empty_tables(spark):
    assert found(spark, [(1, "few words")], [])[1:] == ([], [])
    assert found(spark, made(3), [])[0] == sorted((r[:4] for r in brute(made(3), [])[0]), key=str)
    assert found(spark, [], made(3)) == ([], [], [])


def test_cutoff_goes_through_all_keys(spark):
    rows = spark.createDataFrame([(a, b, c) for a in range(4) for b in range(-3, 3) for c in range(5)], "a long, b long, c long")
    order = sorted((a, b, c) for a in range(4) for b in range(-3, 3) for c in range(5))
    for want in (1, 5, 7, 30, 31, 119, 120):
        last = cutoff(rows, want, ["a", "b", "c"])
        assert sum(x[: len(last)] <= tuple(last) for x in order) == want


def test_extra_columns(spark):
    docs = made(40)
    more = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], DOCS + ", score int, RANK int, row string")
    got = resample(more, spark.createDataFrame(made(5, 8), DOCS)).collect()
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got) == sorted(r[:4] for r in brute(docs, made(5, 8))[0])
