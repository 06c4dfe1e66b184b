import hashlib
import random
import re

import pytest

from timeloom.llm.exact_dedup import _flush, _hits, exact_dedup


def brute(docs):
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    out = []
    for key, members in groups.items():
        keep = min(members)[1]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(key.encode()).hexdigest()) for _, i in members]
    return sorted(out)


@pytest.mark.parametrize("bits", [256, 8])
def test_like_brute_force_with_and_without_collisions(spark, frame, bits):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a b", "ab", "a\tb\n", "", None, "é ", "é", " ", "x" * 50])) for i in range(60)] + [(100 + i, f"own {i}") for i in range(300)]
    got = exact_dedup(frame(*docs), digest_bits=bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs)


def test_empty_repeated_and_null_ids(frame):
    assert exact_dedup(frame().limit(0)).count() == 0
    same = exact_dedup(frame((3, "t"), (3, "t"), (4, "t"))).collect()
    assert [(r.keep_id, r.group_size) for r in same] == [(3, 3)] * 3
    assert sorted(r.kept for r in same) == [False, True, True]
    null = {r.doc_id: r.keep_id for r in exact_dedup(frame((None, "q"), (7, "q"))).collect()}
    assert null == {None: 7, 7: 7}


def test_no_python_in_the_plan(frame, capsys):
    exact_dedup(frame((1, "a"))).explain()
    assert "Python" not in capsys.readouterr().out


def test_many_runs_full_filters_long_texts_and_text_ids(spark):
    rng = random.Random(5)
    docs = [(f"k{i:03}", rng.choice(["a b", "ab", "z" * 2_000_000, "z" * 1_999_999 + " z", f"own {i}"]), 1) for i in range(120)]
    table = spark.createDataFrame(docs, "doc_id string, text string, Size int").withColumnRenamed("Size", "digest")
    for bits in (6, 20):
        got = exact_dedup(table, memtable_rows=10, filter_bits=bits)
        assert sorted(tuple(r) for r in got.collect()) == brute([d[:2] for d in docs])


def test_runs_are_sorted_and_filters_tell_what_is_in_two_runs(spark):
    rows = [(i, 1, bytes([i % 40]), i * 7) for i in range(50)]
    members = spark.createDataFrame(rows, "id int, n int, digest binary, spread long")
    flushed = _flush(members, 5)
    for r in range(5):
        run = [x.digest for x in flushed.where(f"run = {r}").collect()]
        assert run == sorted(run) and len(set(run)) == len(run)
    places = {}
    for i, _, d, s in rows:
        places.setdefault(bytes(d), set()).add(s % 5)
    several = {d for d, runs in places.items() if len(runs) > 1} | {bytes([i % 40]) for i in range(50) if sum(x[2] == bytes([i % 40]) for x in rows) > 1}
    assert {bytes(x.digest) for x in _hits(flushed, 16).collect()} == several
