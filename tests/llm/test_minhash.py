import random

import numpy as np
from pyspark.sql import functions as F

from timeloom.llm.components import components
from timeloom.llm.minhash import SKETCH, Circulant, _Search, _sketch, difference_keys, keep_one, linked, near_groups, shingles


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(docs, n):
    sets = {i: grams(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 40)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((k, (" " if k % 2 else "\n").join(copy).upper() if k % 3 else " ".join(copy)))
            k += 1
    return docs + [(k, None), (k + 1, ""), (k + 2, " \t"), (k + 3, "alone"), (k + 4, "Alone"), (k + 5, "two words")]


def test_like_brute_force_also_with_split_buckets(frame):
    for width, few in ((2, 32), (5, 32), (2, 2)):
        docs = corpus(width + few)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(frame(*docs), width=width, few=few).collect()}
        assert got == brute(docs, width)


def test_keep_one(frame):
    docs = frame((1, "a b c d e f g"), (2, "A B C D E F G"), (3, "else"), (3, "else"), (4, None), (None, "n")).withColumnRenamed("lang", "bands")
    out = keep_one(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None"]
    assert near_groups(frame().limit(0)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(frame):
    """No text goes that is nobody's copy, whatever its id; near copies under one id are one."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = frame((1, a), (1, b), (2, b), (5, a), (6, b + " more"), (6, "new text of its own here"), (0, ""), (0, ""))
    for parts in (1, 5):
        out = sorted((r.doc_id, r.text) for r in keep_one(docs.repartition(parts)).collect())
        assert out == [(0, ""), (0, ""), (1, a), (1, b), (6, "new text of its own here")]


def test_shingles_of_pieces_are_those_of_the_whole():
    text = " ".join(f"w{i % 5000}x" for i in range(120_000)).encode()
    assert len(shingles(text, 2)) == 5000 and len(shingles(b"y " * 9, 3)) == 1
    assert len(shingles(b"a" * 600_000 + b" b", 1)) == 2


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 64, 1200, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    s = Circulant(512, 1).signatures([a, b])
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.08


def test_components_of_chain_star_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (59, 100), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 7 for i in [*range(7, 60), *range(100, 141)]} | {900: 900, 901: 900}


def test_differences_with_a_hub_lose_no_link():
    """Any two linked sets of which one is not linked with the hub share one of the first elements of their differences."""
    rng = random.Random(4)
    common = np.array([rng.randrange(4) for _ in range(1 << 6)])
    met = 0
    for _ in range(300):
        pool = [rng.randrange(1 << 64) for _ in range(rng.choice([6, 30, 120]))]

        def make(s, share, pool=pool):
            return np.array(sorted({x if rng.random() > share else rng.choice([*pool, rng.randrange(1 << 64)]) for x in s}), np.uint64)

        hub = make(pool, 0)
        sets = []
        for _ in range(4):
            mid = make(hub.tolist(), rng.choice([0.0, 0.05, 0.1, 0.2, 0.4]))
            sets += [mid, *[make(mid.tolist()[: rng.randrange(3 * len(mid) // 4, len(mid) + 1)], rng.choice([0.02, 0.08, 0.15])) for _ in range(3)]]
        found = [difference_keys(hub, s, 80, common) for s in sets if len(s)]
        sets = [s for s in sets if len(s)]
        for i, (near_x, far_x, long_x) in enumerate(found):
            for j, (near_y, far_y, _) in enumerate(found):
                same = np.array_equal(sets[i], sets[j]) or np.array_equal(sets[i], hub) or np.array_equal(sets[j], hub)
                if near_x or same or not linked(sets[i], sets[j], len(np.intersect1d(sets[i], sets[j])), 80):
                    continue
                met += 1
                assert len(np.intersect1d(long_x if near_y else far_x, far_y))
    assert met > 500


def test_sketches_let_linked_pairs_pass(spark):
    """Pairs at or just above the threshold pass, pairs well below it are excluded, for small and large sets."""
    rng, rows = np.random.default_rng(3), []
    for k in range(900):
        n, far = (20, 150, 600, 4000)[k % 4], k % 3 == 0
        size = n * 9 if far else n
        differ = size if far else int(2 * n / 9)
        pool = [int(x) for x in rng.integers(0, 1 << 63, n + differ)]
        sets = [pool[:n], pool[differ // 2 : n + differ // 2]] if not far else [pool[:n], pool[n // 4 : n + n // 4]]
        texts = [" ".join(map(str, s)) for s in sets]
        rows += [(2 * k, texts[0], far), (2 * k + 1, texts[1], far)]
    frame = spark.createDataFrame(rows, "id long, text string, far boolean")
    words = ", ".join(f"{w} long" for w in SKETCH)
    facts = frame.select("id", "text").mapInArrow(_sketch(1, 28, 4, 11), f"id long, n long, hi long, lo long, bands array<long>, {words}").join(frame.select("id", "far"), "id")
    search = _Search(frame, facts, 1, 80, 20)
    x, y = facts.where("id % 2 = 0").alias("x"), facts.where("id % 2 = 1").alias("y")
    got = x.join(y, F.expr("x.id + 1 = y.id and not (x.far and x.n > 2000)")).groupBy("x.far").agg(F.avg(search.alike("x", "y").cast("int")).alias("share"))
    share = {r.far: r.share for r in got.collect()}
    assert share[False] == 1 and share[True] < 0.02


def test_text_ids_and_ids_that_are_null(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three FOUR"), ("c", ""), (None, "one two three four")], "doc_id string, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_groups(docs, width=2).collect()}
    assert got == {("a", 3, "a"), ("b", 3, "a"), ("c", 0, "c"), (None, 3, None)}
