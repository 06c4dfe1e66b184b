import random

from pyspark.sql import functions as F

from timeloom.llm.decontaminate import WuManber, decontaminate, find_items, words_of

ITEMS = "item_id long, text string"


def brute(docs, items, window=10):
    out = {}
    for i, text in docs:
        w = words_of(text.encode() if text else None)
        hit, names = set(), set()
        for item, t in items:
            p = words_of(t.encode() if t else None)
            m = min(window, len(p))
            for k in range(len(p) - m + 1) if m else ():
                for s in range(len(w) - m + 1):
                    if w[s : s + m] == p[k : k + m]:
                        hit |= set(range(s, s + m))
                        names.add(str(item))
        out[i] = (len(w), len(hit), sorted(names))
    return out


def test_like_brute_force(spark, frame):
    rng = random.Random(1)
    word = lambda: rng.choice(["a", "b", "c", "Dé", "e1"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 10, 12, 14])))) for i in range(1, 6)] + [(9, ""), (10, None), (1, "a b c a b c a b c a b")]
    docs = [(i, "!".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(100, None), (101, ""), (102, "... --")]
    for size in (1 << 20, 40):  # one block, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in find_items(frame(*docs), spark.createDataFrame(items, ITEMS), block_bytes=size).collect()}
        assert got == brute(docs, items)


def test_shift_skips_what_no_item_has():
    s = WuManber(4)
    s.add(tuple(b"one two three four".split()), "x")
    assert [p for p, _ in s.search(b"zero one two three four five".split())] == [1]
    assert s.shift[b"three", b"four"] == 0 and s.shift[b"one", b"two"] == 2


def test_long_text_repeats_empty_and_clashing_columns(spark, frame):
    items = spark.createDataFrame([(1, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10")], ITEMS)
    long = " ".join(["filler"] * 200_000) + " k1 k2 k3 k4 k5 k6 k7 k8 k9 K10"
    docs = frame((1, long), (2, "clean"), (2, "clean")).withColumnRenamed("lang", "row").withColumnRenamed("source", "n_hit")
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2]
    assert find_items(frame().limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).count() == 3


def test_several_blocks_like_one_with_repeated_and_null_ids(spark, frame):
    items = spark.createDataFrame([(1, "k1 k2 k3"), (2, "k3 k4"), (3, "m1 m2"), (4, "m3")], ITEMS)
    rows = [(1, "k1 k2 k3 k4 m3"), (1, "clean"), (1, "m1 m2 x m3"), (2, "clean"), (2, "clean"), (None, "k3 k4"), (None, "none here"), (None, None), (3, "m1 m2"), (3, "m1 m2")]
    docs = frame(*rows)
    shown = lambda size: sorted((str(r.doc_id), r.n_words, r.n_hit, [tuple(h) for h in r.hits], r.item_ids) for r in find_items(docs, items, block_bytes=size).collect())
    assert len(shown(8)) == len(rows) and shown(8) == shown(1 << 20)
    tagged = docs.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    for d in (docs, tagged):
        kept = [sorted((str(r.doc_id), str(r.text)) for r in decontaminate(d, items, block_bytes=size).collect()) for size in (8, 1 << 20)]
        assert kept[0] == kept[1] == [("1", "clean"), ("2", "clean"), ("2", "clean"), ("None", "None"), ("None", "none here")]
