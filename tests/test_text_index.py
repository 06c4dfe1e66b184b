import random

import pytest

from timeloom.operators.ranking import bm25
from timeloom.sources.text_index import TextIndex

TEXTS, QUERIES = "chunk_id string, text string", "query_id long, text string"
WORDS = ["the", "Sea", "a", "wind", "海", "über", "x_1", "now"]


def texts(n, seed=0, head="c"):
    pick = random.Random(seed)
    return [(f"{head}{i:03d}", None if i % 17 == 3 else " ".join(pick.choices(WORDS, weights=range(1, 9), k=pick.choice([0, 1, 9, 60])))) for i in range(n)]


def got(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "the the sea wind"), (2, "海 x_1 nowhere"), (3, ""), (4, None)], QUERIES)


def pool(spark, chunks):
    return spark.createDataFrame([(q, c) for q in (1, 2, 3, 4) for c, _ in chunks[q::2]], "query_id long, chunk_id string")


def plain(spark, asked, chunks):
    whole = spark.createDataFrame(chunks, TEXTS)
    return got(bm25(asked, pool(spark, chunks), corpus=whole, texts=whole))


def test_same_as_without_an_index(spark, asked, tmp_path):
    chunks = texts(80)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4).build(spark.createDataFrame(chunks, TEXTS))
    found = got(index.bm25(asked, pool(spark, chunks)))
    assert found == plain(spark, asked, chunks) and len(found) > 30


def test_upserts_and_removals(spark, asked, tmp_path):
    chunks = texts(60)
    index = TextIndex(spark, str(tmp_path / "i"), buckets=4).build(spark.createDataFrame(chunks, TEXTS))
    new = texts(9, seed=5) + texts(5, seed=6, head="n") + [("c010", ""), ("c011", "only theword")]
    index.upsert(spark.createDataFrame(new, TEXTS))
    index.remove(spark.createDataFrame([("c020",), ("never",)], "chunk_id string"))
    now = {c: t for c, t in [*chunks, *new] if c != "c020"}
    left = sorted(now.items())
    assert got(index.bm25(asked, pool(spark, left))) == plain(spark, asked, left)
    assert {(r.term, r.chunk_id) for r in index.postings.read().collect()} == {(t, r.chunk_id) for r in index.forward.read().collect() for t in r.terms}


def test_only_buckets_of_changed_terms_are_rewritten(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=16).build(spark.createDataFrame(texts(60), TEXTS))
    before = index.postings.manifest()["folders"]
    touched = index.upsert(spark.createDataFrame([("new", "unheard words")], TEXTS))
    after = index.postings.manifest()["folders"]
    assert len(touched) <= 2 and {b for b in before if after[b] != before[b]} <= {str(b) for b in touched}


def test_empty(spark, asked, tmp_path):
    index = TextIndex(spark, str(tmp_path / "i"), buckets=2).build(spark.createDataFrame([], TEXTS))
    assert got(index.bm25(asked, pool(spark, texts(5)))) == []
    index.upsert(spark.createDataFrame([("a", "the sea")], TEXTS))
    assert len(got(index.bm25(asked, spark.createDataFrame([(1, "a")], "query_id long, chunk_id string")))) == 1
