"""Every registered query of the subpackage on small tables with nulls, empty and repeated texts."""

import math
import random
import zlib
from collections import Counter

import duckdb
import pytest

from timeloom.llm import queries as Q
from timeloom.llm.token_counts import encoding

from .test_minhash import brute


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, rng = str(tmp_path_factory.mktemp("sf")), random.Random(8)
    words = ["the", "and", "Thing", "über", "que", "élan", "of", "x1", "idiot", "scum"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts = base + base[:10] + [base[3] + "\n", base[4].upper(), None, "", " \t", "12 !", "alone"]
    docs = [(i, t, ["en", "de", None][i % 3], [None, "a", "b", "ä"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    conversations = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(base) + f" {t}" if (c + t) % 5 else f"same line {t}") for c in range(12) for t in range(4)]
    pages = [(i, f"http://h/{i}", rng.choice(base) * (i % 7)) for i in range(50)] + [(90, None, None)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(1, base[0] + " tail"), (2, "the and"), (3, None), (10, base[1])], "item_id long, text string"),
        ("pages", pages, "page_id long, url string, html string"),
        ("labels", [(i, 1, int("idiot" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int"),
        ("conversations", conversations, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path, docs


def plain(rows):
    return sorted(str(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_like_sql(spark, tables, name):
    got = Q.QUERIES[name](spark, tables[0])
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{tables[0]}/{t}.parquet/*.parquet'")
    want = con.execute(Q.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())


def test_token_totals(spark, tables):
    e, want = encoding(Q.TOKENIZER), {}
    for _, text, lang, source, _ in tables[1]:
        if (text or "").strip(" "):
            n, k = want.get((source, lang), (0, 0))
            want[source, lang] = (n + 1, k + len(e.encode_ordinary(text)))
    assert {(r.source, r.lang): (r.docs, r.tokens) for r in Q.op2_token_counts(spark, tables[0]).collect()} == want


def test_toxicity_and_language_rows(spark, tables):
    ids = sorted(d[0] for d in tables[1])
    tox, lang = Q.op3_toxicity(spark, tables[0]).collect(), Q.op9_language_id(spark, tables[0]).collect()
    assert sorted(r.doc_id for r in tox) == ids and sorted(r.doc_id for r in lang) == ids
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in tox)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in lang)
    for (i, text, *_), r in zip(sorted(tables[1], key=lambda d: d[0]), sorted(lang, key=lambda r: r.doc_id), strict=True):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))


def test_shards_and_near_copies(spark, tables):
    rows = Q.op7_sharding(spark, tables[0]).collect()
    size = {d[0]: (len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in tables[1]}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == size and {r.law for r in rows} == {"key"}
    per = Counter(r.shard for r in rows)
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in per.items()) and max(per) < 40
    assert math.isclose(sum(r.grown_shard == 40 for r in rows) / len(rows), 1 / 41, abs_tol=0.08)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op10_near_dedup(spark, tables[0]).collect()}
    assert got == brute([(d[0], d[1]) for d in tables[1]], 2)
