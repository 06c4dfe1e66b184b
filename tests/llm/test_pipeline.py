import random
from collections import Counter

import duckdb

import corpus_pipeline as P
from timeloom.llm.decontaminate import find_items
from timeloom.llm.queries import SQL

from .test_minhash import brute, corpus


def test_stages_on_a_small_corpus(spark, frame, tmp_path):
    rng = random.Random(6)
    base = [[rng.choice([f"word{chr(97 + a)}{chr(97 + b)}" for a in range(9) for b in range(9)]) for _ in range(60)] for _ in range(40)]
    docs = [(i, " ".join(w), "en" if i % 2 else "de", f"s{i % 3}") for i, w in enumerate(base)]
    item = " ".join(f"bench{chr(97 + i)}" for i in range(14))
    docs += [(100, " ".join(base[0][:59] + ["other"]), "en", "s0"), (101, " ".join(base[1]), "en", "s1")]
    docs += [(200, "before " + item, "en", "s0"), (300, None, "en", "s0"), (301, "12 34", "en", "s0")]
    frame(*docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "sharding"]
    at, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stage(spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r.doc_id for r in at.collect()})
        if name != "sharding":
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert seen[0] == {d[0] for d in docs} - {300, 301}
    assert seen[1] == seen[0] - {100, 101}
    assert seen[2] == seen[1] - {200}
    assert seen[4] == seen[3] <= seen[2]
    assert Counter(r.doc_id for r in spark.read.parquet(f"{tmp_path}/source_mix").collect()) == Counter(r.doc_id for r in at.collect())
    assert find_items(at, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_hit > 0").count() == 0


def plain_sql(sql, **tables):
    """The rows of SQL over tables that are given as (schema, rows)."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        con.execute(f"create table {name} ({schema})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(schema.split(',')))})", rows)
    return con.execute(sql).fetchall()


def test_each_stage_like_brute_force(spark, frame, tmp_path):
    """Every stage's rows against a plain computation over the rows that it was given."""
    docs = [(i, t, "en" if i % 2 else "de", f"s{i % 3}" if i % 7 else None) for i, t in corpus(3)]
    item = " ".join(f"bench{chr(97 + i)}" for i in range(11))
    docs += [(800 + k, f"start {k} {item} end", "en", "s1") for k in range(3)] + [(900, "12 34", "en", "s0"), (901, None, None, None), (902, "long words " * 5_000, "en", "s2")]
    frame(*docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given, at = docs, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        rows = [tuple(r)[:4] for r in at.collect()]
        table = [(i, t, s) for i, t, _, s in given]
        if name == "language_id":
            want = Counter(d[0] for d in given if any(map(str.isalpha, d[1] or "")))
        elif name == "near_dedup":
            want = Counter(i for i, (_, component) in brute([d[:2] for d in given], 5).items() if i == component)
        elif name == "decontamination":
            found = plain_sql(f"select doc_id, contaminated from ({SQL['op1_decontamination']})", documents=("doc_id bigint, text varchar, source varchar", table), benchmark=("item_id bigint, text varchar", [(1, item), (2, None)]))
            want = Counter(i for i, bad in found if not bad)
        elif name == "source_mix":
            found = plain_sql(f"select doc_id, size, taken from ({SQL['op6_mixing']})", documents=("doc_id bigint, text varchar, source varchar", table))
            want = Counter(i for i, size, taken in found for _ in range(taken // size))
        else:
            want = Counter(d[0] for d in given)
            slots = {}
            for r in at.collect():
                slots.setdefault(r.shard, []).append(r.slot)
            assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert Counter(r[0] for r in rows) == want, name
        given = rows


def test_empty_table_and_columns_that_clash(spark, frame, tmp_path):
    frame().write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    docs = frame((1, "some words here", "en", "a"), (1, "some words here", "en", "a"), (None, "other words there", "en", "a"), (None, None, None, None)).withColumnRenamed("n_chars", "key")
    at = docs
    for name, stage in P.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
    assert {r.doc_id for r in at.collect()} <= {1, None}
