import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timeloom.functions import text as X
from timeloom.functions.dictionary import find_names
from timeloom.operators import chunks as C
from timeloom.sources import corpus

HEADS = {"book": "Book", "part": "Part", "prologue": "Prologue$", "chapter": r"Ch\d+\s+"}


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def test_tokens_trim_and_lines(spark):
    assert one(spark, X.tokens(F.col("t")), "Größe A_1 中文 x.Y") == ["gr", "e", "a_1", "中", "文", "x", "y"]
    assert one(spark, X.tokens(F.col("t")), None) == []
    assert one(spark, X.strip(F.col("t")), "　\t a b \n　") == "a b"
    assert one(spark, X.split_lines(F.col("t")), "a\r\nb c\n\nd\n") == "a\r\nb c\n\nd\n".splitlines()
    assert one(spark, X.split_lines(F.col("t")), "") == []


def test_mentions_in_list_order_with_aliases(spark):
    m = X.mentions(F.col("t"), ["Ann", "Bob", "Cy"], {"Bobby": "Bob", "Doc": "Dee"})
    assert one(spark, m, "Cy met Bobby and Doc") == ["Bob", "Cy", "Dee"]
    assert one(spark, X.piped(m), "Ann") == "|Ann|" and one(spark, X.piped(m), "none") == ""


def test_sections_carry_reset_and_drop(spark):
    long = "x" * 600
    text = "\n".join(["  intro", "", "Book 1", "Part A", "Ch1 one", "", long, "", "more ", "Ch2 short", "tiny", "Prologue", long, "Ch3 three", long, "Book 2", "Ch4 four", "y" * 500, "Ch5 empty"])
    rows = C.sections(spark.createDataFrame([(1, text), (2, None), (3, "only front")], "doc_id long, text string"), HEADS).orderBy("doc_id", "section_index").collect()
    assert [(r.doc_id, r.section_index, r.book, r.part, r.section_title) for r in rows] == [
        (1, 1, None, None, "front_matter"),
        (1, 2, "Book 1", "Part A", "Ch1 one"),
        (1, 3, "Book 1", None, "Prologue"),
        (1, 4, "Book 1", None, "Ch3 three"),
        (1, 5, "Book 2", None, "Ch4 four"),
        (3, 1, None, None, "front_matter"),
    ]
    assert rows[0].body == "intro" and rows[1].body == long + "\n\nmore"


def test_sections_by_ranges_of_lines_are_those_by_document(spark):
    rng = random.Random(2)
    kinds = ["Book {}", "Part {}", "Prologue", "Ch{} x", "", " plain {} ", "x" * 30, "x" * 30, "plain\x0c{}"]
    text = lambda n: "\n".join(rng.choice(kinds).format(rng.randrange(99)) for _ in range(n))
    docs = spark.createDataFrame([(0, text(3000)), (1, "no heading " * 20), (2, ""), (None, text(200)), *[(i, text(5)) for i in range(3, 40)]], "doc_id long, text string")
    want = sorted(map(repr, C.sections(docs, HEADS, 40).collect()))
    lines = docs.select("doc_id", F.posexplode(X.split_lines(F.col("text"))).alias("line_no", "raw"), F.lit("z").alias("range"))
    for at in ({"ranges": 1}, {"ranges": 13}, {"segment": F.floor(F.col("line_no") / 7)}):
        assert sorted(map(repr, C.sections_of_lines(lines, HEADS, 40, **at).collect())) == want
    assert len({r.p for r in lines.repartitionByRange(13, "doc_id", "line_no").where("doc_id = 0").select(F.spark_partition_id().alias("p")).distinct().collect()}) > 5
    empty = C.sections_of_lines(lines.limit(0), HEADS)
    assert empty.count() == 0 and empty.columns == C.sections(docs, HEADS).columns
    nulls = spark.createDataFrame([(1, 0, None), (1, 1, "Ch1 a"), (1, 2, None), (1, 3, "body")], "doc_id long, line_no int, raw string")
    assert [(r.section_title, r.body) for r in C.sections_of_lines(nulls, HEADS, 1, F.col("line_no")).collect()] == [("Ch1 a", "body")]


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    text = "\n".join(rng.choice(["Book {}", "Part {}", "Ch{} x", "l\x0cm {}", "y" * 50]).format(i) for i in range(4000))
    (tmp_path / "one.txt").write_text(text)
    (tmp_path / "two.txt").write_text("Ch1 a\r\nbody of two\r\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = corpus.read_lines(spark, str(tmp_path))
        assert lines.select("line_no.block").distinct().count() > 4
        got = sorted(map(repr, C.sections_of_lines(lines, HEADS, 5, F.col("line_no.block")).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == sorted(map(repr, C.sections(corpus.read_texts(spark, str(tmp_path)), HEADS, 5).collect()))


def test_a_large_dictionary_says_what_scans_say(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    names, aliases = [word() for _ in range(60)] + ["一", ""], {word(): rng.choice(["Ann", "ab", "b"]) for _ in range(20)}
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randrange(40)))) for i in range(80)] + [(80, None), (81, ""), (82, "一 abc"), (82, "一 abc"), (83, "d" * 300_000 + "abc")]
    docs = spark.createDataFrame(texts, "i int, t string")
    for n, a in ((names, aliases), (names[:-1], None), ([], aliases), ([], {})):
        both = docs.select(find_names(F.col("t"), n, a).alias("found"), X.mentions(F.col("t"), n, a).alias("want")).collect()
        assert len(both) == len(texts) and all(r.found == r.want for r in both)
    many = ["name%06d" % i for i in range(5000)]
    assert docs.limit(1).select(find_names(F.lit("x name004999 name000007name"), many).alias("f")).first().f == ["name000007", "name004999"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab。；，\n ", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter_properties(text, size, overlap):
    chunks = C.split_recursively(text, size, overlap, ["\n\n", "\n", "。", "；", "，", ""])
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert all(c in text for c in chunks)
    whole, joined = "".join(text.split()), "".join("".join(chunks).split())
    assert joined == whole if overlap == 0 else len(whole) <= len(joined) <= len(whole) + overlap * len(chunks)


def test_splitter_without_hard_cut_and_fixed_window(spark):
    assert C.split_recursively("abcdefghij。k", 5, 1, ["。"]) == ["abcdefghij", "。k"]
    want = C.split_recursively("0123456789" * 7, 20, 5, [""])
    assert one(spark, C.split_fixed(F.col("t"), 20, 5), "0123456789" * 7) == want
    assert one(spark, C.split_fixed(F.col("t"), 20, 5), "short") == ["short"] and one(spark, C.split_fixed(F.col("t"), 20, 5), "") == []
    with pytest.raises(ValueError):
        C.split_column(5, 5, [""])


def test_chunk_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select((F.col("id") % 30).alias("doc_id"), F.col("id").alias("piece"), F.lit("T1").alias("stage"))
    want = [r.piece for r in rows.orderBy("doc_id", "piece").collect()]
    for n in (1, 7):
        got = C.number_chunks(rows.repartition(n), ["doc_id", "piece"]).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in got] == list(range(300)) and [r.piece for r in got] == want
        assert got[7].chunk_id == "novel_T1_000007"


def test_stage_rules_in_order_and_unknown_stage(spark):
    rules = [({"book": "III"}, "T3"), ({"book": "I", "text": "late"}, "T2"), ({"book": "I"}, "T1")]
    frame = spark.createDataFrame([("III", "x"), ("I", "late"), ("I", "x" * 1200 + "late"), (None, "late")], "book string, text string")
    assert [r.s for r in frame.select(C.infer_stage(rules, "T0").alias("s")).collect()] == ["T3", "T2", "T1", "T0"]
    timeline = spark.createDataFrame([("T1", 1, "a")], "stage string, stage_order int, anchor string")
    with pytest.raises(ValueError, match="T9"):
        C.known_stages(spark.createDataFrame([("T9",), ("T1",)], "stage string"), timeline)
