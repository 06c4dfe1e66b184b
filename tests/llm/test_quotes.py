from pyspark.sql import functions as F

from timeloom.llm.quotes import link_quotes, passages

TURNS = "conv_id long, turn long, role string, text string"


def test_links_nested_quotes_and_orders(spark):
    turns = [
        (1, 0, "user", "Hello  there\nsecond line"),
        (1, 1, "assistant", "> hello there\nAn answer"),
        (1, 2, "user", ">> Hello there\n> an ANSWER\nThanks"),
        (1, 3, "user", "> second line\nBack to you"),
        (2, 0, "user", "> An answer\nfrom elsewhere"),
        (2, 1, "assistant", "> never said\nplain"),
        (3, 5, "user", None),
        (3, 9, "user", ">>>"),
        (None, 1, "user", "no conversation"),
        (1, None, "user", "no turn"),
    ]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(turns, TURNS)).collect()}
    assert len(got) == len(turns)
    assert got[1, 1].content == "An answer" and got[1, 2].content == "Thanks"
    assert (got[1, 2].quote_levels, got[1, 2].quoted, got[1, 2].linked, got[1, 2].reply_turn) == (2, 2, 2, 1)
    assert (got[1, 3].reply_conv, got[1, 3].reply_turn) == (1, 0)
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn) == (1, 1)
    assert (got[2, 1].linked, got[2, 1].reply_turn) == (0, 0)
    assert (got[1, 3].linked, got[2, 0].quoted) == (1, 1)  # a line of a passage, a passage of another conversation
    assert (got[2, 0].thread_conv, got[2, 0].thread_turn, got[2, 0].depth, got[2, 1].depth) == (1, 0, 2, 3)
    assert got[3, 9].content == "" and got[3, 9].reply_turn == 5
    assert [got[1, t].position for t in (None, 0, 1, 2, 3)] == [0, 1, 2, 3, 4]


def test_one_line_everywhere_does_not_multiply(spark):
    turns = [(c, t, "user", "same" if t == 0 else "> same\nreply") for c in range(300) for t in range(2)]
    got = link_quotes(spark.createDataFrame(turns, TURNS)).collect()
    assert len(got) == 600 and all(r.reply_turn == 0 and r.reply_conv == r.conv_id for r in got if r.turn == 1)


def test_empty_repeated_long_and_plan(spark, capsys):
    assert link_quotes(spark.createDataFrame([], TURNS)).count() == 0
    long = "> q\n" * 20_000 + "end"
    out = link_quotes(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "user", long), (1, 1, "user", long)], TURNS))
    assert sorted((r.position, r.quoted) for r in out.collect()) == [(0, 0), (1, 1), (2, 1)]
    out.explain()
    assert "Python" not in capsys.readouterr().out


def test_passages_are_runs_of_lines(spark):
    text = "own\n> a\n>  b\n>> deep\n> c\n\nlast\r\n>"
    rows = spark.createDataFrame([(1, 1, 7, text), (1, 2, 8, "")], "conv long, turn long, uid long, text string")
    got = [(r.level, r.said) for r in passages(rows).where("uid = 7").orderBy("passage").collect()]
    assert got == [(0, "own"), (1, "a\n b"), (2, "deep"), (1, "c"), (0, "\nlast"), (1, "")]


def test_threads_follow_replies_in_a_long_chain_and_a_star(spark):
    chain = [(1, t, "user", f"> word {t - 1}\nword {t}" if t else "word 0") for t in range(70)]
    star = [(2, t, "user", "> start\nanswer" if t else "start") for t in range(40)]
    got = {(r.conv_id, r.turn): r for r in link_quotes(spark.createDataFrame(chain + star, TURNS).withColumn("node", F.lit(1))).collect()}
    assert all((got[1, t].thread_turn, got[1, t].depth) == (0, t) for t in range(70))
    assert all(got[2, t].depth == min(t, 1) for t in range(40))
