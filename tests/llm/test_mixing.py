import pytest

from timeloom.llm.mixing import mix, mixture, targets


def shares(sizes, most=3):
    """By hand: pour out the total, round after round."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        above = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in open_}
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, "c": 2, None: 5}, {"x": 100}, {"ä": 7, "z": 0, "Z": 90, "é": 1, None: 3}])
def test_targets_like_pouring(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = shares(sizes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_taken_words_near_targets_and_bounded(frame):
    docs = [(i, " ".join(["w"] * (1 + i % 37)), "en", f"s{i % 4}" if i % 50 else None) for i in range(2000)]
    rows = mixture(frame(*docs)).collect()
    assert len(rows) == 2000
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.03 * mine[0].target + 40
        assert all(r.taken <= 3 * r.size for r in mine)
    assert rows and sorted(map(str, rows)) == sorted(map(str, mixture(frame(*docs).repartition(7)).collect()))
    many = {r.doc_id: r.taken for r in mixture(frame(*docs), max_small=1).collect()}
    assert many == {r.doc_id: r.taken for r in rows}


def test_mix_repeats_documents(frame):
    docs = frame((1, "a b c", "en", "p"), (2, None, "en", "q"), (3, "", "en", "p"), (4, "d", "en", "q"))
    copies = {r.doc_id: r.copies for r in mixture(docs).collect()}
    out = mix(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    assert mixture(frame().limit(0)).count() == 0 and mix(frame().limit(0)).count() == 0


def test_each_document_is_taken_with_the_probability_of_its_fraction(frame):
    """600 sources alike: one text of 300 words and ten of 10; long texts are taken as often as short ones."""
    docs = [(100 * s + i, "w " * (300 if i == 0 else 10), "en", f"s{s:03}") for s in range(600) for i in range(11)]
    rows = mixture(frame(*docs)).collect()
    for weight in range(3):
        mine = [r for r in rows if int(r.source[1:]) % 3 == weight]
        rate = mine[0].target / mine[0].source_size
        for long in (True, False):
            copies = [r.copies for r in mine if (r.size == 300) == long]
            sd = (0.25 / 200) ** 0.5
            assert abs(sum(copies) / len(copies) - rate) < 4 * sd


def test_rows_without_or_with_equal_ids_and_clashing_columns(frame):
    docs = frame((None, "a b c", "en", "p"), (None, "d e f", "en", "p"), (5, "x " * 3000, "en", "q"), (5, "x " * 3000, "en", "q"), (6, "y", "en", None)).withColumnRenamed("lang", "target").withColumnRenamed("n_chars", "Size")
    copies = mixture(docs).collect()
    assert len(copies) == 5 and len({r.copies for r in copies if r.doc_id == 5}) == 1
    out = mix(docs)
    assert out.columns == docs.columns
    for text in ("a b c", "d e f"):
        assert out.where(f"text = '{text}'").count() <= 3
    assert out.count() == sum(r.copies for r in copies)


@pytest.mark.parametrize("same_id", [True, False])
def test_equal_rows_come_near_the_target(frame, same_id):
    """1,000 equal rows, without id or with one, beside 1,000 others of their source and one more source."""
    docs = [(7 if same_id else None, "a b c d e", "en", "p")] * 1000 + [(100 + i, "a b c d e", "en", "p") for i in range(1000)] + [(5000 + i, "v w x y z", "en", "q") for i in range(1000)]
    rows = mixture(frame(*docs)).collect()
    for s in ("p", "q"):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.01 * mine[0].target
    assert sorted(map(str, rows)) == sorted(map(str, mixture(frame(*docs)).collect()))
    n = mix(frame(*docs)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in n} == {s: sum(r.copies for r in rows if r.source == s) for s in ("p", "q")}
