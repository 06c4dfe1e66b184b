import os

import pytest

from timeloom.llm.queries import TOKENIZER
from timeloom.llm.token_counts import Rollup, count_tokens, deleted, encoding, inserted, revised

COUNTS = "source string, lang string, version string, tokens long, old_tokens long"

needs_file = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")


@needs_file
def test_counts_like_the_library(frame):
    texts = ["Hello world", "", None, "größer als  zwei\n\n", "a b " * 700_000, "x" * 3000]
    got = {r.doc_id: r.tokens for r in count_tokens(frame(*enumerate(texts)), TOKENIZER).collect()}
    e = encoding(TOKENIZER)
    assert got == {i: len(e.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_batches_count_once_and_add_up(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), COUNTS)
    r = Rollup(spark, str(tmp_path / "r"))
    assert r.totals().count() == 0
    first = make(("a", "en", "v1", 10, None), ("a", "en", "v1", 5, None), (None, None, "v1", 7, None), ("b", "de", "v1", None, None))
    assert r.commit("1", inserted(first)) and not r.commit("1", inserted(first))
    assert r.commit("2", deleted(make(("a", "en", "v1", 5, None), ("b", "de", "v1", None, None))))
    assert r.commit("3", revised(make(("a", "en", "v1", 12, 10))))
    got = {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in r.totals().collect()}
    assert got == {("a", "en", "v1"): (1, 12), (None, None, "v1"): (1, 7)}


def test_lost_batch_is_written_anew(spark, tmp_path):
    r = Rollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "en", "v", 3, None)], COUNTS)
    assert r.commit("first/one", inserted(rows)) and r.commit("2", inserted(rows))
    (last,) = (tmp_path / "r").glob("00000002-*/_SUCCESS")
    last.unlink()
    assert r.totals().first().tokens == 3 and not r.committed("2")
    assert r.commit("2", inserted(rows)) and r.totals().first().tokens == 6
    assert not Rollup(spark, str(tmp_path / "r")).commit("first/one", inserted(rows))


def test_reading_takes_one_version_and_old_ones_go(spark, tmp_path):
    r = Rollup(spark, str(tmp_path / "r"))
    for i in range(5):
        assert r.commit(str(i), inserted(spark.createDataFrame([("a", "en", "v", i, None)], COUNTS)))
    assert len(r.totals().inputFiles()) >= 1 and all("00000005-" in f for f in r.totals().inputFiles())
    assert r.totals().first().tokens == 10 and r.totals().first().docs == 5
    assert not any(f.suffix == ".parquet" for k in (1, 2, 3) for d in (tmp_path / "r").glob(f"0000000{k}-*") for f in d.iterdir())


def test_empty_table_and_columns_that_clash(spark, frame):
    assert count_tokens(frame().limit(0), TOKENIZER).count() == 0
    got = count_tokens(frame((1, None)).withColumnRenamed("source", "tokens"), TOKENIZER).first()
    assert got.tokens == 0 and "text" not in got.asDict()
