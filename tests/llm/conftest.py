import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from (id, text) or (id, text, lang, source) rows."""

    def make(*rows):
        full = [(r + (None,) * 5)[:4] + (len(r[1]) if r[1] else None,) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)
