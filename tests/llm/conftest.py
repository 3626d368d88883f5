import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, `piece` string, `score` string, `a.b` string"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with null, empty, repeated and long texts, and columns whose names clash with results."""

    def make(texts, ids=None):
        rows = [(ids[i] if ids else i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make

