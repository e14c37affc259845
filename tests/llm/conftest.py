import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, lang="en", source="s"):
        data = [(i, t, lang, source if isinstance(source, str) else source[k], len(t or ""), 7, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, fp int, root string")

    return make
