import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents of texts, doc_ids from 0."""

    def make(texts, extra=None):
        rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
