import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns."""
    def make(rows):
        data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return make
