import pytest


@pytest.fixture()
def docs(spark):
    """documents rows from (doc_id, text) pairs, with columns that clash with
    names the operators use."""
    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src", len(t or ""), "x", "y", 0.5, "z") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, fingerprint string, score double, label string")
    return make
