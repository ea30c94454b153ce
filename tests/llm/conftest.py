import pytest


@pytest.fixture()
def docs_of(spark):
    """A documents table of (doc_id, text[, lang]) rows, with a column of a clashing name."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", 0, 1.0) for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
        return spark.createDataFrame(full, schema)

    return make


ODD = [(None, None), (None, "x"), (1, None), (2, ""), (3, " \n\t "), (4, "long word " * 30_000), (5, "x"), (5, "x"), (6, "é\x00𝄞")]


@pytest.fixture()
def odd_docs(docs_of):
    """Null ids and texts, empty and very long texts, ties and repeated rows."""
    return docs_of(ODD)
