import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kind string, node string, bins string, a string, t string, chunk string, th string"


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text[, lang, source]) with extra columns whose names clash with inner ones."""

    def make(rows):
        full = [(i, t, *(r[0] if r else (None, None)), len(t) if t is not None else None, "k", "n", "b", "a", "t", "c", "h") for i, t, *r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


EDGE = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "é漢🙂 " * 40), (None, "a null id has this text, which is long enough to matter here"),
    (8, "word " * 4000), (9, "\x00\x01 odd"), (10, "x" * 5000),
]


@pytest.fixture
def edge(docs):
    return docs(EDGE)
