import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row_no string, bucket string"


@pytest.fixture
def table(spark):
    """A documents table of (doc_id, text[, lang[, source]]) with extra columns of clashing names."""

    def make(rows):
        full = []
        for r in rows:
            doc, text, lang, source = (*r, *[None] * 4)[:4]
            full.append((doc, text, lang, source, None if text is None else len(text), "x", "y"))
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties and a very long text."""
    long = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
    base = "the quick brown fox jumps over the lazy dog and runs far away from here to there again"
    return [
        (1, base, "en", "a"), (1, base, "en", "a"), (2, None, None, None), (3, "", "en", ""), (4, " \n\t ", "en", "b"), (5, base + " now", "en", "a"),
        (6, long, "en", "b"), (7, long, "en", None), (8, "é" * 60, "fr", "c"), (9, "12 34 !!", None, "c"), (None, base, "en", "a"), (10, "one two", "en", "a"),
    ]
