import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 7919} and" for i in range(60_000))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "web", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and blank texts, repeated rows and ids, one long text."""
    rows = [(1, None), (2, ""), (3, "  \n\t "), (None, "no id here at all"), (4, "same text twice over"), (4, "same text twice over"), (4, "another text with that id"), (5, LONG), (None, None, None)]
    return documents(rows)
