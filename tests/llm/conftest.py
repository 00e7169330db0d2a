import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) rows; other columns are filled in."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)

    return make


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h"), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, "no id here at all"), (7, "é 中文 😀 ñ" * 3), (8, "long words here " * 20_000), (9, "nul\x00and\x85odd\xa0spaces\x1c")]


@pytest.fixture(scope="session")
def awkward(docs_of):
    """Nulls, blanks, repeats, a missing id, other scripts, a long text."""
    return docs_of(AWKWARD)


@pytest.fixture(scope="session")
def nothing(docs_of):
    return docs_of([])
