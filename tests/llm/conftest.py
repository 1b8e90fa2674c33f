import pytest

#: Every kind of row that a table of documents may hold: no id, no text, no words, ties, repeats, a very long text.
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all day long", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, " \n\t ", "de", None),
    (5, LONG, "en", "a"),
    (None, "the quick brown fox jumps over the lazy dog and runs away from it all day long", None, None),
    (None, None, None, None),
    (7, "eins zwei drei\nvier fünf", "de", "b"),
    (7, "eins zwei drei\nvier fünf", "de", "b"),
    (7, "another text under the same id", "de", "c"),
    (8, "\u0000 nul \U0001f600 ünï wide", "fr", "c"),
]
CLASHES = "leak long, tox long, language string, rejected_by string, lines string, `_row` long, `_size` long, `_at` string"


@pytest.fixture(scope="session")
def hostile(spark):
    """Documents of all kinds, with columns named like the operators' own."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    return spark.createDataFrame([(i, t, la, s, 0, 1, 2, "l", "r", "x", 3, 4, "at") for i, t, la, s in ROWS], schema).repartition(3).cache()


@pytest.fixture(scope="session")
def documents(spark):
    """(id, text) pairs to a table."""

    def build(pairs, parts=2):
        return spark.createDataFrame(list(pairs), "doc_id long, text string").repartition(parts)

    return build


@pytest.fixture(scope="session")
def nothing(hostile):
    return hostile.limit(0)
