import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, token string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents with an extra column, over several partitions, from (doc_id, text[, source]) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeats and white space of all kinds."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one"),
        (5, "a b c d e f g h i j " * 4000),
        (6, "Ünï — 漢字 😀 don't  STOP"),
        (7, "one"),
        (7, "one"),
        (8, "x" * 50000),
        (9, "<|endoftext|> tail"),
        (10, "\x0b\x0c\rz y\x00w"),
    ]
