import pytest

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away " * 20),
    (2, "the quick brown fox jumps over the lazy dog and runs away " * 20),
    (2, "the quick brown fox jumps over the lazy dog and runs away " * 20),
    (3, None),
    (4, ""),
    (None, "a row without an id, Released under the MIT License."),
    (5, "é ü ß 漢字 \n\n  \t one two three"),
    (6, "word " * 60_000),
    (7, " \n".join(f"line number {i} of a text that is not short at all" for i in range(300))),
    (8, "x" * 30_000 + "\n" + "7" * 5_000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", f"src{i}", len(t or ""), 1.5, "x", b"y", 3) for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, bitmap binary, n_hit int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
