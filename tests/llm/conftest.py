import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or longer tuples."""

    def rows(*given):
        full = [(*g, *(None,) * (5 - len(g))) for g in given]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return rows


@pytest.fixture(scope="session")
def odd():
    """(doc_id, text) with every trouble that a table may hold."""
    long = " ".join(f"w{i % 5003}x{i % 17}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "same text here"), (6, "same  text\there"), (5, "same text here"), (None, "same text here"), (None, None), (7, long), (8, long), (9, "ünïcödé — 漢字 🙂"), (10, "a" * 100_000)]
