import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def documents():
    """doc_id and text of the small documents."""
    return dict(duckdb.connect().execute(f"select doc_id, text from '{MIDDLE}/documents.parquet'").fetchall())


@pytest.fixture
def odd_documents(spark):
    """Nulls, empty and long texts, ties and repeated rows, with columns whose names clash with inner ones."""

    def build(*extra):
        base = "one two three four five six seven eight nine ten eleven twelve " * 3
        rows = [(1, base), (2, base), (2, base), (3, base + "more"), (4, None), (5, ""), (6, "   \n"), (7, "word"), (8, "Word"), (None, base.upper()), (9, "x " * 4000), (10, "é" * 3000)]
        rows += list(extra)
        return spark.createDataFrame([(i, t, "en", "s", 7, "k") for i, t in rows], "doc_id long, text string, lang string, source string, score int, key string")

    return build
