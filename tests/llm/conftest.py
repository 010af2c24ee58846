import pytest

LONG = "word " * 3 + " ".join(f"w{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal
    texts under several ids, and columns named like the operators' own."""
    plain = "one two three four five six seven eight nine ten " * 12
    rows = [
        (1, plain, "en", "a", 10), (1, plain, "en", "a", 10), (2, plain, None, "a", None), (3, None, "en", None, None),
        (4, "", "en", "b", 0), (5, " \t\n ", "en", "b", 4), (None, plain, "en", "b", 1), (None, None, None, None, None),
        (6, LONG, "en", "a", len(LONG)), (7, "x", "en", "c", 1), (8, "\U0001f600 éè á \x1c mit license", "en", "c", 9),
    ]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "doc row_key words pos word w q_words q_row q_n label class bucket h fp row other stretch s at i start length item body".split()
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, kind).select("*", *(F.lit("clash").alias(c) for c in clash))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def texts():
    import duckdb

    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    return dict(rows)
