import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{SF}/documents.parquet' order by 1").fetchall()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long, tied and repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, None, 1), (1, "", 2), (2, long, 3), (3, long, 4), (4, long + " end", 5), (6, "one two", 6), (7, "one two", 7), (8, "é" * 300, 8), (9, "x" * 5000, 9), (10, " \t ", 10)]
    return spark.createDataFrame([(d, t, None, "s", n, n, n) for d, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, size long, sig long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
