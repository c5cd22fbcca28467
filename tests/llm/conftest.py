import pytest

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in each column, empty, blank and very long texts, ties, repeated rows, and columns with names that operators might use."""
    long = "word " * 30000 + "end."
    rows = [(1, "Alpha beta gamma. Delta epsilon zeta!", "en", "s", 5), (1, "Alpha beta gamma. Delta epsilon zeta!", "en", "s", 5), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "  \n\t ", "de", "s", 3), (None, "No id here at all, none.", "en", "s", 1), (5, long, "en", "s", 9), (6, "12 34 !!", "fr", "s", 2), (7, "Über größe straße", "de", "t", 3), (8, "Alpha beta gamma. Delta epsilon zeta!", "en", "t", 5)]
    return spark.createDataFrame([(*r, i % 3, i, "x", "y", 0.5) for i, r in enumerate(rows)], DOC + ", k bigint, n int, cid string, key string, score double")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
