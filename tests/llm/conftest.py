import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, and an extra column with a name used by results."""
    long = "word " * 60_000
    rows = [
        (1, "alpha beta gamma delta epsilon\nA line of text\na LINE of text \n", "en", "src0", 3, 7),
        (1, "alpha beta gamma delta epsilon\nA line of text\na LINE of text \n", "en", "src0", 3, 7),
        (2, None, None, None, None, None),
        (None, "A line of text\nother", None, "src1", 1, 1),
        (3, "", "", "", 0, 0),
        (4, "\n\n \n", "en", "src1", 4, 2),
        (5, long + "\n" + long, "de", "src0", 5, 1),
        (6, "\x1f  \U0001f600 a\x0bb\x0cc\r\nA line of text", "fr", None, None, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA + ", n_words int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
