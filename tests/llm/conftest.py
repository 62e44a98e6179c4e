import duckdb
import pytest

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names could clash."""
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000
    rows = [
        (1, "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "en", "s"),
        (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "en", "s"), (5, long, "en", "s"), (5, long, "en", "s"),
        (6, long, "de", "s"), (None, "a text without an id", "en", "s"), (7, "é漢字 ß \x00 <|endoftext|> don't", "fr", "s"), (8, "word", "en", "s"),
        (9, "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen fifteen sixteen.", "en", "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
    return df.selectExpr("*", "1 AS _id", "2 AS _gone", "3 AS id", "4 AS n_sentences", "'x' AS token", "5 AS component", "6 AS _tid", "7 AS kh")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
