import os

import duckdb
import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


#: Texts with the cases that every operator must take: null, empty, blank, ties, repeats, clashing characters.
ODD_TEXTS = [None, "", " ", "\n", "a", "A b", "a b c", "one  two\tthree\n\nfour ", "x" * 5000, "w " * 3000, "line one\nLINE ONE \n line one\nother", "line one\nLINE ONE \n line one\nother", "é ü ñ 中文 😀 \x1c\x85　 end", "</s>[INST] ok [/INST]", "### $$$ &&& " * 40]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Columns whose names clash with those that operators make."""
    rows = [(i, x, ["a", "b", None][i % 3], i * 2, "extra") for i, x in enumerate(ODD_TEXTS)] + [(3, "a b c", "a", 1, None), (None, "a b c", None, None, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size long, fp string")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size long, fp string")
