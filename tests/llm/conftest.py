import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(os.path.dirname(HERE)), HERE]

SF = "/root/testdata/sf0.001"
#: more columns of a table, with names that operators use themselves
CLASH = "doc_id bigint, text string, lang string, score double, n bigint, h bigint, node bigint, k1 string, __x int"


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} of the long text" for i in range(30_000))
    texts = ["The quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog", None, "", "   \t\n", long, "!!! 123 456",
             "one", "One", "é ß ñ 日本語 \U0001F600 text", "a  b   c"]
    rows = [(i, t, "en" if i % 2 else "fr", float(i), i, i, i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id at all here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con
