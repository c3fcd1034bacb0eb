from __future__ import annotations

import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def documents(duck):
    """(doc_id, text) of the small table."""
    return duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()


LONG = "Lorem ipsum dolor sit amet. " * 20_000


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and empty texts, a very long one, repeated rows, ties, and columns that clash."""
    texts = [None, "", " ", "a", "A b", "same text here", "same text here", LONG, "É\u00a0x\u200d😀", "x" * 5000]
    rows = [(i, t, f"k{i}", i, i, float(i), "row") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (20, "same text here", None, 1, 2, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, bits string, shard int, slot int, score double, row string"
    )


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, extra int")
