"""Every registered query against its SQL counterpart, value by value, types included."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tallyvox.plans.oracle import ORACLE
from tallyvox.plans.queries import QUERIES
from tallyvox.plans.stream_queries import STREAM_QUERIES

OWN = {**QUERIES, **STREAM_QUERIES}

TYPES = {
    "VARCHAR": "string",
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(OWN) == set(ORACLE)
    assert set(OWN) <= set(queries()) and set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, sf_dir, duck, name):
    found = queries()[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = duck.sql(oracle_sql()[name])
    assert names == sorted(expected.columns)
    types = dict(zip(expected.columns, (TYPES[str(t)] for t in expected.types)))
    assert dict(found.dtypes) == types
    quoted = ", ".join(f'"{n}"' for n in names)
    want = duck.sql(f"SELECT {quoted} FROM ({oracle_sql()[name]}) z").fetchall()
    have = [tuple(row) for row in found.select(*names).collect()]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry(spark).count() > 0
