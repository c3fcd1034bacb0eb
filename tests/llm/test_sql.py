"""Corpus queries that SQL can express, value by value."""

import pytest

from tallyvox.llm.queries import LLM_QUERIES, LLM_SQL

TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "BOOLEAN": "boolean", "INTEGER": "int"}


def test_a_query_for_every_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM_QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query(spark, sf_dir, duck, name):
    found = LLM_QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    expected = duck.sql(f"SELECT {', '.join(names)} FROM ({LLM_SQL[name]}) z")
    assert dict(found.dtypes) == dict(zip(names, (TYPES[str(t)] for t in expected.types)))
    have = [tuple(row) for row in found.select(*names).collect()]
    assert sorted(have, key=repr) == sorted(expected.fetchall(), key=repr)
