"""The registered queries: their names, their SQL, and that all cover their whole table."""

import re

import pytest

import __spark_entry__
from casebook.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))
    registered = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(registered)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    result = duck.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_a_row_for_every_row(spark, name):
    table = {"op1": "pages", "op11": "embeddings", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    got = QUERIES[name](spark, SMALL)
    if name.startswith("op12_"):
        got = got.select("doc_id").distinct()
    assert got.count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()
