"""Registered queries against their SQL oracle on the smallest tables."""

import pytest

from casebook.plans.catalog import ORACLES, QUERIES
from tests.conftest import SMALL

#: The heaviest context queries repeat the whole inquiry job; their parts are covered by the others.
SLOW = {"context_leakage", "context_line_counts", "passage_blocks", "inquiry_citations", "milestone_passages", "winner_passages"}


def _plain(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query_matches_oracle(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(tuple(_plain(row[c]) for c in columns) for row in frame.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(row[i]) for i in places) for row in result.fetchall())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
