"""Repeated rows whose passages stand shifted in another document lose no text in both."""

import pytest

from casebook.llm import prefix_free
from tests.llm.samples import documents, prose
from tests.llm.test_repeats import _want


@pytest.mark.parametrize(("hot", "parts", "dense"), [(48, 64, 20_000), (2, 3, 20_000), (48, 64, 1)])
def test_a_repeated_row_keeps_what_stands_first_in_it(spark, monkeypatch, hot, parts, dense):
    for name, value in (("HOT", hot), ("PARTS", parts), ("DENSE", dense)):
        monkeypatch.setattr(prefix_free, name, value)
    base = prose(1, 80)
    rows = [(1, base), (1, base), *[(2 + k, prose(20 + k, 9) + base[13 * k + 7 : 330] + prose(40 + k, 9)) for k in range(8)], (2, prose(20, 9) + base[7:330] + prose(40, 9))]
    got = sorted(map(tuple, prefix_free.removal_digests(documents(spark, rows)).collect()), key=str)
    assert got == _want(rows)
    assert [r[2] for r in got if r[0] == 1] == [0, 0]
