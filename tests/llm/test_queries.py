"""Registered queries run, and equal their SQL where they have one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracle import connect, difference  # noqa: E402

from leaksieve.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        assert difference(connect(SF), queries.ORACLES[name], frame) is None
    else:
        assert frame.count() > 0


def test_numbers():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
