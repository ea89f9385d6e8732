import pytest
from check_oracle import connect, difference
from conftest import SF

import __spark_entry__ as entry

# the catalogue's SQL tries every pattern on every text; it is checked by check_oracle.py
NAMES = [n for n in entry._QUERIES if not n.startswith("scan_catalogue")]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    frame = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    assert sql, "every registered query has SQL"
    assert difference(con, sql, frame) is None
