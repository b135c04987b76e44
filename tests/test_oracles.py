"""Every registered query with a SQL check, on the smallest data."""

import pytest
from compare import differences, duck
from conftest import SMALL

from dugout.plans.registry import ENTRIES


#: Queries whose right result on the smallest data has no rows.
EMPTY_HERE: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_its_sql(name, lake, con):
    found = differences(ENTRIES[name].run(lake), con, ENTRIES[name].sql)
    assert found in (None, "no rows") if name in EMPTY_HERE else found is None


def test_every_query_has_a_check():
    assert [n for n, e in ENTRIES.items() if not e.sql] == []


def test_entry_point(spark):
    import __spark_entry__ as entry

    board = entry.entry(spark)
    assert board.columns == ["batter_id", "pa", "xwoba", "woba", "k_pct", "bb_pct", "hr_pct", "avg", "batter_name"]
    assert 0 < board.count() <= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
