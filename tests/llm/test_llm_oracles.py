import pytest
from compare import differences, duck

from dugout.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ORACLE_SQL)
@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_its_sql(spark, name, sf_dir):
    assert differences(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE_SQL[name]) is None


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14)) and set(QUERIES) < set(names) and "pipeline" in names
    assert set(ORACLE_SQL) < set(entry.oracle_sql()) <= set(names)
