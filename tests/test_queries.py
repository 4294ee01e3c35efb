import pytest

from docgraph.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(compare, name):
    compare(QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)
