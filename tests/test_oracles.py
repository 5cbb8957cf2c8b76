import pytest

from compare import connect, differences
from zipfloom.plans import corpus, problems, reports

QUERIES = {n: f for m in (problems, reports, corpus) for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in (problems, reports, corpus) for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    assert differences(QUERIES[name], ORACLES[name], spark, sf, con) == ([], [])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).columns


def test_names_are_told_apart():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    numbered = [n for n in QUERIES if n[0] == "p" and n[1].isdigit()]
    assert {n.split("_")[0] for n in numbered} <= {"p1", "p2", "p4"}
