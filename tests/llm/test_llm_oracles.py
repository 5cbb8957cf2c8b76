import pytest

from compare import connect, differences
from zipfloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert differences(QUERIES[name], ORACLES[name], spark, sf, connect(sf)) == ([], [])


@pytest.mark.parametrize("name", ["p3_sample", "p3_report", "p8_mix", "p8_report", "p9_found", "p9_documents", "p9_stretches", "p6_days"])
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
