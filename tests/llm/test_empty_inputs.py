import os

import pytest

from zipfloom.llm import queries


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    """The tables with their columns, one more of a clashing name, and no rows."""
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(sf):
        spark.read.parquet(f"{sf}/{f}").limit(0).selectExpr("*", "'x' as _range", "1 as _chunk", "'y' as term").write.parquet(f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0 or name in ("p3_report", "p3_targets")


@pytest.fixture(scope="module")
def hollow(spark, sf, tmp_path_factory):
    """The tables with a few rows, of which all columns are null, and the same again."""
    folder = tmp_path_factory.mktemp("hollow")
    for f in os.listdir(sf):
        df = spark.read.parquet(f"{sf}/{f}").limit(3)
        nulls = df.selectExpr(*[f"cast(null as {t}) as `{c}`" for c, t in df.dtypes])
        nulls.union(nulls).write.parquet(f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_only_nulls(spark, hollow, name):
    got = queries.QUERIES[name](spark, hollow).collect()
    assert got == [] or name in ("p3_report", "p3_targets", "p7_ids", "p9_documents", "p8_report", "p8_kept")
