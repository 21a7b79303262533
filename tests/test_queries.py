"""Every query of the reference's operators, against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from conftest import assert_same

from prospectrum import queries as own


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_rows_match_the_sql(spark, sf_dir, name):
    assert_same(own.QUERIES[name](spark, sf_dir), own.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_queries_without_sql_run(spark, sf_dir, name):
    df = own.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as e

    first, second = e.entry(spark), e.entry(spark)
    assert first.schema == second.schema and first.count() == 3
    assert set(e.oracle_sql()) <= set(e.queries())
