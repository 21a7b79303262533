"""The training-data queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from conftest import assert_same

from prospectrum.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_rows_match_the_sql(spark, sf_dir, name):
    assert assert_same(llm.QUERIES[name](spark, sf_dir), llm.ORACLES[name], sf_dir) > 0
