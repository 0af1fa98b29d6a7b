"""The text queries with SQL against it."""

from __future__ import annotations

import pytest
from oracle import canonical, connect, spark_rows, sql_rows

from panelworks.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert canonical(spark_rows(QUERIES[name](spark, DATA))) == canonical(sql_rows(connect(DATA), ORACLES[name]))
