"""Registered queries against their SQL."""

import pytest
from oracle import connect, duck_rows, spark_rows

from loomgrain.llm.queries import QUERIES
from loomgrain.llm.sql import ORACLE_SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(connect(SF), ORACLE_SQL[name])


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
