"""Every registered retrieval query against its SQL on the smallest tables."""

import pytest
from oracle import connect, duck_rows, spark_rows

from loomgrain.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert spark_rows(catalogue.QUERIES[name](spark, SF)) == duck_rows(connect(SF), catalogue.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_plans(spark):
    """Top-k stays a top-k, and workspaces are filtered at the scan."""
    df = catalogue.QUERIES["vector_topk_ws"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.replace("TakeOrderedAndProject", "")
    assert "In(label" in plan
