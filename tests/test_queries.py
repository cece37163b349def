"""Every query with SQL gives the rows of DuckDB; the others give some rows."""

import pytest
from compare import connect, differences

from gridlens.plans import QUERIES, SQL

# Their rows are compared with SQL; a second training only to see the plan is left out.
TRAINED = [n for n in QUERIES if n.startswith(("train_", "cross_validated"))]


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, folder, duck, name):
    assert differences(QUERIES[name](spark, folder), duck, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_gives_rows(spark, folder, name):
    assert len(QUERIES[name](spark, folder).take(1)) == 1


NO_PRODUCT = sorted(n for n in SQL if n not in ("ridge_one_feature", "lasso_one_feature", *TRAINED))


@pytest.mark.parametrize("name", NO_PRODUCT)
def test_plan_has_no_cross_join(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
