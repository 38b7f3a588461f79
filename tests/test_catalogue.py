"""Every query of the catalogue against its SQL, and plans without accidental Python or Cartesian products."""

import pytest

from compare import rows
from folioworks.plans.queries import ORACLE_SQL, QUERIES

PYTHON = {"structured_markdown"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    out = QUERIES[name](spark, data)
    got = out.toPandas()
    assert len(got)
    if name not in ORACLE_SQL:
        assert name in PYTHON
        return
    assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["decide_default", "planner_pages", "threshold_sweep", "reading_order", "table_stitch", "line_groups", "latency_stats"])
def test_plan(spark, data, name):
    plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 3
    assert set(e.oracle_sql()) <= set(e.queries())
