"""What the physical plans of the named queries may and may not contain."""

import subprocess
import sys

import pytest

from driftline.plans import load_all
from tests.conftest import SMALL

QUERIES = load_all()[0]

# Queries whose plan is a read of what a stream or job wrote.
PLANNED = sorted(n for n in QUERIES if not n.startswith(("stream_", "cv_", "grid_", "forest_", "dash_")))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cross_join(spark, name):
    plan = physical(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_filters_and_columns_reach_the_scan(spark):
    plan = physical(QUERIES["drift_categorical"](spark, SMALL))
    assert "LessThan(l_shipdate" in plan and "GreaterThanOrEqual(l_shipdate" in plan
    reads = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert reads and all("l_extendedprice" not in line for line in reads)


def test_cost_join_sums_before_it_shuffles(spark):
    plan = physical(QUERIES["cost_monthly"](spark, SMALL))
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "l_extendedprice" in line and "FileScan" in line)
    above = "\n".join(lines[:scan][-4:])
    assert "partial_sum" in above


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_a_missing_library_of_the_training_data_leaves_the_other_queries():
    code = (
        "import sys; sys.modules['ahocorasick'] = None\n"
        "import __spark_entry__ as e; found = e.queries()\n"
        "assert len(found) > 100 and len(e.oracle_sql()) > 100 and not any(n.startswith('op') for n in found)"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
