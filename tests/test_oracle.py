"""Every registered query against its SQL, and the shape of its plan."""

import os

import oracle
import pytest

import __spark_entry__ as entry
from sensorloom import plans

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")

plans.load_all()
OWN = sorted(plans.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", OWN)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert oracle.compare(df, duck, entry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", [n for n in OWN if not n.startswith("stream")])
def test_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flagship(spark):
    small = oracle.connect(entry.SMOKE_DIR)
    assert oracle.compare(entry.entry(spark), small, entry.oracle_sql()[entry.FLAGSHIP]) == []


def test_time_filters_reach_the_scan(spark):
    plan = entry.queries()["analysis_slice"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [GreaterThanOrEqual(ts,2024-01-08T00:00), LessThan(ts,2024-01-15T00:00)" in plan


def test_stored_log_is_pruned_by_date_and_room(spark):
    plan = entry.queries()["stored_room_events"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(ts), IsNotNull(room_id)" in plan
