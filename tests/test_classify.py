"""Boundaries of the threshold table."""

import pytest
from helpers import dicts, event_row, events
from pyspark.sql import functions as F

from sensorloom.operators.classify import classify, classify_by_table, explain_breaches, rule_frame
from sensorloom.schema import Rule

NAN, INF = float("nan"), float("inf")

CASES = [
    # sensor, value, status, breach
    ("temperature", 5, "alert", "critical_low"), ("temperature", 10, "alert", "critical_low"),
    ("temperature", 10.01, "warning", "low"), ("temperature", 17.99, "warning", "low"),
    ("temperature", 18, "normal", None), ("temperature", 21.5, "normal", None), ("temperature", 26, "normal", None),
    ("temperature", 26.01, "warning", "high"), ("temperature", 29.99, "warning", "high"),
    ("temperature", 30, "alert", "critical_high"), ("temperature", 55, "alert", "critical_high"),
    ("temperature", -4, "alert", "critical_low"),
    ("humidity", 0, "alert", "critical_low"), ("humidity", 20, "alert", "critical_low"),
    ("humidity", 20.5, "warning", "low"), ("humidity", 29.99, "warning", "low"), ("humidity", 30, "normal", None),
    ("humidity", 70, "normal", None), ("humidity", 70.5, "warning", "high"), ("humidity", 79.99, "warning", "high"),
    ("humidity", 80, "alert", "critical_high"), ("humidity", 100, "alert", "critical_high"),
    ("occupancy", -1, "warning", "low"), ("occupancy", 0, "normal", None), ("occupancy", 20, "normal", None),
    ("occupancy", 21, "warning", "high"), ("occupancy", 29, "warning", "high"), ("occupancy", 30, "alert", "critical_high"),
    ("motion", 0, "normal", None), ("motion", 1, "normal", None), ("motion", 9999, "normal", None),
    ("temperature", NAN, "normal", None), ("humidity", INF, "normal", None), ("occupancy", -INF, "normal", None),
]


@pytest.fixture(scope="module")
def frame(spark):
    return events(spark, [event_row(str(i), "r", s, v, i) for i, (s, v, _, _) in enumerate(CASES)])


def test_boundaries(spark, frame):
    got = {int(r["event_id"]): r["status"] for r in dicts(classify(frame))}
    assert got == {i: c[2] for i, c in enumerate(CASES)}


def test_rule_table_agrees(spark, frame):
    table = {r["event_id"]: r["status"] for r in dicts(classify_by_table(frame, rule_frame(spark)))}
    assert table == {r["event_id"]: r["status"] for r in dicts(classify(frame))}


def test_breaches(spark, frame):
    got = {int(r["event_id"]): r["breach"]["kind"] for r in dicts(explain_breaches(frame))}
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3]}
    texts = {int(r["event_id"]): r["breach"] for r in dicts(explain_breaches(frame))}
    assert texts[9] == {
        "kind": "critical_high", "limit": 30.0, "severity": "alert",
        "text": "temperature 30.0°C reaches the critical maximum 30.0°C",
    }


@pytest.mark.parametrize(
    "supplied,value,final",
    [("alert", 20, "alert"), ("alert", 27, "alert"), ("warning", 20, "warning"), ("warning", 31, "alert"),
     ("normal", 27, "warning"), (None, 20, "normal"), (None, 31, "alert")],
)
def test_status_is_only_raised(spark, supplied, value, final):
    df = events(spark, [event_row("e", "r", "temperature", value, 0, status=supplied)])
    assert dicts(classify(df))[0]["status"] == final


def test_own_rules(spark):
    rules = [Rule("co2", None, None, 1000.0, 2000.0)]
    df = events(spark, [event_row(str(v), "r", "co2", v, 0) for v in (400, 1000, 1001, 2000)])
    assert {r["event_id"]: r["status"] for r in dicts(classify(df, rules))} == {
        "400": "normal", "1000": "normal", "1001": "warning", "2000": "alert",
    }


def test_default_rules_need_no_join(spark, frame):
    plan = classify(frame).filter(F.col("status") == "alert")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
