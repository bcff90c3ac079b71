"""Schemas and the fixed values of the sensor domain."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- fixed values: the interface of the domain, to be matched exactly -------
SENSOR_TYPES = ("temperature", "motion", "occupancy", "humidity")
EVENT_STATUSES = ("normal", "warning", "alert")
ROOM_STATUSES = ("active", "warning", "alert", "offline")
REQUIRED_FIELDS = ("room_id", "sensor_type", "value", "timestamp")
ROOM_ID_LENGTH = (1, 50)
UNITS = {"temperature": "°C", "humidity": "%", "occupancy": "people", "motion": "boolean"}
UNKNOWN_UNIT = "unknown"
DEFAULT_EVENT_STATUS = "normal"
DEFAULT_ROOM_STATUS = "active"
ROOM_EVENTS_LIMIT = 50
RECENT_EVENTS_LIMIT = 100
HISTORY_LIMIT = 100
HOURLY_TIERS = {"free": 1000, "standard": 10000}
BURST_PER_MINUTE = 100
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Bounds of one sensor; a bound that is None never matches."""

    sensor_type: str
    critical_min: float | None
    min: float | None
    max: float | None
    critical_max: float | None


# The default threshold table.
DEFAULT_RULES = (
    Rule("temperature", 10.0, 18.0, 26.0, 30.0),
    Rule("humidity", 20.0, 30.0, 70.0, 80.0),
    Rule("occupancy", None, 0.0, 20.0, 30.0),
)

RULE_SCHEMA = T.StructType(
    [T.StructField("sensor_type", T.StringType(), False)]
    + [T.StructField(b, T.DoubleType()) for b in ("critical_min", "min", "max", "critical_max")]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("room_id", T.StringType()),
        T.StructField("sensor_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

# What the accepted log holds; it is partitioned by ``event_date``.
LOG_SCHEMA = T.StructType(
    [
        *EVENT_SCHEMA.fields,
        T.StructField("detected_status", T.StringType()),
        T.StructField("event_date", T.DateType()),
    ]
)
LOG_FIELDS = tuple(f for f in LOG_SCHEMA.fieldNames() if f != "event_date")

ROOM_STATE = T.StructType(
    [
        T.StructField("temperature", T.DoubleType()),
        T.StructField("motion", T.BooleanType()),
        T.StructField("occupancy", T.IntegerType()),
        T.StructField("humidity", T.DoubleType()),
    ]
)

ROOM_SCHEMA = T.StructType(
    [
        T.StructField("room_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("last_update", T.TimestampType()),
        T.StructField("current_state", ROOM_STATE),
        T.StructField("alert_count_24h", T.LongType()),
    ]
)
