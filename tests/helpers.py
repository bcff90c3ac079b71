"""Small frames for tests."""

from __future__ import annotations

import datetime as dt

from sensorloom.schema import EVENT_SCHEMA

START = dt.datetime(2026, 1, 15, 12, 0, 0)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def event_row(event_id, room, sensor, value, minutes, unit=None, status=None):
    return (event_id, room, sensor, None if value is None else float(value), unit, at(minutes), status)


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
