"""Defaults for unit, status and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.ids import derived_event_id
from sensorloom.schema import DEFAULT_EVENT_STATUS, UNITS, UNKNOWN_UNIT


def default_unit(sensor_type: Column) -> Column:
    unit = F.lit(UNKNOWN_UNIT)
    for sensor, name in UNITS.items():
        unit = F.when(sensor_type == sensor, name).otherwise(unit)
    return unit


def enrich(df: DataFrame, literal_ids: bool = False) -> DataFrame:
    """Fill unit, status and event id; supplied values are kept.

    ``literal_ids`` leaves the sensor out of a derived id.
    """
    have = set(df.columns)

    def given(name: str) -> Column:
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    sensor = None if literal_ids else F.col("sensor_type")
    # An empty id counts as none, as does a null one.
    supplied_id = F.nullif(given("event_id"), F.lit(""))
    return df.withColumns(
        {
            "unit": F.coalesce(given("unit"), default_unit(F.col("sensor_type"))),
            "status": F.coalesce(given("status"), F.lit(DEFAULT_EVENT_STATUS)),
            "event_id": F.coalesce(
                supplied_id, derived_event_id(F.col("room_id"), F.col("ts"), sensor)
            ),
        }
    )
