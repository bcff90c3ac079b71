"""Deterministic identifiers: the same reading always gets the same id, so replays match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.functions.times import epoch_text


def derived_event_id(
    room_id: Column, ts: Column, sensor_type: Column | None = None
) -> Column:
    """``room_epoch`` or, with a sensor, ``room_epoch_sensor``.

    The short form collides when several sensors of a room report at one instant.
    """
    parts = [room_id, epoch_text(ts)] + ([] if sensor_type is None else [sensor_type])
    return F.concat_ws("_", *parts)
