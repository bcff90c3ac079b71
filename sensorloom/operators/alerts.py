"""Alert episodes and wide readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.ids import derived_event_id
from sensorloom.functions.times import time_chunk
from sensorloom.operators.classify import severity
from sensorloom.operators.sequence import ordered_fold
from sensorloom.operators.state import HOUR, ORDER, is_anomaly
from sensorloom.schema import SENSOR_TYPES


def unpivot_wide(wide: DataFrame, sensors: Sequence[str] = SENSOR_TYPES) -> DataFrame:
    """Wide readings to one row per sensor; empty cells are dropped, booleans become 0/1."""
    cells = wide.select("room_id", "ts", *[F.col(s).cast("double").alias(s) for s in sensors])
    return cells.unpivot(["room_id", "ts"], list(sensors), "sensor_type", "value").filter(
        F.col("value").isNotNull()
    )


def alert_episodes(classified: DataFrame, slice_seconds: int = HOUR) -> DataFrame:
    """One alert per run of consecutive anomalies of a room and sensor.

    All anomalies with the same number of normal readings before them form a run. A run is
    resolved when a normal reading follows, that is when the key has more of them in all.
    """
    keys = ["room_id", "sensor_type"]
    counted = ordered_fold(
        classified.select(*keys, *ORDER, "status"),
        keys,
        list(ORDER),
        time_chunk(F.col("ts"), slice_seconds),
        sums={"normals": (~is_anomaly()).cast("int")},
        totals={"normals_in_all": "normals"},
    )
    runs = (
        counted.filter(is_anomaly())
        .groupBy(*keys, "normals", "normals_in_all")
        .agg(
            F.min("ts").alias("timestamp"),
            F.max("ts").alias("last_seen"),
            F.count("*").alias("readings"),
            F.max(severity(F.col("status"))).alias("_severity"),
        )
    )
    return runs.select(
        derived_event_id(F.col("room_id"), F.col("timestamp"), F.col("sensor_type")).alias("alert_id"),
        "room_id",
        F.col("sensor_type").alias("alert_type"),
        F.when(F.col("_severity") == 2, "critical").otherwise("warning").alias("severity"),
        "timestamp",
        "last_seen",
        "readings",
        (F.col("normals_in_all") > F.col("normals")).alias("resolved"),
    )


def active_alerts(episodes: DataFrame) -> DataFrame:
    return episodes.filter(~F.col("resolved"))
