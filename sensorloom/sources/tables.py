"""Readings, rooms, devices and messages seen in the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.once import compute_once
from sensorloom.session import use_utc

# How the generic event table is read as sensor data. "error" has no sensor,
# so those rows are real rejects.
SENSOR_OF_EVENT = {
    "view": "temperature",
    "click": "humidity",
    "purchase": "occupancy",
    "signup": "motion",
    "error": "pressure",
}
ROOMS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _sensor_of(kind: Column) -> Column:
    sensor = F.lit(None).cast("string")
    for name, sensor_type in SENSOR_OF_EVENT.items():
        sensor = F.when(kind == name, sensor_type).otherwise(sensor)
    return sensor


def as_readings(events: DataFrame) -> DataFrame:
    """Generic events as readings: id, room, device, sensor, value, instant."""
    kind, value = F.col("event_type"), F.col("value")
    reading = (
        F.when(kind == "view", value % 40)
        .when(kind == "click", value % 100)
        .when(kind == "purchase", F.floor(value % 40).cast("double"))
        .when(kind == "signup", F.floor(value % 2).cast("double"))
        .otherwise(value)
    )
    given = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(
            F.lit("room-"), F.lpad((F.col("user_id") % ROOMS).cast("string"), 3, "0")
        ).alias("room_id"),
        F.col("user_id").alias("device_id"),
        "ts",
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("unit"),
        "event_type",
        "value",
    )
    return compute_once(given, {"sensor_type": _sensor_of(kind), "value": reading}).drop("event_type")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def room_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rooms with name, floor and capacity; the capacity of rooms on floor 4 is unknown."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.concat(F.lit("room-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("room_id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("int").alias("floor"),
        F.when(F.col("n_regionkey") != 4, F.col("n_nationkey") + 5).cast("int").alias("capacity"),
    )


def device_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices with type, tier and a metadata map; one segment is suspended."""
    customer = table(spark, sf_dir, "customer")
    room = F.concat(
        F.lit("room-"), F.lpad((F.col("c_custkey") % ROOMS).cast("string"), 3, "0")
    )
    return customer.select(
        F.col("c_custkey").alias("device_id"),
        F.lower("c_mktsegment").alias("device_type"),
        F.when(F.col("c_custkey") % 2 == 0, "free").otherwise("standard").alias("tier"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "suspended")
        .otherwise("registered")
        .alias("status"),
        F.create_map(F.lit("location"), room, F.lit("model"), F.col("c_name")).alias("metadata"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "events"))


def as_messages(events: DataFrame) -> DataFrame:
    """Device messages: a payload map with the sensor value and the number in ``props``."""
    k = F.from_json("props", "k double")["k"]
    status = (
        F.when(F.col("event_type") == "error", "failed")
        .when(F.col("event_type") == "signup", "queued")
        .otherwise("processed")
    )
    return events.select(
        F.col("event_id").cast("string").alias("message_id"),
        F.col("user_id").alias("device_id"),
        "ts",
        F.create_map(
            _sensor_of(F.col("event_type")), F.col("value"), F.lit("battery"), k
        ).alias("payload"),
        status.alias("status"),
        "props",
    )
