"""Lists, lookups and newest-first reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.state import ORDER
from sensorloom.schema import HISTORY_LIMIT, RECENT_EVENTS_LIMIT, ROOM_EVENTS_LIMIT, SENSOR_TYPES

# Groups of input partitions in which keys are ranked first.
SPREAD = 64


def room_list(rooms: DataFrame) -> DataFrame:
    return rooms.orderBy("room_id")


def room_count(rooms: DataFrame) -> DataFrame:
    return rooms.agg(F.count("*").alias("count"))


def room_by_id(rooms: DataFrame, room_id: str) -> DataFrame:
    """The room, or no row."""
    return rooms.filter(F.col("room_id") == room_id)


def events_of_room(events: DataFrame, room_id: str) -> DataFrame:
    """All events of a room, oldest first."""
    return events.filter(F.col("room_id") == room_id).orderBy(*ORDER)


def events_of_known_rooms(events: DataFrame, rooms: DataFrame) -> DataFrame:
    """Events whose room exists. Spark broadcasts the ids if the scanned table is small."""
    return events.join(rooms.select("room_id"), "room_id", "left_semi")


def unknown_rooms(events: DataFrame, rooms: DataFrame) -> DataFrame:
    """Ids that have events but no room."""
    seen = events.groupBy("room_id").agg(F.count("*").alias("events"))
    return seen.join(rooms.select("room_id"), "room_id", "left_anti")


def recent_of_room(
    events: DataFrame, room_id: str, limit: int = ROOM_EVENTS_LIMIT, start: Column | None = None
) -> DataFrame:
    rows = events.filter(F.col("room_id") == room_id)
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    return rows.orderBy(*[F.col(c).desc() for c in ORDER]).limit(limit)


def recent_global(events: DataFrame, limit: int = RECENT_EVENTS_LIMIT) -> DataFrame:
    return events.orderBy(*[F.col(c).desc() for c in ORDER]).limit(limit)


def recent_per_key(
    events: DataFrame,
    limit: int = ROOM_EVENTS_LIMIT,
    start: Column | None = None,
    key: str = "room_id",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The newest ``limit`` events of every key, with their ``rank``.

    Ranked twice: first by key inside groups of input partitions, where each map task sends
    on at most ``limit`` rows a key, then over what is left, at most ``SPREAD`` times
    ``limit`` rows a key. So the number of input files does not weigh on the last task.
    """
    rows = events if start is None else events.filter(F.col("ts") >= start)
    newest = [F.col(c).desc() for c in order]
    near = Window.partitionBy(key, "_part").orderBy(*newest)
    first = (
        rows.withColumn("_part", F.spark_partition_id() % SPREAD)
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= limit)
        .drop("_part", "rank")
    )
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*newest)))
    return ranked.filter(F.col("rank") <= limit)


def room_details(
    rooms: DataFrame, events: DataFrame, limit: int = ROOM_EVENTS_LIMIT
) -> DataFrame:
    """Every room with its newest events (newest first) and how many were returned."""
    recent = recent_per_key(events, limit)
    fields = [c for c in recent.columns if c not in ("room_id", "rank")]
    lists = recent.groupBy("room_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("_ranked")
    )
    newest = F.transform(
        F.coalesce("_ranked", F.array()), lambda e: F.struct(*[e[f].alias(f) for f in fields])
    )
    return (
        rooms.join(lists, "room_id", "left")
        .withColumn("recent_events", newest)
        .withColumn("event_count", F.size("recent_events"))
        .drop("_ranked")
    )


def wide_history(
    events: DataFrame,
    start: Column | None = None,
    end: Column | None = None,
    limit: int | None = HISTORY_LIMIT,
    sensors: Sequence[str] = SENSOR_TYPES,
) -> DataFrame:
    """One row per room and instant with a column per sensor; newest ``limit`` of each room.

    ``start`` and ``end`` are inclusive.
    """
    rows = events.filter(F.col("sensor_type").isin(*sensors))
    if start is not None:
        rows = rows.filter(F.col("ts") >= start)
    if end is not None:
        rows = rows.filter(F.col("ts") <= end)
    wide = rows.groupBy("room_id", "ts").agg(
        *[
            F.max_by("value", F.when(F.col("sensor_type") == s, F.col("event_id"))).alias(s)
            for s in sensors
        ]
    )
    if limit is None:
        return wide
    return recent_per_key(wide, limit, order=("ts",)).drop("rank")


def live_feed(messages: DataFrame, label: Column, limit: int = 20) -> DataFrame:
    """The newest messages with clock time, device and label."""
    newest = messages.orderBy(F.col("ts").desc(), F.col("message_id").desc()).limit(limit)
    return newest.select(
        "message_id", "device_id", F.date_format("ts", "HH:mm:ss").alias("time"), label.alias("label")
    )
