"""Storage forms of events and rooms, upserts and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.times import iso_text
from sensorloom.operators.state import ORDER, STATE_FIELDS
from sensorloom.schema import ROOM_STATE

def collapse_events(
    events: DataFrame, key: Sequence[str] = ("room_id", "ts"), order: Sequence[str] = ORDER
) -> DataFrame:
    """Last write per key. Copies of a key are combined map-side before they are shuffled."""
    rest = [c for c in events.columns if c not in key]
    last = events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return last.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*events.columns)


def upsert(
    current: DataFrame, incoming: DataFrame, key: str, order: Sequence[str] | None = None
) -> DataFrame:
    """Whole rows of ``incoming`` replace those of ``current`` with the same key.

    Give ``order`` if ``incoming`` may hold a key twice; its last row then wins.
    """
    if order is not None:
        incoming = collapse_events(incoming, (key,), order)
    kept = current.join(incoming.select(key), key, "left_anti")
    return kept.unionByName(incoming.select(*current.columns))


def patch_rooms(rooms: DataFrame, patches: DataFrame) -> DataFrame:
    """Set single sensor fields of existing rooms; patches of unknown rooms do nothing.

    ``patches`` has room_id, sensor_type, value and at (when it was made); of several patches
    to one field the latest holds.
    """
    known = patches.filter(F.col("sensor_type").isin(*STATE_FIELDS))
    latest = known.groupBy("room_id").agg(
        *[
            F.max_by("value", F.when(F.col("sensor_type") == s, F.col("at"))).alias(f"_{s}")
            for s in STATE_FIELDS
        ],
        F.max("at").alias("_at"),
    )
    state = F.struct(
        *[
            F.coalesce(typed(F.col(f"_{s}")), F.col(f"current_state.{s}")).alias(s)
            for s, typed in STATE_FIELDS.items()
        ]
    )
    return (
        rooms.join(latest, "room_id", "left")
        .withColumns({"current_state": state, "last_update": F.coalesce("_at", "last_update")})
        .select(*rooms.columns)
    )


def unmatched_patches(rooms: DataFrame, patches: DataFrame) -> DataFrame:
    return patches.join(rooms.select("room_id"), "room_id", "left_anti")


def event_records(events: DataFrame) -> DataFrame:
    """Event as stored: the value as exact text, ISO text time, never without an id.

    A decimal of fixed width would round 1e-12 and stop at 1e30; the shortest text that reads
    back as the same number does neither.
    """
    return events.select(
        "room_id",
        iso_text(F.col("ts")).alias("timestamp"),
        "event_id",
        "sensor_type",
        F.col("value").cast("string").alias("value"),
        "unit",
        "status",
    )


def _stored(field: str) -> Column:
    """State values as text: exact numbers, so no precision is lost on the way back."""
    return F.col(f"current_state.{field}").cast("string")


def room_records(rooms: DataFrame) -> DataFrame:
    """Room as stored: ISO text time, and a state map without the absent sensors."""
    entries = F.array(*[F.struct(F.lit(s).alias("key"), _stored(s).alias("value")) for s in STATE_FIELDS])
    present = F.filter(entries, lambda e: e["value"].isNotNull())
    return rooms.select(
        "room_id",
        "name",
        "status",
        iso_text(F.col("last_update")).alias("last_update"),
        F.map_from_entries(present).alias("current_state"),
        "alert_count_24h",
    )


def rooms_from_records(records: DataFrame) -> DataFrame:
    """The inverse of ``room_records``; a missing state or count is defaulted."""
    state = F.struct(
        *[
            F.try_element_at("current_state", F.lit(f.name)).try_cast(f.dataType).alias(f.name)
            for f in ROOM_STATE
        ]
    )
    return records.select(
        "room_id",
        "name",
        "status",
        F.col("last_update").try_cast("timestamp").alias("last_update"),
        state.alias("current_state"),
        F.coalesce("alert_count_24h", F.lit(0)).cast("bigint").alias("alert_count_24h"),
    )


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON text; absent fields are left out, numbers stay numbers.

    Instants are written in full: the JSON writer's own format stops at milliseconds.
    """
    columns = [
        iso_text(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        else F.col(f.name)
        for f in df.schema
    ]
    return df.select(F.to_json(F.struct(*columns)).alias("json"))
