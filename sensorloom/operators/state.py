"""Room state folded from the accepted log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.times import age_seconds, age_text, micros, time_chunk
from sensorloom.operators.sequence import ordered_fold
from sensorloom.schema import DEFAULT_ROOM_STATUS

ORDER = ("ts", "event_id")
HOUR = 3600

STATE_FIELDS = {
    "temperature": lambda v: v,
    "motion": lambda v: v != 0,
    "occupancy": lambda v: v.try_cast("int"),
    "humidity": lambda v: v,
}


def is_anomaly() -> Column:
    return F.col("status") != "normal"


def room_name(room_id: Column) -> Column:
    return F.concat(F.lit("Room "), room_id)


def fold_rooms(classified: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """One row per room: latest typed reading of each sensor, sticky status, anomaly count.

    Everything is an aggregate with a map-side part, so a busy room costs no more than a
    quiet one, and the same function runs on a stream in update mode. ``order`` may name an
    arrival column instead of event time.
    """
    position = F.struct(*order)
    latest = {
        sensor: F.max_by("value", F.when(F.col("sensor_type") == sensor, position))
        for sensor in STATE_FIELDS
    }
    folded = classified.groupBy("room_id").agg(
        *[v.alias(f"_{s}") for s, v in latest.items()],
        F.max_by("status", F.when(is_anomaly(), position)).alias("_status"),
        F.max_by("ts", position).alias("last_update"),
        F.count_if(is_anomaly()).alias("alert_count_24h"),
    )
    return folded.select(
        "room_id",
        room_name(F.col("room_id")).alias("name"),
        F.coalesce("_status", F.lit(DEFAULT_ROOM_STATUS)).alias("status"),
        "last_update",
        F.struct(*[typed(F.col(f"_{s}")).alias(s) for s, typed in STATE_FIELDS.items()]).alias(
            "current_state"
        ),
        "alert_count_24h",
    )


def fold_rooms_by_sensor(classified: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """As ``fold_rooms`` for batch: first to one row per room and sensor, then to rooms.

    The order key is compared once a row instead of once a sensor, which is the cheaper plan
    on a large log. Streams need the one-step form.
    """
    position = F.struct(*order)
    per_sensor = classified.groupBy("room_id", "sensor_type").agg(
        F.max(F.struct(position.alias("at"), "value")).alias("head"),
        F.max(F.when(is_anomaly(), F.struct(position.alias("at"), "status"))).alias("bad"),
        F.count_if(is_anomaly()).alias("n_bad"),
    )
    rooms = per_sensor.groupBy("room_id").agg(
        *[
            F.max(F.when(F.col("sensor_type") == s, F.col("head.value"))).alias(f"_{s}")
            for s in STATE_FIELDS
        ],
        F.max("bad").alias("_bad"),
        F.max("head.at").alias("_at"),
        F.sum("n_bad").alias("alert_count_24h"),
    )
    return rooms.select(
        "room_id",
        room_name(F.col("room_id")).alias("name"),
        F.coalesce("_bad.status", F.lit(DEFAULT_ROOM_STATUS)).alias("status"),
        F.col("_at.ts").alias("last_update"),
        F.struct(*[typed(F.col(f"_{s}")).alias(s) for s, typed in STATE_FIELDS.items()]).alias(
            "current_state"
        ),
        "alert_count_24h",
    )


def name_rooms(rooms: DataFrame, dimension: DataFrame) -> DataFrame:
    """Use the registered name where there is one (the default name stays otherwise)."""
    names = dimension.select("room_id", F.col("name").alias("_name"))
    joined = rooms.join(names, "room_id", "left")
    return joined.withColumn("name", F.coalesce("_name", "name")).select(*rooms.columns)


def flat_state(rooms: DataFrame) -> DataFrame:
    """The nested state as plain columns."""
    return rooms.select("*", "current_state.*").drop("current_state")


def rolling_anomalies(
    classified: DataFrame, hours: int = 24, slice_seconds: int = HOUR
) -> DataFrame:
    """For each anomaly, the anomalies of its room in the ``hours`` up to it, both ends in.

    An anomaly counts from its own time until just before ``hours`` later, as in
    ``anomalies_as_of`` and on streams: +1 at its time, -1 ``hours`` later. The running sum is
    the rolling count; at one instant the -1 steps come first. That needs no frame over a room, so no room is held in one task.
    """
    span = F.expr(f"INTERVAL {hours} HOURS")
    marks = F.array(
        F.struct(F.col("ts").alias("at"), F.lit(1).alias("phase"), F.lit(1).alias("step")),
        F.struct((F.col("ts") + span).alias("at"), F.lit(0).alias("phase"), F.lit(-1).alias("step")),
    )
    steps = (
        classified.filter(is_anomaly())
        .select("room_id", "event_id", "status", F.explode(marks).alias("m"))
        .select("room_id", "event_id", "status", "m.*")
    )
    counted = ordered_fold(
        steps,
        ["room_id"],
        ["at", "phase"],
        time_chunk(F.col("at"), slice_seconds),
        sums={"anomalies_in_span": F.col("step")},
        peers=True,
    )
    return counted.filter(F.col("phase") == 1).select(
        "room_id", "event_id", F.col("at").alias("ts"), "status", "anomalies_in_span"
    )


def anomalies_as_of(classified: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Anomalies of each room in the ``hours`` before ``as_of``; rooms without any give 0."""
    recent = (F.col("ts") > as_of - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("ts") <= as_of)
    return classified.groupBy("room_id").agg(
        F.count_if(is_anomaly() & recent).alias("anomalies_in_span")
    )


def room_changes(
    classified: DataFrame, order: Sequence[str] = ORDER, slice_seconds: int = HOUR
) -> DataFrame:
    """Old and new image of the room at every event; the first event of a room inserts it."""
    of = {s: F.when(F.col("sensor_type") == s, typed(F.col("value"))) for s, typed in STATE_FIELDS.items()}
    bad = F.when(is_anomaly(), F.col("status"))
    images = {**of, "status": bad}
    folded = ordered_fold(
        classified.select("room_id", *order, "sensor_type", "value", F.col("status")),
        ["room_id"],
        list(order),
        time_chunk(F.col("ts"), slice_seconds),
        sums={"new_count": is_anomaly().cast("int")},
        values={**images, "update": F.col("ts")},
        lasts={f"new_{n}": n for n in images},
        priors={f"old_{n}": n for n in (*images, "update")},
    )
    exists = F.col("old_update").isNotNull()

    def image(side: str, update: Column, count: Column) -> Column:
        return F.struct(
            F.coalesce(f"{side}_status", F.lit(DEFAULT_ROOM_STATUS)).alias("status"),
            update.alias("last_update"),
            F.struct(*[F.col(f"{side}_{s}").alias(s) for s in STATE_FIELDS]).alias("current_state"),
            count.alias("alert_count_24h"),
        )

    old_count = F.col("new_count") - is_anomaly().cast("int")
    return folded.select(
        "room_id",
        *order,
        F.when(exists, "MODIFY").otherwise("INSERT").alias("change"),
        F.when(exists, image("old", F.col("old_update"), old_count)).alias("old_image"),
        image("new", F.col("ts"), F.col("new_count")).alias("new_image"),
    )


def event_changes(
    puts: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    image: Sequence[str],
    slice_no: Column,
) -> DataFrame:
    """Old and new image of a keyed table for every put, in put order."""
    folded = ordered_fold(
        puts, list(key), list(order), slice_no, values={"image": F.struct(*image)}, priors={"old_image": "image"}
    )
    return folded.withColumn("new_image", F.struct(*image)).withColumn(
        "change", F.when(F.col("old_image").isNotNull(), "MODIFY").otherwise("INSERT")
    )


def mark_offline(rooms: DataFrame, as_of: Column, after_seconds: int = HOUR) -> DataFrame:
    """Rooms silent for longer than ``after_seconds`` become ``offline``; adds age columns."""
    age = age_seconds(F.col("last_update"), as_of)
    silent = micros(as_of) - micros(F.col("last_update")) > after_seconds * 1_000_000
    return rooms.withColumns(
        {
            "status": F.when(silent, "offline").otherwise(F.col("status")),
            "age_seconds": age,
            "age": age_text(age),
        }
    )


def utilisation(rooms: DataFrame, dimension: DataFrame) -> DataFrame:
    """Floor, capacity and occupancy share; an unknown or zero capacity gives null."""
    dim = dimension.select("room_id", "floor", "capacity")
    return rooms.join(dim, "room_id", "left").withColumn(
        "utilisation",
        F.try_divide(F.col("current_state.occupancy").cast("double"), F.col("capacity").cast("double")),
    )
