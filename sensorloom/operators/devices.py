"""Device registry, liveness, message counts and rate limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.times import age_seconds, age_text, micros, time_chunk, trunc_like
from sensorloom.operators.records import upsert
from sensorloom.operators.sequence import ordered_fold
from sensorloom.schema import BURST_PER_MINUTE, HOURLY_TIERS

HOUR = 3600
OK_SECONDS, SLOW_SECONDS = 30, 300


def register(registry: DataFrame, registrations: DataFrame) -> DataFrame:
    """The last registration of a device replaces its whole record."""
    return upsert(registry, registrations, "device_id", order=("registered_at",))


def _limit_of(tier: Column, tiers: Mapping[str, int]) -> Column:
    limit = F.lit(None).cast("bigint")
    for name, per_hour in tiers.items():
        limit = F.when(tier == name, F.lit(per_hour).cast("bigint")).otherwise(limit)
    return limit


def device_status(
    registry: DataFrame,
    messages: DataFrame,
    as_of: Column,
    tiers: Mapping[str, int] = HOURLY_TIERS,
    offline_seconds: int = HOUR,
) -> DataFrame:
    """Last seen, online/offline/suspended, health, messages today, what is left of the hour.

    Messages are first reduced to one row per device; only that meets the registry.
    """
    past = F.col("ts") <= as_of
    seen = messages.groupBy("device_id").agg(
        F.max(F.when(past, F.col("ts"))).alias("last_seen"),
        F.count_if(past & (F.col("ts") >= trunc_like(messages, "day", as_of))).alias("_today"),
        F.count_if(past & (F.col("ts") >= trunc_like(messages, "hour", as_of))).alias("_hour"),
    )
    joined = registry.join(seen, "device_id", "left")
    age_us = micros(as_of) - micros(F.col("last_seen"))
    age = age_seconds(F.col("last_seen"), as_of)
    limit = _limit_of(F.col("tier"), tiers)
    return joined.select(
        "device_id",
        "device_type",
        "tier",
        F.when(F.col("status") == "suspended", "suspended")
        .when(age_us <= offline_seconds * 1_000_000, "online")
        .otherwise("offline")
        .alias("status"),
        "last_seen",
        heartbeat_health(age).alias("health"),
        age_text(age).alias("age"),
        F.coalesce("_today", F.lit(0)).alias("message_count_today"),
        F.greatest(limit - F.coalesce("_hour", F.lit(0)), F.lit(0).cast("bigint")).alias("rate_limit_remaining"),
    )


def heartbeat_health(age: Column, ok: int = OK_SECONDS, slow: int = SLOW_SECONDS) -> Column:
    """``ok``, ``slow`` or ``down`` by the age of the last sign of life; never seen is down."""
    return F.when(age < ok, "ok").when(age < slow, "slow").otherwise("down")


def messages_today(messages: DataFrame, as_of: Column) -> DataFrame:
    """Messages of each device on the UTC day of ``as_of``, up to it."""
    today = messages.filter(
        (F.col("ts") >= trunc_like(messages, "day", as_of)) & (F.col("ts") <= as_of)
    )
    return today.groupBy("device_id").agg(F.count("*").alias("message_count_today"))


def hourly_usage(
    messages: DataFrame, registry: DataFrame, tiers: Mapping[str, int] = HOURLY_TIERS
) -> DataFrame:
    """Requests per device and clock hour against the limit of its tier.

    The counters, not the messages, are joined to the registry. An unregistered device has
    no limit and is never over it.
    """
    counts = messages.groupBy("device_id", F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("request_count")
    )
    joined = counts.join(registry.select("device_id", "tier"), "device_id", "left")
    limit = _limit_of(F.col("tier"), tiers)
    return joined.select(
        "device_id",
        F.col("w.start").alias("window_start"),
        "request_count",
        limit.alias("limit"),
        F.when(limit.isNotNull(), F.greatest(limit - F.col("request_count"), F.lit(0).cast("bigint"))).alias("remaining"),
        F.coalesce(F.col("request_count") > limit, F.lit(False)).alias("exceeded"),
    )


def bursts(
    messages: DataFrame, limit: int = BURST_PER_MINUTE, slide: str | None = None
) -> DataFrame:
    """Devices and minutes with more than ``limit`` messages; ``slide`` gives sliding minutes.

    For sliding minutes the messages are first counted per step of the slide, and only these
    counts are copied into the minutes that overlap them.
    """
    if slide is None:
        counts = messages.groupBy("device_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    else:
        steps = messages.groupBy("device_id", F.window("ts", slide).alias("s")).agg(F.count("*").alias("_n"))
        steps = steps.select("device_id", F.col("s.start").alias("at"), "_n")
        counts = steps.groupBy("device_id", F.window("at", "1 minute", slide).alias("w")).agg(F.sum("_n").alias("n"))
    return counts.filter(F.col("n") > limit).select(
        "device_id", F.col("w.start").alias("window_start"), "n"
    )


def admission(
    messages: DataFrame,
    limit: int | Column,
    window_seconds: int = HOUR,
    slice_seconds: int = 60,
) -> DataFrame:
    """Admit the first ``limit`` messages of a device in each window, deny the rest.

    Order is time, then id. The running number is built in slices of the window, so a device
    that floods one window is still spread over tasks.
    """
    numbered = ordered_fold(
        messages.withColumn("_window", time_chunk(F.col("ts"), window_seconds)),
        ["device_id", "_window"],
        ["ts", "message_id"],
        time_chunk(F.col("ts"), slice_seconds),
        sums={"number": F.lit(1)},
    )
    allowed = limit if isinstance(limit, Column) else F.lit(limit)
    return numbered.withColumn("admitted", F.col("number") <= allowed).drop("_window")


def rate_per_minute(messages: DataFrame, as_of: Column) -> DataFrame:
    """Messages of each device in the last full minute before ``as_of``; silent ones have none."""
    end = trunc_like(messages, "minute", as_of)
    rows = messages.filter((F.col("ts") >= end - F.expr("INTERVAL 1 MINUTE")) & (F.col("ts") < end))
    return rows.groupBy("device_id").agg(F.count("*").alias("per_minute"))


def minute_rates(messages: DataFrame) -> DataFrame:
    """Messages per device and calendar minute."""
    counts = messages.groupBy("device_id", trunc_like(messages, "minute", F.col("ts")).alias("minute"))
    return counts.agg(F.count("*").alias("per_minute"))


def lifecycle_counts(
    messages: DataFrame, states: Sequence[str] = ("queued", "processed", "failed")
) -> DataFrame:
    """Messages of each device in each state; the states are given, so no pass finds them."""
    return messages.groupBy("device_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in states]
    )


def payload_readings(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """One reading per payload entry; the room is the location in the device's metadata.

    Devices without a location give a null room, which validation then rejects. Nothing is
    filtered here by sensor type.
    """
    places = registry.select("device_id", F.col("metadata")["location"].alias("room_id"))
    # Joined before the map is opened, so each message is moved once.
    placed = messages.select("message_id", "device_id", "ts", "payload").join(places, "device_id", "left")
    entries = placed.select("*", F.explode("payload").alias("sensor_type", "value"))
    return entries.select(
        F.concat_ws("_", "message_id", "sensor_type").alias("event_id"),
        "room_id", "device_id", "sensor_type", "value", "ts",
    )
