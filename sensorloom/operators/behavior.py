"""Patterns and statistical anomalies of rooms and other entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.times import time_chunk
from sensorloom.operators.sequence import ordered_fold
from sensorloom.operators.state import HOUR, is_anomaly
from sensorloom.session import sized_side

TYPICAL_SHARE = 0.5
Z_BANDS = ((4.0, "high"), (3.0, "medium"), (2.0, "low"))


def unprocessed(raw: DataFrame, processed_ids: DataFrame, key: str = "id") -> DataFrame:
    """Raw rows whose id is not in the ledger of processed ones."""
    return raw.join(processed_ids.select(key), key, "left_anti")


def json_fields(raw: DataFrame, column: str = "data") -> DataFrame:
    """One row per top-level number in a JSON payload, whatever stands beside it; malformed payloads give none."""
    kept = [c for c in raw.columns if c != column]
    fields = raw.withColumn("_map", F.from_json(column, "map<string,variant>")).select(*kept, F.explode("_map").alias("field", "_value"))
    kind = F.schema_of_variant("_value")
    numbers = fields.where(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"))
    return numbers.select(*kept, "field", F.try_variant_get("_value", "$", "double").alias("value"))


def analysis_slice(
    df: DataFrame,
    start_date: str,
    end_date: str,
    entity_ids: Sequence[str] | DataFrame | None = None,
    entity: str = "room_id",
    entity_type: str | None = None,
    type_column: str = "entity_type",
) -> DataFrame:
    """Rows of the given days (both ends in), of the listed entities and entity type if any are given.

    A long list comes as a frame with the entity column.
    """
    kind = df.schema["ts"].dataType
    day = F.lit(end_date).cast("date") + F.expr("INTERVAL 1 DAY")
    rows = df.filter((F.col("ts") >= F.lit(start_date).cast(kind)) & (F.col("ts") < day.cast(kind)))
    if entity_type is not None:
        rows = rows.filter(F.col(type_column) == entity_type)
    if entity_ids is None:
        return rows
    if isinstance(entity_ids, DataFrame):
        return rows.join(entity_ids.select(entity), entity, "left_semi")
    return rows.filter(F.col(entity).isin(*entity_ids))


def iso_weekday(ts: Column) -> Column:
    return (F.weekday(ts) + 1).cast("int")


def _two_places(x: Column) -> Column:
    """Round half up to two places, steady against the last bit of a mean."""
    return (F.floor(F.round(x * 100, 6) + 0.5) / 100).cast("decimal(3,2)")


def occupancy_schedule(readings: DataFrame, typical: float = TYPICAL_SHARE) -> DataFrame:
    """When a room is usually in use: weekday, hour range and confidence.

    A slot is one hour of a weekday; its share is the part of the observed days on which it
    was occupied. Slots at or over ``typical`` that touch form one range (at most 24 slots
    per room and weekday), whose confidence is their mean share.
    """
    days = (
        readings.filter(F.col("sensor_type") == "occupancy")
        .groupBy("room_id", F.to_date("ts").alias("day"), F.hour("ts").cast("int").alias("hour"))
        .agg(F.max(F.when(F.col("value") > 0, 1).otherwise(0)).alias("used"))
    )
    slots = days.groupBy("room_id", iso_weekday(F.col("day")).alias("weekday"), "hour").agg(
        (F.sum("used") / F.count("*")).alias("share"), F.count("*").alias("days")
    )
    w = Window.partitionBy("room_id", "weekday").orderBy("hour")
    islands = slots.filter(F.col("share") >= typical).withColumn("island", F.col("hour") - F.row_number().over(w))
    return islands.groupBy("room_id", "weekday", "island").agg(
        F.min("hour").alias("from_hour"),
        (F.max("hour") + 1).alias("to_hour"),
        _two_places(F.avg("share")).alias("confidence"),
        F.sum("days").alias("days_observed"),
    ).drop("island")


def baselines(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n")
    )


def z_scores(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``z``; groups with fewer than two readings or no spread are left out.

    The baseline has one row a group. It is counted before it is broadcast, so that the
    readings need no shuffle when it is small.
    """
    stats = sized_side(baselines(df, keys).filter((F.col("n") > 1) & (F.col("sd") > 0)))
    scored = df.join(stats, list(keys))
    return scored.withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd")).drop("mean", "sd", "n")


def statistical_anomalies(
    df: DataFrame,
    keys: Sequence[str] = ("room_id", "sensor_type"),
    bands: Sequence[tuple[float, str]] = Z_BANDS,
) -> DataFrame:
    """Readings far from the mean of their group, with z score and severity."""
    return _outliers(z_scores(df, keys), bands)


def _outliers(scored: DataFrame, bands: Sequence[tuple[float, str]]) -> DataFrame:
    level = F.lit(None).cast("string")
    for limit, name in sorted(bands):
        level = F.when(F.abs("z") > limit, name).otherwise(level)
    found = scored.withColumn("severity", level).filter(F.col("severity").isNotNull())
    return found.withColumn("z", F.round("z", 6))


def anomalies_with_resolution(
    df: DataFrame,
    keys: Sequence[str] = ("room_id", "sensor_type"),
    bands: Sequence[tuple[float, str]] = Z_BANDS,
) -> DataFrame:
    """As ``statistical_anomalies``; ``resolved`` once a reading inside the range followed."""
    scored = z_scores(df, keys)
    low = min(limit for limit, _ in bands)
    back = scored.groupBy(*keys).agg(F.max(F.when(F.abs("z") <= low, F.col("ts"))).alias("_back"))
    return (
        _outliers(scored, bands)
        .join(sized_side(back), list(keys), "left")
        .withColumn("resolved", F.coalesce(F.col("_back") > F.col("ts"), F.lit(False)))
        .drop("_back")
    )


def unresolved(anomalies: DataFrame, entity: str, entity_id: str | None = None) -> DataFrame:
    """Open anomalies by entity, newest first; of one entity if given."""
    rows = anomalies.filter(~F.col("resolved"))
    if entity_id is not None:
        rows = rows.filter(F.col(entity) == entity_id)
    return rows.orderBy(entity, F.col("ts").desc(), F.col("event_id").desc())


def valid_at(patterns: DataFrame, at: Column) -> DataFrame:
    """Patterns in force at an instant: from inclusive, until exclusive, open if null."""
    return patterns.filter(
        (F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at))
    )


def with_pattern_in_force(
    readings: DataFrame, patterns: DataFrame, at: str = "ts", entity: str = "room_id", bucket_seconds: int = 7 * 24 * HOUR
) -> DataFrame:
    """Every reading with the patterns of its entity in force at its time (from inclusive, until exclusive, open if null).

    An interval join: patterns are laid out over buckets of time, cut to the span of the readings
    so that open ends and very long intervals end there, and a reading meets those of its own
    bucket. Readings are never multiplied, and a busy entity's are spread over its buckets. A reading without a
    pattern keeps nulls, one under several patterns comes with each. An interval that ends before it starts holds never.
    """
    bucket = time_chunk(F.col(at), bucket_seconds)
    span = readings.agg(F.min(bucket).alias("low"), F.max(bucket).alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    first = F.greatest(time_chunk(F.col("valid_from"), bucket_seconds), low)
    last = F.least(F.coalesce(time_chunk(F.col("valid_until"), bucket_seconds), high), high)
    laid = patterns.withColumns({"_first": first, "_last": last}).where("_first <= _last").withColumn("_bucket", F.explode(F.sequence("_first", "_last")))
    laid = laid.withColumnRenamed(entity, "_entity").drop("_first", "_last")
    rows = readings.withColumn("_here", bucket)
    in_force = (F.col("valid_from") <= F.col(at)) & (F.col("valid_until").isNull() | (F.col("valid_until") > F.col(at)))
    joined = rows.join(laid, (F.col(entity) == F.col("_entity")) & (F.col("_here") == F.col("_bucket")) & in_force, "left")
    return joined.drop("_here", "_bucket", "_entity")


def versioned_patterns(found: DataFrame, entity: str = "room_id") -> DataFrame:
    """Give detected patterns their validity: each holds until the entity's next detection.

    One row per entity and detection run, so the groups stay small.
    """
    w = Window.partitionBy(entity, "pattern_type").orderBy("detected_at")
    return found.withColumn("valid_from", F.col("detected_at")).withColumn(
        "valid_until", F.lead("detected_at").over(w)
    )


def weekly_use_patterns(readings: DataFrame) -> DataFrame:
    """Per room and week, how often it was in use: the confidence of that week's pattern."""
    weeks = (
        readings.filter(F.col("sensor_type") == "occupancy")
        .groupBy("room_id", F.date_trunc("week", "ts").alias("_week"))
        .agg(_two_places(F.avg(F.when(F.col("value") > 0, 1.0).otherwise(0.0))).alias("confidence"))
    )
    kind = readings.schema["ts"].dataType
    return weeks.select(
        "room_id",
        F.lit("weekly_use").alias("pattern_type"),
        "confidence",
        (F.col("_week").cast(kind) + F.expr("INTERVAL 7 DAYS")).alias("detected_at"),
    )


def insight_pages(
    patterns: DataFrame, anomalies: DataFrame, entity: str = "room_id", page_size: int = 1000
) -> DataFrame:
    """Insight documents: arrays of patterns and of anomalies, sorted by time.

    An entity with more than ``page_size`` items of a kind has several pages, so every item
    is kept while no array grows without bound. ``patterns`` and ``anomalies`` have the
    entity, ``ts``, ``item_id`` and a struct ``item``. Empty arrays, never null.
    """

    def paged(items: DataFrame, name: str) -> DataFrame:
        numbered = ordered_fold(
            items, [entity], ["ts", "item_id"], time_chunk(F.col("ts"), 24 * HOUR),
            sums={"position": F.lit(1)},
        )
        page = F.floor((F.col("position") - 1) / page_size).cast("int")
        return numbered.groupBy(entity, page.alias("page")).agg(
            F.sort_array(F.collect_list(F.struct("position", "item"))).alias(name)
        )

    both = paged(patterns, "patterns").join(paged(anomalies, "anomalies"), [entity, "page"], "full_outer")
    return both.select(
        entity,
        "page",
        *[
            F.transform(F.coalesce(n, F.array()), lambda e: e["item"]).alias(n)
            for n in ("patterns", "anomalies")
        ],
    )


def run_stats(log: DataFrame, schedule: DataFrame) -> DataFrame:
    """Processed events, anomalies, last event and mean pattern confidence in percent."""
    done = log.agg(
        F.count("*").alias("processed"),
        F.count_if(is_anomaly()).alias("anomalies"),
        F.max("ts").alias("last_run"),
    )
    trust = schedule.agg(F.round(F.avg(F.col("confidence").cast("double")) * 100, 6).alias("c"))
    return done.withColumn("confidence_pct", trust.scalar())


def pattern_table(classified: DataFrame, parts: Sequence[tuple[str, int, int]]) -> DataFrame:
    """For each named day part (name, first hour, hour after it): share of observed days with use, and anomalies in it.

    A day is observed when the room reported at all, and matches when occupancy was above
    zero inside the hours.
    """
    hour = F.hour("ts")
    days = classified.groupBy("room_id", F.to_date("ts").alias("day")).agg(
        *[
            column
            for i, (_, start, end) in enumerate(parts)
            for column in (
                F.max(
                    ((F.col("sensor_type") == "occupancy") & (F.col("value") > 0)
                     & (hour >= start) & (hour < end)).cast("int")
                ).alias(f"used_{i}"),
                F.count_if(is_anomaly() & (hour >= start) & (hour < end)).alias(f"bad_{i}"),
            )
        ]
    )
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("pattern"), F.col(f"used_{i}").alias("used"), F.col(f"bad_{i}").alias("bad"))
            for i, (n, _, _) in enumerate(parts)
        ]
    )
    return (
        days.select("room_id", F.explode(cells).alias("c"))
        .groupBy("room_id", F.col("c.pattern").alias("pattern"))
        .agg(
            F.round(F.sum("c.used") * 100.0 / F.count("*"), 6).alias("frequency_pct"),
            F.sum("c.bad").alias("anomalies"),
        )
    )


def hourly_activity(events: DataFrame, hours: int = 24) -> DataFrame:
    """Events per hour over the last ``hours`` hours up to the newest event, and the bar height.

    Empty hours are filled in. The newest time is a scalar subquery.
    """
    newest = events.agg(F.date_trunc("hour", F.max("ts")).alias("h"))
    kind = events.schema["ts"].dataType
    span = F.expr(f"INTERVAL {hours - 1} HOURS")
    grid = newest.select(
        F.explode(F.sequence(F.col("h") - span, F.col("h"), F.expr("INTERVAL 1 HOUR"))).alias("_h")
    ).select(F.col("_h").cast(kind).alias("hour"))
    since = newest.select((F.col("h") - span).cast(kind)).scalar()
    counts = (
        events.filter(F.col("ts") >= since)
        .groupBy(F.date_trunc("hour", "ts").cast(kind).alias("hour"))
        .agg(F.count("*").alias("_n"))
    )
    filled = grid.join(counts, "hour", "left").select("hour", F.coalesce("_n", F.lit(0)).alias("n"))
    # At most ``hours`` rows are left here, so one window over all of them is fine.
    peak = F.max("n").over(Window.partitionBy(F.lit(1)))
    return filled.withColumn("height_pct", F.coalesce(F.round(F.try_divide(F.col("n") * 100.0, peak), 6), F.lit(0.0)))
