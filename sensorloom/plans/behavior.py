"""Patterns, statistical anomalies and activity."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.times import like
from sensorloom.operators import behavior, partials
from sensorloom.plans import query
from sensorloom.plans.rooms import log_of
from sensorloom.plans.sql import LOG
from sensorloom.session import scratch_path
from sensorloom.sources import tables
from sensorloom.streaming.merge import MergeTable

TWO_PLACES = "CAST(floor(round({} * 100, 6) + 0.5) / 100 AS DECIMAL(3,2))"


@query(
    "payload_increment",
    """WITH f AS (SELECT unnest(['k', 'v']) AS field)
    SELECT CAST(event_id AS BIGINT) AS id, user_id AS entity_id, ts, field,
      CASE field WHEN 'k' THEN CAST(json_extract(props, '$.k') AS DOUBLE) ELSE value END AS value
    FROM events, f WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def payload_increment(spark, sf):
    """JSON payloads not yet processed; the finished orders stand for the ledger."""
    # Text, lists and nulls beside the numbers, as devices send them.
    more = F.to_json(F.struct(F.col("event_type").alias("t"), F.col("value").alias("v"), F.array(F.lit(1)).alias("l")))
    mixed = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(", "), F.substring(more, 2, 1 << 20))
    raw = tables.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entity_id"), "ts", mixed.alias("data")
    )
    orders = tables.table(spark, sf, "orders")
    done = orders.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("id"))
    return behavior.json_fields(behavior.unprocessed(raw, done))


@query(
    "analysis_slice",
    f"""WITH {LOG} SELECT event_id, room_id, sensor_type, value, ts FROM log
    WHERE ts >= '2024-01-08' AND ts < '2024-01-15' AND room_id IN ('room-001', 'room-002')""",
)
def analysis_slice(spark, sf):
    log = log_of(spark, sf).select("event_id", "room_id", "sensor_type", "value", "ts")
    return behavior.analysis_slice(log, "2024-01-08", "2024-01-14", ["room-001", "room-002"])


SCHEDULE = f"""{LOG}, days AS (SELECT room_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour,
    max(CASE WHEN value > 0 THEN 1 ELSE 0 END) AS used FROM log WHERE sensor_type = 'occupancy' GROUP BY ALL),
  slots AS (SELECT room_id, CAST(isodow(day) AS INTEGER) AS weekday, hour, sum(used)::DOUBLE / count(*) AS share,
    count(*) AS days FROM days GROUP BY ALL),
  islands AS (SELECT *, hour - row_number() OVER (PARTITION BY room_id, weekday ORDER BY hour) AS island
    FROM slots WHERE share >= 0.5),
  schedule AS (SELECT room_id, weekday, CAST(min(hour) AS INTEGER) AS from_hour, CAST(max(hour) + 1 AS INTEGER) AS to_hour,
    {TWO_PLACES.format("avg(share)")} AS confidence, CAST(sum(days) AS BIGINT) AS days_observed
    FROM islands GROUP BY room_id, weekday, island)"""


@query("occupancy_schedule", f"WITH {SCHEDULE} SELECT * FROM schedule")
def occupancy_schedule(spark, sf):
    return behavior.occupancy_schedule(log_of(spark, sf))


def z_sql(source: str, keys: str) -> str:
    return f"""base AS (SELECT {keys}, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS n FROM {source} GROUP BY ALL),
    scored AS (SELECT s.*, (value - mean) / sd AS z FROM {source} s JOIN base USING ({keys}) WHERE n > 1 AND sd > 0),
    back AS (SELECT {keys}, max(ts) FILTER (WHERE abs(z) <= 2) AS b FROM scored GROUP BY ALL),
    found AS (SELECT s.* EXCLUDE (z), round(z, 6) AS z, CASE WHEN abs(z) > 4 THEN 'high' WHEN abs(z) > 3 THEN 'medium'
      ELSE 'low' END AS severity, coalesce(b > ts, false) AS resolved FROM scored s LEFT JOIN back USING ({keys}) WHERE abs(z) > 2)"""


@query(
    "statistical_anomalies",
    f"WITH {LOG}, {z_sql('log', 'room_id, sensor_type')} SELECT room_id, sensor_type, event_id, ts, value, z, severity FROM found",
)
def statistical_anomalies(spark, sf):
    log = log_of(spark, sf).select("room_id", "sensor_type", "event_id", "ts", "value")
    return behavior.statistical_anomalies(log).select(
        "room_id", "sensor_type", "event_id", "ts", "value", "z", "severity"
    )


@query(
    "hourly_baseline_anomalies",
    f"""WITH {LOG}, h AS (SELECT room_id, sensor_type, CAST(hour(ts) AS INTEGER) AS hour, event_id, ts, value FROM log),
    {z_sql('h', 'room_id, sensor_type, hour')} SELECT room_id, sensor_type, hour, event_id, z, severity FROM found""",
)
def hourly_baseline_anomalies(spark, sf):
    log = log_of(spark, sf).select(
        "room_id", "sensor_type", F.hour("ts").cast("int").alias("hour"), "event_id", "ts", "value"
    )
    found = behavior.statistical_anomalies(log, ("room_id", "sensor_type", "hour"))
    return found.select("room_id", "sensor_type", "hour", "event_id", "z", "severity")


DEVICE_Z = f"""raw AS (SELECT user_id AS device_id, CAST(event_id AS VARCHAR) AS event_id, ts, value FROM events),
  {z_sql('raw', 'device_id')}"""


@query(
    "device_anomalies",
    f"WITH {DEVICE_Z} SELECT device_id, event_id, ts, value, z, severity, resolved FROM found",
)
def device_anomalies(spark, sf):
    """Raw values by device reach every severity band."""
    return behavior.anomalies_with_resolution(raw_by_device(spark, sf), ("device_id",)).select(
        "device_id", "event_id", "ts", "value", "z", "severity", "resolved"
    )


def raw_by_device(spark, sf):
    events = tables.table(spark, sf, "events")
    return events.select(
        F.col("user_id").alias("device_id"), F.col("event_id").cast("string").alias("event_id"), "ts", "value"
    )


@query(
    "unresolved_anomalies",
    f"WITH {DEVICE_Z} SELECT device_id, event_id, ts, severity FROM found WHERE NOT resolved",
)
def unresolved_anomalies(spark, sf):
    found = behavior.anomalies_with_resolution(raw_by_device(spark, sf), ("device_id",))
    return behavior.unresolved(found, "device_id").select("device_id", "event_id", "ts", "severity")


WEEKLY = f"""{LOG}, weekly AS (SELECT room_id, 'weekly_use' AS pattern_type,
    {TWO_PLACES.format("avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")} AS confidence,
    date_trunc('week', ts)::TIMESTAMP + INTERVAL 7 DAY AS valid_from
    FROM log WHERE sensor_type = 'occupancy' GROUP BY room_id, date_trunc('week', ts)),
  patterns AS (SELECT *, lead(valid_from) OVER (PARTITION BY room_id ORDER BY valid_from) AS valid_until FROM weekly)"""


def weekly_patterns(spark, sf):
    return behavior.versioned_patterns(behavior.weekly_use_patterns(log_of(spark, sf)))


@query(
    "patterns_valid_at",
    f"""WITH {WEEKLY} SELECT * FROM patterns WHERE valid_from <= '2024-01-24 12:00:00'
    AND (valid_until IS NULL OR valid_until > '2024-01-24 12:00:00')""",
)
def patterns_valid_at(spark, sf):
    found = weekly_patterns(spark, sf).drop("detected_at")
    return behavior.valid_at(found, like(found, "2024-01-24 12:00:00", "valid_from"))


@query(
    "readings_with_patterns",
    f"""WITH {WEEKLY} SELECT l.event_id, l.room_id, l.ts, pattern_type, confidence, valid_from, valid_until FROM log l
    LEFT JOIN patterns p ON l.room_id = p.room_id AND valid_from <= ts AND (valid_until IS NULL OR valid_until > ts)""",
)
def readings_with_patterns(spark, sf):
    """Every accepted reading with its room's pattern in force."""
    log = log_of(spark, sf).select("event_id", "room_id", "ts")
    found = behavior.with_pattern_in_force(log, weekly_patterns(spark, sf).drop("detected_at"))
    return found.select("event_id", "room_id", "ts", "pattern_type", "confidence", "valid_from", "valid_until")


@query(
    "incremental_baselines",
    f"""WITH {LOG} SELECT room_id, sensor_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n
    FROM log GROUP BY room_id, sensor_type""",
)
def incremental_baselines(spark, sf):
    """Baselines kept from increments: each run folds in the readings that no run before it had."""
    log = log_of(spark, sf).select("event_id", "room_id", "sensor_type", "value")
    keys = ["room_id", "sensor_type"]
    table = MergeTable(spark, scratch_path(spark, "baselines"), moment_schema(log, keys), partials.merge_moments(keys), compact_every=2)
    arrival = F.crc32(F.col("event_id").cast("binary")) % 4
    for run in range(4):
        processed = log.where(arrival < run).select("event_id")
        new = behavior.unprocessed(log.where(arrival <= run), processed, "event_id")
        table.put(partials.moments(new, keys), run)
        table.maybe_compact(run)
    kept = partials.baselines_of_moments(table.read(), keys)
    return kept.select(*keys, F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "n")


def moment_schema(readings, keys):
    return partials.moments(readings.limit(0), keys).schema


PAGE = 40


@query(
    "insights",
    f"""WITH {WEEKLY}, {z_sql('log', 'room_id, sensor_type')},
    items AS (SELECT room_id, 'pattern' AS kind, pattern_type AS what, CAST(confidence AS VARCHAR) AS level, valid_from AS ts,
        row_number() OVER (PARTITION BY room_id ORDER BY valid_from) AS p FROM patterns
      UNION ALL SELECT room_id, 'anomaly', sensor_type, severity, ts,
        row_number() OVER (PARTITION BY room_id ORDER BY ts, event_id) FROM found)
    SELECT room_id, CAST((p - 1) // {PAGE} AS INTEGER) AS page, kind, CAST((p - 1) % {PAGE} AS INTEGER) AS position,
      what, level, ts FROM items""",
)
def insights(spark, sf):
    """Insight documents, opened again so that SQL can say the same."""
    log = log_of(spark, sf).select("room_id", "sensor_type", "event_id", "ts", "value")

    def item(what: str, level) -> F.Column:
        return F.struct(F.col(what).alias("what"), level.cast("string").alias("level"), F.col("ts"))

    patterns = weekly_patterns(spark, sf).withColumn("ts", F.col("detected_at"))
    anomalies = behavior.statistical_anomalies(log)
    pages = behavior.insight_pages(
        patterns.select("room_id", "ts", F.col("pattern_type").alias("item_id"), item("pattern_type", F.col("confidence")).alias("item")),
        anomalies.select("room_id", "ts", F.col("event_id").alias("item_id"), item("sensor_type", F.col("severity")).alias("item")),
        page_size=PAGE,
    )
    both = F.concat(
        F.transform("patterns", lambda e, i: F.struct(F.lit("pattern").alias("kind"), i.alias("position"), e.alias("e"))),
        F.transform("anomalies", lambda e, i: F.struct(F.lit("anomaly").alias("kind"), i.alias("position"), e.alias("e"))),
    )
    rows = pages.select("room_id", "page", F.explode(both).alias("x"))
    return rows.select("room_id", "page", "x.kind", "x.position", "x.e.what", "x.e.level", "x.e.ts")


@query(
    "run_stats",
    f"""WITH {SCHEDULE} SELECT count(*) AS processed, count(*) FILTER (WHERE status <> 'normal') AS anomalies,
    max(ts) AS last_run, (SELECT round(avg(CAST(confidence AS DOUBLE)) * 100, 6) FROM schedule) AS confidence_pct FROM log""",
)
def run_stats(spark, sf):
    log = log_of(spark, sf)
    return behavior.run_stats(log, behavior.occupancy_schedule(log))


@query(
    "pattern_table",
    f"""WITH {LOG}, parts AS (SELECT * FROM (VALUES ('early', 6, 10), ('midday', 10, 15), ('late', 15, 22)) t(pattern, f, u)),
    days AS (SELECT room_id, CAST(ts AS DATE) AS day, pattern,
      bool_or(sensor_type = 'occupancy' AND value > 0 AND hour(ts) >= f AND hour(ts) < u) AS used,
      count(*) FILTER (WHERE status <> 'normal' AND hour(ts) >= f AND hour(ts) < u) AS bad
      FROM log, parts GROUP BY ALL)
    SELECT room_id, pattern, round(count(*) FILTER (WHERE used) * 100.0::DOUBLE / count(*), 6) AS frequency_pct,
      CAST(sum(bad) AS BIGINT) AS anomalies FROM days GROUP BY ALL""",
)
def pattern_table(spark, sf):
    return behavior.pattern_table(log_of(spark, sf), [("early", 6, 10), ("midday", 10, 15), ("late", 15, 22)])


@query(
    "hourly_activity",
    """WITH t AS (SELECT date_trunc('hour', max(ts))::TIMESTAMP AS h FROM events),
    grid AS (SELECT h - INTERVAL 1 HOUR * i AS hour FROM t, range(24) r(i)),
    c AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1),
    f AS (SELECT hour, coalesce(n, 0) AS n FROM grid LEFT JOIN c USING (hour))
    SELECT hour, n, coalesce(round(n * 100.0::DOUBLE / max(n) OVER (), 6), 0) AS height_pct FROM f""",
)
def hourly_activity(spark, sf):
    return behavior.hourly_activity(tables.table(spark, sf, "events"))
