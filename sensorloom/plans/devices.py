"""Device registry, liveness and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions.times import trunc_like
from sensorloom.operators import devices, ingest, reads
from sensorloom.plans import query
from sensorloom.plans.rooms import newest
from sensorloom.plans.sql import KIND, REGISTRY, age
from sensorloom.sources import tables

# Test limits: the documented tiers are never reached by the given devices.
TIERS = {"free": 1, "standard": 2}
ADMIT = 1

MESSAGES = """messages AS (SELECT CAST(event_id AS VARCHAR) AS message_id, user_id AS device_id, ts,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processed' END AS status FROM events)"""


@query(
    "device_registrations",
    f"""WITH {REGISTRY}, first AS (SELECT user_id AS device_id, event_type, ts, event_id FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
    SELECT coalesce(f.device_id, r.device_id) AS device_id, coalesce(f.event_type, r.device_type) AS device_type,
      CASE WHEN f.device_id IS NULL THEN r.location ELSE 'event-' || CAST(f.event_id AS VARCHAR) END AS location
    FROM registry r FULL JOIN first f ON r.device_id = f.device_id""",
)
def device_registrations(spark, sf):
    """Every event registers its device anew; the last one wins over the registry."""
    registry = tables.device_registry(spark, sf).withColumn("registered_at", F.lit(None).cast("timestamp_ntz"))
    again = tables.table(spark, sf, "events").select(
        F.col("user_id").alias("device_id"),
        F.col("event_type").alias("device_type"),
        F.lit("free").alias("tier"),
        F.lit("registered").alias("status"),
        F.create_map(F.lit("location"), F.concat(F.lit("event-"), F.col("event_id").cast("string"))).alias("metadata"),
        F.col("ts").alias("registered_at"),
    )
    merged = devices.register(registry, again)
    return merged.select("device_id", "device_type", F.col("metadata")["location"].alias("location"))


@query(
    "device_status",
    f"""WITH {REGISTRY}, {MESSAGES}, t AS (SELECT max(ts) AS m FROM messages), s AS (SELECT device_id, max(ts) AS last_seen,
      count(*) FILTER (WHERE ts >= date_trunc('day', m)) AS today, count(*) FILTER (WHERE ts >= date_trunc('hour', m)) AS hr
      FROM messages, t GROUP BY 1),
    j AS (SELECT r.*, last_seen, epoch_us(m) - epoch_us(last_seen) AS us, coalesce(today, 0) AS today, coalesce(hr, 0) AS hr
      FROM registry r CROSS JOIN t LEFT JOIN s ON r.device_id = s.device_id)
    SELECT device_id, device_type, tier, CASE WHEN status = 'suspended' THEN 'suspended' WHEN us <= 3600000000 THEN 'online'
      ELSE 'offline' END AS status, last_seen, CASE WHEN us // 1000000 < 30 THEN 'ok' WHEN us // 1000000 < 300 THEN 'slow'
      ELSE 'down' END AS health, {age("(us // 1000000)")} AS age, today AS message_count_today,
      CAST(greatest(CASE tier WHEN 'free' THEN 1000 ELSE 10000 END - hr, 0) AS BIGINT) AS rate_limit_remaining FROM j""",
)
def device_status(spark, sf):
    messages = tables.messages(spark, sf)
    return devices.device_status(tables.device_registry(spark, sf), messages, newest(messages))


@query(
    "messages_today",
    f"""WITH {MESSAGES}, t AS (SELECT max(ts) AS m FROM messages) SELECT device_id, count(*) AS message_count_today
    FROM messages, t WHERE ts >= date_trunc('day', m) GROUP BY 1""",
)
def messages_today(spark, sf):
    messages = tables.messages(spark, sf)
    return devices.messages_today(messages, newest(messages))


@query(
    "rate_limit_hourly",
    f"""WITH {REGISTRY}, {MESSAGES}, c AS (SELECT device_id, date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS request_count
      FROM messages GROUP BY ALL), l AS (SELECT c.*, CAST(CASE tier WHEN 'free' THEN {TIERS["free"]} WHEN 'standard'
      THEN {TIERS["standard"]} END AS BIGINT) AS "limit" FROM c LEFT JOIN registry r ON c.device_id = r.device_id)
    SELECT *, CASE WHEN "limit" IS NOT NULL THEN greatest("limit" - request_count, 0) END AS remaining, coalesce(request_count > "limit", false) AS exceeded FROM l""",
)
def rate_limit_hourly(spark, sf):
    return devices.hourly_usage(tables.messages(spark, sf), tables.device_registry(spark, sf), TIERS)


@query(
    "burst_minutes",
    f"""WITH {MESSAGES} SELECT device_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, count(*) AS n
    FROM messages GROUP BY ALL HAVING count(*) > 1""",
)
def burst_minutes(spark, sf):
    return devices.bursts(tables.messages(spark, sf), 1)


@query(
    "burst_sliding",
    f"""WITH {MESSAGES}, w AS (SELECT device_id, to_timestamp(epoch_us(ts) // 10000000 * 10 - 10 * i)::TIMESTAMP AS window_start
      FROM messages, range(6) r(i)) SELECT device_id, window_start, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1""",
)
def burst_sliding(spark, sf):
    return devices.bursts(tables.messages(spark, sf), 1, "10 seconds")


@query(
    "admission",
    f"""WITH {MESSAGES} SELECT message_id, device_id, ts, row_number() OVER (PARTITION BY device_id, date_trunc('hour', ts)
    ORDER BY ts, message_id) AS number, row_number() OVER (PARTITION BY device_id, date_trunc('hour', ts)
    ORDER BY ts, message_id) <= {ADMIT} AS admitted FROM messages""",
)
def admission(spark, sf):
    messages = tables.messages(spark, sf).select("message_id", "device_id", "ts")
    return devices.admission(messages, ADMIT)


@query(
    "rate_per_minute",
    f"""WITH {MESSAGES} SELECT device_id, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS per_minute FROM messages GROUP BY ALL""",
)
def rate_per_minute(spark, sf):
    return devices.minute_rates(tables.messages(spark, sf))


@query(
    "last_minute_rate",
    f"""WITH {MESSAGES}, t AS (SELECT date_trunc('minute', max(ts)) + INTERVAL 1 MINUTE AS e FROM messages)
    SELECT device_id, count(*) AS per_minute FROM messages, t WHERE ts >= e - INTERVAL 1 MINUTE AND ts < e GROUP BY 1""",
)
def last_minute_rate(spark, sf):
    messages = tables.messages(spark, sf)
    after = newest(messages) + F.expr("INTERVAL 1 MINUTE")
    return devices.rate_per_minute(messages, trunc_like(messages, "minute", after))


@query(
    "message_lifecycle",
    f"""WITH {MESSAGES} SELECT device_id, count(*) FILTER (WHERE status = 'queued') AS queued,
    count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM messages GROUP BY 1""",
)
def message_lifecycle(spark, sf):
    return devices.lifecycle_counts(tables.messages(spark, sf))


PAYLOAD = f"""{REGISTRY}, placed AS (SELECT e.*, r.location FROM events e LEFT JOIN registry r ON e.user_id = r.device_id),
  payload AS (SELECT CAST(event_id AS VARCHAR) || '_' || sensor_type AS event_id, location AS room_id, user_id AS device_id,
    sensor_type, value, ts FROM (SELECT event_id, user_id, location, ts, value, CASE event_type WHEN 'view' THEN 'temperature'
      WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'occupancy' WHEN 'signup' THEN 'motion' ELSE 'pressure' END AS sensor_type
      FROM placed UNION ALL SELECT event_id, user_id, location, ts, CAST(json_extract(props, '$.k') AS DOUBLE), 'battery' FROM placed))"""


@query("payload_readings", f"WITH {PAYLOAD} SELECT * FROM payload")
def payload_readings(spark, sf):
    return devices.payload_readings(tables.messages(spark, sf), tables.device_registry(spark, sf))


@query(
    "payload_status",
    f"""WITH {PAYLOAD}, k AS (SELECT *, {KIND} AS kind FROM payload WHERE room_id IS NOT NULL
      AND sensor_type IN ('temperature', 'motion', 'occupancy', 'humidity'))
    SELECT sensor_type, CASE WHEN kind LIKE 'critical%' THEN 'alert' WHEN kind IS NOT NULL THEN 'warning' ELSE 'normal' END
      AS status, count(*) AS n FROM k GROUP BY ALL""",
)
def payload_status(spark, sf):
    """Payload readings through the same validation and classification as room events."""
    read = devices.payload_readings(tables.messages(spark, sf), tables.device_registry(spark, sf))
    given = read.withColumn("status", F.lit(None).cast("string"))
    return ingest.status_counts(ingest.accepted_log(given))


@query(
    "live_feed",
    f"""WITH {MESSAGES} SELECT message_id, device_id, strftime(ts, '%H:%M:%S') AS time, CASE status WHEN 'failed'
    THEN 'Message failed' WHEN 'queued' THEN 'Message queued' ELSE 'Message processed' END AS label
    FROM messages ORDER BY ts DESC, message_id DESC LIMIT 20""",
)
def live_feed(spark, sf):
    label = F.concat(F.lit("Message "), F.col("status"))
    return reads.live_feed(tables.messages(spark, sf), label)
