"""Ingest, room state and room reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.ids import derived_event_id
from sensorloom.functions.times import like, time_chunk, trunc_like
from sensorloom.operators import alerts, classify, enrich, ingest, reads, records, state, validate
from sensorloom.plans import query
from sensorloom.plans.sql import DIMENSION, EPOCH, LOG, READINGS, ROOMS, UNIT, age, iso
from sensorloom.schema import DEFAULT_RULES, SENSOR_TYPES, Rule
from sensorloom.sources import raw, tables

ROOM = "room-007"


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.accepted_log(tables.readings(spark, sf))


def rooms_of(spark: SparkSession, sf: str) -> DataFrame:
    return state.fold_rooms_by_sensor(log_of(spark, sf))


def newest(df: DataFrame):
    return df.agg(F.max("ts")).scalar()


LOG_COLUMNS = ["event_id", "room_id", "sensor_type", "value", "ts", "unit", "status"]
LOG_LIST = ", ".join(LOG_COLUMNS)
FLAT_ROOM = "room_id, name, status, last_update, temperature, motion, occupancy, humidity, alert_count_24h"


# --- ingest ------------------------------------------------------------------


@query(
    "status_counts",
    f"WITH {LOG} SELECT sensor_type, status, count(*) AS n FROM log GROUP BY ALL",
)
def status_counts(spark, sf):
    return ingest.status_counts(log_of(spark, sf))


@query("classified_events", f"WITH {LOG} SELECT {LOG_LIST} FROM log")
def classified_events(spark, sf):
    return log_of(spark, sf).select(*LOG_COLUMNS)


@query("classified_by_table", f"WITH {LOG} SELECT event_id, sensor_type, value, status FROM log")
def classified_by_table(spark, sf):
    checked = enrich.enrich(validate.accept(tables.readings(spark, sf)))
    rules = classify.rule_frame(spark)
    return classify.classify_by_table(checked, rules).select("event_id", "sensor_type", "value", "status")


@query(
    "extra_sensor_rules",
    f"""WITH {LOG} SELECT event_id, sensor_type, value, status FROM log
    UNION ALL SELECT event_id, sensor_type, value, CASE WHEN value >= 200 THEN 'alert'
    WHEN value > 100 THEN 'warning' ELSE 'normal' END AS status FROM readings WHERE sensor_type = 'pressure'""",
)
def extra_sensor_rules(spark, sf):
    domain = (*SENSOR_TYPES, "pressure")
    rules = (*DEFAULT_RULES, Rule("pressure", None, None, 100.0, 200.0))
    checked = validate.accept(tables.readings(spark, sf), domain)
    return classify.classify(enrich.enrich(checked), rules).select("event_id", "sensor_type", "value", "status")


@query(
    "breach_detail",
    f"""WITH {LOG}, limits AS (SELECT *, CASE
      WHEN sensor_type = 'temperature' THEN CASE kind WHEN 'critical_high' THEN 30.0 WHEN 'critical_low' THEN 10.0
        WHEN 'high' THEN 26.0 WHEN 'low' THEN 18.0 END
      WHEN sensor_type = 'humidity' THEN CASE kind WHEN 'critical_high' THEN 80.0 WHEN 'critical_low' THEN 20.0
        WHEN 'high' THEN 70.0 WHEN 'low' THEN 30.0 END
      ELSE CASE kind WHEN 'critical_high' THEN 30.0 WHEN 'high' THEN 20.0 WHEN 'low' THEN 0.0 END END::DOUBLE AS bound
      FROM log WHERE kind IS NOT NULL)
    SELECT event_id, kind, bound, status AS severity,
      sensor_type || ' ' || CAST(value AS VARCHAR) || unit || CASE kind
        WHEN 'critical_high' THEN ' reaches the critical maximum '
        WHEN 'critical_low' THEN ' reaches the critical minimum '
        WHEN 'high' THEN ' exceeds the maximum ' ELSE ' is under the minimum ' END
      || CAST(bound AS VARCHAR) || unit AS message FROM limits""",
)
def breach_detail(spark, sf):
    found = classify.explain_breaches(validate.accept(tables.readings(spark, sf)))
    return found.select(
        "event_id",
        F.col("breach.kind").alias("kind"),
        F.col("breach.limit").alias("bound"),
        F.col("breach.severity").alias("severity"),
        F.col("breach.text").alias("message"),
    )


@query(
    "escalated_status",
    f"""WITH {LOG}, given AS (SELECT *, CASE CAST(event_id AS BIGINT) % 4 WHEN 1 THEN 'normal'
      WHEN 2 THEN 'warning' WHEN 3 THEN 'alert' END AS supplied FROM log)
    SELECT event_id, supplied, status AS detected,
      CASE WHEN 'alert' IN (coalesce(supplied, ''), status) THEN 'alert'
           WHEN 'warning' IN (coalesce(supplied, ''), status) THEN 'warning'
           ELSE 'normal' END AS final_status FROM given""",
)
def escalated_status(spark, sf):
    number = F.col("event_id").cast("bigint") % 4
    supplied = F.when(number == 1, "normal").when(number == 2, "warning").when(number == 3, "alert")
    given = tables.readings(spark, sf).withColumns({"status": supplied, "supplied": supplied})
    return ingest.accepted_log(given).select(
        "event_id", "supplied", F.col("detected_status").alias("detected"), F.col("status").alias("final_status")
    )


@query(
    "default_units",
    f"""WITH {LOG} SELECT event_id, CASE WHEN CAST(event_id AS BIGINT) % 5 = 0 THEN 'raw'
    ELSE unit END AS unit, status FROM (SELECT event_id, {UNIT} AS unit, 'normal' AS status FROM kinds)""",
)
def default_units(spark, sf):
    kept = F.when(F.col("event_id").cast("bigint") % 5 == 0, "raw")
    checked = validate.accept(tables.readings(spark, sf).withColumn("unit", kept))
    return enrich.enrich(checked).select("event_id", "unit", "status")


@query(
    "derived_event_id",
    f"""WITH {LOG} SELECT event_id AS source_id, room_id || '_' || {EPOCH} || '_' || sensor_type AS event_id,
    room_id || '_' || {EPOCH} AS literal_id FROM log""",
)
def derived_event_ids(spark, sf):
    checked = validate.accept(tables.readings(spark, sf)).withColumnRenamed("event_id", "source_id")
    filled = enrich.enrich(checked)
    literal = derived_event_id(F.col("room_id"), F.col("ts"))
    return filled.select("source_id", "event_id", literal.alias("literal_id"))


@query(
    "rejects_by_reason",
    f"""WITH {READINGS} SELECT 'unprocessable' AS reject_class, 'sensor_type:domain' AS reason, count(*) AS n
    FROM readings WHERE sensor_type NOT IN ('temperature', 'motion', 'occupancy', 'humidity') HAVING count(*) > 0""",
)
def rejects_by_reason(spark, sf):
    return ingest.rejects_by_reason(validate.reject(tables.readings(spark, sf)))


@query(
    "ingest_stats",
    f"""WITH {READINGS}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE sensor_type <> 'pressure') AS accepted,
      count(*) FILTER (WHERE sensor_type = 'pressure') AS rejected FROM readings)
    SELECT *, coalesce(round(accepted * 100.0::DOUBLE / total, 6), 0.0::DOUBLE) AS success_pct FROM c""",
)
def ingest_stats(spark, sf):
    return ingest.ingest_stats(tables.readings(spark, sf))


@query(
    "acknowledgements",
    f"WITH {LOG} SELECT event_id, status AS event_status, 'success' AS processing_status FROM log",
)
def acknowledgements(spark, sf):
    # The processing time differs on every run, so it is left out of the comparison.
    return ingest.acknowledgements(log_of(spark, sf)).drop("processed_at")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return as_bodies(tables.readings(spark, sf))


def as_bodies(readings: DataFrame) -> DataFrame:
    """Readings written as JSON bodies, damaged in ten ways by event number."""
    r = readings.withColumn("_n", F.col("event_id").cast("bigint") % 10)
    text = F.to_json(
        F.struct(
            "event_id", "room_id", "sensor_type", "value",
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        )
    )
    n = F.col("_n")
    return r.select(
        F.when(n == 1, F.regexp_replace(text, '"room_id":"[^"]*",', ""))
        .when(n == 2, F.concat(text, F.lit("]")))
        .when(n == 3, "")
        .when(n == 4, F.regexp_replace(text, '"value":[^,]*', '"value":"NaN"'))
        .when(n == 5, F.regexp_replace(text, '"room_id":"', '"room_id":"' + "x" * 50))
        .when(n == 6, F.regexp_replace(text, '"value":[^,]*', '"value":null'))
        .when(n == 7, F.regexp_replace(text, '"value":([^,]*)', '"value":"$1"'))
        .when(n == 8, F.regexp_replace(text, 'Z"', '+02:00"'))
        .when(n == 9, F.concat(F.lit("["), text, F.lit("]")))
        .otherwise(text)
        .alias("body")
    )


@query(
    "parsed_bodies",
    f"""WITH {LOG} SELECT event_id, room_id, sensor_type, value,
      CASE WHEN CAST(event_id AS BIGINT) % 10 = 8 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts, unit, status
    FROM log WHERE CAST(event_id AS BIGINT) % 10 IN (0, 7, 8)""",
)
def parsed_bodies(spark, sf):
    accepted, _ = validate.check_parsed(raw.parse_bodies(bodies(spark, sf)))
    log = classify.classify(enrich.enrich(accepted))
    return log.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*LOG_COLUMNS)


@query(
    "parsed_rejects",
    f"""WITH {READINGS}, n AS (SELECT CAST(event_id AS BIGINT) % 10 AS n, sensor_type = 'pressure' AS p FROM readings),
    r AS (
      SELECT 'bad_request' AS reject_class, 'missing:room_id' AS reason, p, 'sensor' AS also FROM n WHERE n = 1
      UNION ALL SELECT 'bad_request', 'body:malformed', false, '' FROM n WHERE n = 2
      UNION ALL SELECT 'bad_request', 'body:empty', false, '' FROM n WHERE n = 3
      UNION ALL SELECT 'unprocessable', 'value:not_finite', p, '' FROM n WHERE n = 4
      UNION ALL SELECT 'unprocessable', 'room_id:length', p, '' FROM n WHERE n = 5
      UNION ALL SELECT 'unprocessable', 'value:invalid', p, '' FROM n WHERE n = 6
      UNION ALL SELECT 'bad_request', 'missing:' || f, false, '' FROM n,
        (VALUES ('room_id'), ('sensor_type'), ('value'), ('timestamp')) v(f) WHERE n = 9),
    every AS (SELECT reject_class, reason FROM r
      UNION ALL SELECT reject_class, 'sensor_type:domain' FROM r WHERE p
      UNION ALL SELECT 'unprocessable', 'sensor_type:domain' FROM n WHERE p AND n IN (0, 7, 8))
    SELECT reject_class, reason, count(*) AS n FROM every GROUP BY ALL""",
)
def parsed_rejects(spark, sf):
    _, rejected = validate.check_parsed(raw.parse_bodies(bodies(spark, sf)))
    return ingest.rejects_by_reason(rejected)


@query(
    "retried_deliveries",
    f"""WITH {LOG} SELECT room_id || '_' || {EPOCH} || '_' || sensor_type AS event_id, room_id, sensor_type,
    value, ts FROM log""",
)
def retried_deliveries(spark, sf):
    """Every reading sent one to three times without an id; the derived id finds the copies."""
    sent = tables.readings(spark, sf)
    copies = F.sequence(F.lit(0), (F.col("event_id").cast("bigint") % 3).cast("int"))
    sent = sent.withColumn("_copy", F.explode(copies)).withColumn("event_id", F.lit(None).cast("string"))
    return ingest.drop_retries(enrich.enrich(validate.accept(sent))).select(
        "event_id", "room_id", "sensor_type", "value", "ts"
    )


@query(
    "checked_rooms",
    f"""WITH {ROOMS}, given AS (SELECT room_id, CASE WHEN room_id LIKE '%3' THEN 'closed' ELSE status END AS status,
      CASE WHEN room_id LIKE '%5' THEN -1 ELSE alert_count_24h END AS alert_count_24h FROM rooms)
    SELECT room_id, status, alert_count_24h, nullif(concat_ws(',',
      CASE WHEN room_id LIKE '%3' THEN 'status:domain' END,
      CASE WHEN room_id LIKE '%5' THEN 'alert_count_24h:negative' END), '') AS reasons FROM given""",
)
def checked_rooms(spark, sf):
    given = rooms_of(spark, sf).withColumns(
        {
            "status": F.when(F.col("room_id").endswith("3"), "closed").otherwise(F.col("status")),
            "alert_count_24h": F.when(F.col("room_id").endswith("5"), -1).otherwise(F.col("alert_count_24h")),
        }
    )
    good, bad = validate.check_rooms(given)
    columns = ["room_id", "status", "alert_count_24h"]
    return good.select(*columns, F.lit(None).cast("string").alias("reasons")).unionByName(
        bad.select(*columns, F.array_join("reject_reasons", ",").alias("reasons"))
    )


# --- events: reads -------------------------------------------------------------


@query("event_scan", f"WITH {READINGS} SELECT event_id, room_id, sensor_type, value, ts FROM readings")
def event_scan(spark, sf):
    return tables.readings(spark, sf).select("event_id", "room_id", "sensor_type", "value", "ts")


@query("events_by_room", f"WITH {LOG} SELECT {LOG_LIST} FROM log WHERE room_id = '{ROOM}'")
def events_by_room(spark, sf):
    return reads.events_of_room(log_of(spark, sf).select(*LOG_COLUMNS), ROOM)


REGISTERED = "(SELECT room_id FROM dim WHERE floor > 0)"


def registered_rooms(spark: SparkSession, sf: str) -> DataFrame:
    """Rooms above the ground floor are the registered ones."""
    return tables.room_dimension(spark, sf).filter(F.col("floor") > 0)


@query(
    "events_of_known_rooms",
    f"WITH {LOG}, {DIMENSION} SELECT {LOG_LIST} FROM log WHERE room_id IN {REGISTERED}",
)
def events_of_known_rooms(spark, sf):
    log = log_of(spark, sf).select(*LOG_COLUMNS)
    return reads.events_of_known_rooms(log, registered_rooms(spark, sf)).select(*LOG_COLUMNS)


@query(
    "unknown_rooms",
    f"WITH {LOG}, {DIMENSION} SELECT room_id, count(*) AS events FROM log WHERE room_id NOT IN {REGISTERED} GROUP BY 1",
)
def unknown_rooms(spark, sf):
    return reads.unknown_rooms(log_of(spark, sf), registered_rooms(spark, sf))


@query(
    "recent_of_room",
    f"""WITH {LOG} SELECT {LOG_LIST} FROM log WHERE room_id = '{ROOM}' AND ts >= '2024-01-05'
    ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def recent_of_room(spark, sf):
    log = log_of(spark, sf).select(*LOG_COLUMNS)
    return reads.recent_of_room(log, ROOM, start=like(log, "2024-01-05 00:00:00"))


@query(
    "recent_per_room",
    f"""WITH {LOG} SELECT {LOG_LIST}, CAST(row_number() OVER (PARTITION BY room_id ORDER BY ts DESC, event_id DESC)
    AS INTEGER) AS rank FROM log QUALIFY rank <= 50""",
)
def recent_per_room(spark, sf):
    return reads.recent_per_key(log_of(spark, sf).select(*LOG_COLUMNS))


@query("recent_global", f"WITH {LOG} SELECT {LOG_LIST} FROM log ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_global(spark, sf):
    return reads.recent_global(log_of(spark, sf).select(*LOG_COLUMNS))


# --- rooms ---------------------------------------------------------------------


@query("room_state", f"WITH {ROOMS} SELECT {FLAT_ROOM} FROM rooms")
def room_state(spark, sf):
    return state.flat_state(rooms_of(spark, sf))


@query(
    "room_state_arrival",
    f"""WITH {LOG}, arrived AS (SELECT *, epoch_us(ts) % 1000003 AS arrival FROM log)
    SELECT room_id, coalesce(arg_max(status, (arrival, event_id)) FILTER (WHERE status <> 'normal'), 'active') AS status,
      arg_max(ts, (arrival, event_id)) AS last_update,
      arg_max(value, (arrival, event_id)) FILTER (WHERE sensor_type = 'temperature') AS temperature,
      count(*) FILTER (WHERE status <> 'normal') AS alert_count_24h FROM arrived GROUP BY room_id""",
)
def room_state_arrival(spark, sf):
    """The fold in arrival order (here a scrambled one), with the last arrival's time."""
    log = log_of(spark, sf)
    arrived = log.withColumn("arrival", F.unix_micros(F.col("ts").cast("timestamp")) % 1000003)
    folded = state.flat_state(state.fold_rooms(arrived, ("arrival", "event_id")))
    return folded.select("room_id", "status", "last_update", "temperature", "alert_count_24h")


@query("room_list", f"WITH {ROOMS}, {DIMENSION} SELECT r.room_id, coalesce(d.name, r.name) AS name, status FROM rooms r LEFT JOIN dim d ON r.room_id = d.room_id")
def room_list(spark, sf):
    named = state.name_rooms(rooms_of(spark, sf), tables.room_dimension(spark, sf))
    return reads.room_list(named).select("room_id", "name", "status")


@query("room_count", f"WITH {ROOMS} SELECT count(*) AS count FROM rooms")
def room_count(spark, sf):
    return reads.room_count(rooms_of(spark, sf))


@query("room_lookup", f"WITH {ROOMS} SELECT {FLAT_ROOM} FROM rooms WHERE room_id = '{ROOM}'")
def room_lookup(spark, sf):
    return state.flat_state(reads.room_by_id(rooms_of(spark, sf), ROOM))


@query(
    "room_detail",
    f"""WITH {LOG}, {DIMENSION}, ranked AS (SELECT *, row_number() OVER (PARTITION BY room_id
      ORDER BY ts DESC, event_id DESC) AS rank FROM log QUALIFY rank <= 50),
    sizes AS (SELECT room_id, count(*) AS n FROM ranked GROUP BY 1)
    SELECT d.room_id, d.name, CAST(coalesce(s.n, 0) AS INTEGER) AS event_count, CAST(r.rank AS INTEGER) AS position,
      r.event_id, r.sensor_type, r.value, r.ts, r.status AS event_status
    FROM dim d LEFT JOIN sizes s ON d.room_id = s.room_id LEFT JOIN ranked r ON d.room_id = r.room_id""",
)
def room_detail(spark, sf):
    log = log_of(spark, sf).select("room_id", "event_id", "sensor_type", "value", "ts", "status")
    details = reads.room_details(tables.room_dimension(spark, sf).select("room_id", "name"), log)
    rows = details.select("room_id", "name", "event_count", F.posexplode_outer("recent_events").alias("p", "e"))
    return rows.select(
        "room_id", "name", "event_count", (F.col("p") + 1).alias("position"),
        "e.event_id", "e.sensor_type", "e.value", "e.ts", F.col("e.status").alias("event_status"),
    )


@query(
    "rolling_alerts_24h",
    f"""WITH {LOG} SELECT room_id, event_id, ts, status, count(*) OVER (PARTITION BY room_id ORDER BY ts
      RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) AS anomalies_in_span
    FROM log WHERE status <> 'normal'""",
)
def rolling_alerts_24h(spark, sf):
    return state.rolling_anomalies(log_of(spark, sf))


@query(
    "alerts_24h_as_of",
    f"""WITH {LOG}, t AS (SELECT max(ts) AS m FROM log) SELECT room_id,
      count(*) FILTER (WHERE status <> 'normal' AND ts > m - INTERVAL 24 HOUR) AS anomalies_in_span
    FROM log, t GROUP BY room_id""",
)
def alerts_24h_as_of(spark, sf):
    log = log_of(spark, sf)
    return state.anomalies_as_of(log, newest(log))


def _images(side: str) -> str:
    last = "last_value({} IGNORE NULLS) OVER w_" + side
    return f"""
      {last.format("CASE WHEN sensor_type = 'temperature' THEN value END")} AS {side}_temperature,
      {last.format("CASE WHEN sensor_type = 'occupancy' THEN CAST(trunc(value) AS INTEGER) END")} AS {side}_occupancy,
      {last.format("CASE WHEN sensor_type = 'motion' THEN value <> 0 END")} AS {side}_motion,
      {last.format("CASE WHEN sensor_type = 'humidity' THEN value END")} AS {side}_humidity,
      {last.format("CASE WHEN status <> 'normal' THEN status END")} AS {side}_bad,
      count(*) FILTER (WHERE status <> 'normal') OVER w_{side} AS {side}_count,
      max(ts) OVER w_{side} AS {side}_update"""


@query(
    "room_change_feed",
    f"""WITH {LOG}, i AS (SELECT room_id, ts, event_id, {_images("old")}, {_images("new")} FROM log
      WINDOW w_new AS (PARTITION BY room_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
             w_old AS (PARTITION BY room_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT room_id, ts, event_id, CASE WHEN old_update IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS change,
      CASE WHEN old_update IS NOT NULL THEN coalesce(old_bad, 'active') END AS old_status, old_update, old_temperature,
      old_occupancy, old_motion, old_humidity, CASE WHEN old_update IS NOT NULL THEN old_count END AS old_count,
      coalesce(new_bad, 'active') AS new_status, new_update, new_temperature, new_occupancy, new_motion, new_humidity, new_count FROM i""",
)
def room_change_feed(spark, sf):
    feed = state.room_changes(log_of(spark, sf))
    return feed.select(
        "room_id", "ts", "event_id", "change",
        *[
            F.col(f"{side}_image.{path}").alias(f"{side}_{name}")
            for side in ("old", "new")
            for path, name in (
                ("status", "status"), ("last_update", "update"), ("current_state.temperature", "temperature"),
                ("current_state.occupancy", "occupancy"), ("current_state.motion", "motion"),
                ("current_state.humidity", "humidity"), ("alert_count_24h", "count"),
            )
        ],
    )


@query(
    "stale_rooms",
    f"""WITH {ROOMS}, t AS (SELECT max(ts) AS m FROM log), a AS (SELECT *, epoch_us(m) - epoch_us(last_update) AS us FROM rooms, t)
    SELECT room_id, CASE WHEN us > 3600000000 THEN 'offline' ELSE status END AS status, last_update,
      CAST(us // 1000000 AS BIGINT) AS age_seconds, {age("(us // 1000000)")} AS age FROM a""",
)
def stale_rooms(spark, sf):
    log = log_of(spark, sf)
    rooms = state.mark_offline(state.fold_rooms_by_sensor(log), newest(log))
    return rooms.select("room_id", "status", "last_update", "age_seconds", "age")


@query(
    "room_utilisation",
    f"""WITH {ROOMS}, {DIMENSION} SELECT r.room_id, floor, capacity, occupancy,
    occupancy::DOUBLE / capacity::DOUBLE AS utilisation FROM rooms r LEFT JOIN dim d ON r.room_id = d.room_id""",
)
def room_utilisation(spark, sf):
    used = state.utilisation(rooms_of(spark, sf), tables.room_dimension(spark, sf))
    return used.select("room_id", "floor", "capacity", "current_state.occupancy", "utilisation")


# --- stored forms, upserts, patches ----------------------------------------------


def hourly_key(log: DataFrame) -> DataFrame:
    """Readings keyed by the hour, so that several writes meet under one key."""
    return log.withColumn("hour", trunc_like(log, "hour", F.col("ts")))


@query(
    "collapsed_events",
    f"""WITH {LOG} SELECT room_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, sensor_type, value, ts, status
    FROM log QUALIFY row_number() OVER (PARTITION BY room_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) = 1""",
)
def collapsed_events(spark, sf):
    puts = hourly_key(log_of(spark, sf)).select(
        "room_id", "hour", "event_id", "sensor_type", "value", "ts", "status"
    )
    return records.collapse_events(puts, ("room_id", "hour"))


@query(
    "event_change_feed",
    f"""WITH {LOG}, f AS (SELECT room_id, date_trunc('hour', ts)::TIMESTAMP AS hour, event_id, ts, value, status FROM log)
    SELECT room_id, hour, event_id, lag(event_id) OVER w AS old_event_id, lag(value) OVER w AS old_value,
      lag(status) OVER w AS old_status, value AS new_value, status AS new_status,
      CASE WHEN lag(event_id) OVER w IS NULL THEN 'INSERT' ELSE 'MODIFY' END AS change
    FROM f WINDOW w AS (PARTITION BY room_id, hour ORDER BY ts, event_id)""",
)
def event_change_feed(spark, sf):
    puts = hourly_key(log_of(spark, sf)).select("room_id", "hour", "event_id", "ts", "value", "status")
    feed = state.event_changes(
        puts, ("room_id", "hour"), ("ts", "event_id"), ("event_id", "value", "status"),
        time_chunk(F.col("ts"), 300),
    )
    return feed.select(
        "room_id", "hour", "event_id",
        F.col("old_image.event_id").alias("old_event_id"),
        F.col("old_image.value").alias("old_value"),
        F.col("old_image.status").alias("old_status"),
        F.col("new_image.value").alias("new_value"),
        F.col("new_image.status").alias("new_status"),
        "change",
    )


SPLIT = "2024-01-29 18:00:00"


@query(
    "room_upsert",
    f"""WITH {LOG}, parts AS (SELECT *, ts >= '{SPLIT}' AS late FROM log),
    s AS (SELECT late, room_id, max(ts) AS last_update, count(*) FILTER (WHERE status <> 'normal') AS alert_count_24h
      FROM parts GROUP BY ALL)
    SELECT room_id, last_update, alert_count_24h FROM s WHERE late OR room_id NOT IN (SELECT room_id FROM s WHERE late)""",
)
def room_upsert(spark, sf):
    log = log_of(spark, sf)
    split = like(log, SPLIT)
    current = state.fold_rooms_by_sensor(log.filter(F.col("ts") < split))
    incoming = state.fold_rooms_by_sensor(log.filter(F.col("ts") >= split))
    return records.upsert(current, incoming, "room_id").select("room_id", "last_update", "alert_count_24h")


@query(
    "partial_update",
    f"""WITH {ROOMS}, r AS (SELECT * FROM rooms), p AS (SELECT
      'room-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS room_id,
      n_nationkey + 0.5::DOUBLE AS v, n_regionkey FROM nation)
    SELECT r.room_id, CASE WHEN n_regionkey = 1 THEN v ELSE temperature END AS temperature,
      CASE WHEN n_regionkey <> 1 THEN CAST(trunc(v) AS INTEGER) ELSE occupancy END AS occupancy, humidity,
      CASE WHEN v IS NOT NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_update END AS last_update, status
    FROM r LEFT JOIN p ON r.room_id = p.room_id""",
)
def partial_update(spark, sf):
    rooms, patches = patch_input(spark, sf)
    patched = state.flat_state(records.patch_rooms(rooms, patches))
    return patched.select("room_id", "temperature", "occupancy", "humidity", "last_update", "status")


def patch_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rooms = rooms_of(spark, sf)
    nation = tables.table(spark, sf, "nation")  # 25 of them for 20 rooms
    patches = nation.select(
        F.concat(F.lit("room-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("room_id"),
        F.when(F.col("n_regionkey") == 1, "temperature").otherwise("occupancy").alias("sensor_type"),
        (F.col("n_nationkey") + 0.5).alias("value"),
        F.lit("2024-02-01 00:00:00").cast("timestamp_ntz").alias("at"),
    )
    return rooms, patches


@query(
    "unmatched_patches",
    f"""WITH {ROOMS}, p AS (SELECT 'room-' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS room_id,
      n_nationkey + 0.5::DOUBLE AS value FROM nation)
    SELECT room_id, value FROM p WHERE room_id NOT IN (SELECT room_id FROM rooms)""",
)
def unmatched_patches(spark, sf):
    return records.unmatched_patches(*patch_input(spark, sf)).select("room_id", "value")


@query(
    "event_records",
    f"""WITH {LOG} SELECT room_id, {iso()} AS timestamp, event_id, sensor_type,
    CAST(value AS VARCHAR) AS value, unit, status FROM log""",
)
def event_records(spark, sf):
    return records.event_records(log_of(spark, sf))


@query(
    "room_records",
    f"""WITH {ROOMS} SELECT room_id, name, status, {iso("last_update")} AS last_update,
    CAST(temperature AS VARCHAR) AS temperature, CAST(motion AS VARCHAR) AS motion, CAST(occupancy AS VARCHAR) AS occupancy,
    CAST(humidity AS VARCHAR) AS humidity, alert_count_24h FROM rooms""",
)
def room_records(spark, sf):
    stored = records.room_records(rooms_of(spark, sf))
    return stored.select(
        "room_id", "name", "status", "last_update",
        *[F.try_element_at("current_state", F.lit(s)).alias(s) for s in state.STATE_FIELDS],
        "alert_count_24h",
    )


@query("room_round_trip", f"WITH {ROOMS} SELECT {FLAT_ROOM} FROM rooms")
def room_round_trip(spark, sf):
    back = state.flat_state(records.rooms_from_records(records.room_records(rooms_of(spark, sf))))
    return back.withColumn("last_update", F.col("last_update").cast("timestamp_ntz"))


@query(
    "json_rows",
    f"""WITH {LOG} SELECT '{{"event_id":"' || event_id || '","room_id":"' || room_id || '","value":' ||
    CAST(value AS VARCHAR) || ',"ts":"' || {iso()} || '"}}' AS json FROM log""",
)
def json_rows(spark, sf):
    return records.json_rows(log_of(spark, sf).select("event_id", "room_id", "value", "ts"))


# --- wide readings and alerts ------------------------------------------------------


def hourly_log(spark: SparkSession, sf: str) -> DataFrame:
    log = log_of(spark, sf)
    return log.withColumn("ts", trunc_like(log, "hour", F.col("ts")))


WIDE = f"""{LOG}, wide AS (SELECT room_id, date_trunc('hour', ts)::TIMESTAMP AS ts,
  arg_max(value, event_id) FILTER (WHERE sensor_type = 'temperature') AS temperature,
  arg_max(value, event_id) FILTER (WHERE sensor_type = 'motion') AS motion,
  arg_max(value, event_id) FILTER (WHERE sensor_type = 'occupancy') AS occupancy,
  arg_max(value, event_id) FILTER (WHERE sensor_type = 'humidity') AS humidity FROM log GROUP BY 1, 2)"""


@query(
    "wide_history",
    f"""WITH {WIDE} SELECT * FROM wide WHERE ts BETWEEN '2024-01-03' AND '2024-01-28'
    QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY ts DESC) <= 100""",
)
def wide_history(spark, sf):
    log = hourly_log(spark, sf)
    return reads.wide_history(log, like(log, "2024-01-03 00:00:00"), like(log, "2024-01-28 00:00:00"))


@query(
    "wide_to_long",
    f"""WITH {WIDE} SELECT room_id, ts, sensor_type, value FROM wide
    UNPIVOT (value FOR sensor_type IN (temperature, motion, occupancy, humidity))""",
)
def wide_to_long(spark, sf):
    wide = reads.wide_history(hourly_log(spark, sf), limit=None)
    return alerts.unpivot_wide(wide)


EPISODES = f"""{LOG}, counted AS (SELECT *, count(*) FILTER (WHERE status = 'normal') OVER (PARTITION BY room_id, sensor_type
    ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g, count(*) FILTER (WHERE status = 'normal')
    OVER (PARTITION BY room_id, sensor_type) AS total FROM log),
  runs AS (SELECT room_id, sensor_type, g, total, min(ts) AS ts, max(ts) AS last_seen, count(*) AS readings,
    bool_or(status = 'alert') AS critical FROM counted WHERE status <> 'normal' GROUP BY ALL),
  episodes AS (SELECT room_id || '_' || {EPOCH} || '_' || sensor_type AS alert_id, room_id, sensor_type AS alert_type,
    CASE WHEN critical THEN 'critical' ELSE 'warning' END AS severity, ts AS timestamp, last_seen, readings,
    total > g AS resolved FROM runs)"""


@query("alert_episodes", f"WITH {EPISODES} SELECT * FROM episodes")
def alert_episodes(spark, sf):
    return alerts.alert_episodes(log_of(spark, sf))


@query("active_alerts", f"WITH {EPISODES} SELECT * FROM episodes WHERE NOT resolved")
def active_alerts(spark, sf):
    return alerts.active_alerts(alerts.alert_episodes(log_of(spark, sf)))
