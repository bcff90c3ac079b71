"""Queries over the stored log and typed files: written by date, read back with pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import ingest, records, validate
from sensorloom.plans import query
from sensorloom.plans.rooms import ROOM, log_of
from sensorloom.plans.sql import LOG, READINGS
from sensorloom.session import scratch_path, use_utc
from sensorloom.sources import raw, tables
from sensorloom.sources.log import read_log, write_log

START, END = "2024-01-10T00:00:00Z", "2024-01-20T00:00:00Z"
COLUMNS = ["event_id", "room_id", "sensor_type", "value", "ts", "status"]


def stored(spark: SparkSession, sf: str) -> str:
    """The accepted log of the given events, written by date and sorted by room."""
    path = scratch_path(use_utc(spark), "stored-log")
    write_log(log_of(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), path)
    return path


def plain(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stored_events", f"WITH {LOG} SELECT {', '.join(COLUMNS)} FROM log")
def stored_events(spark, sf):
    return plain(read_log(spark, stored(spark, sf)).select(*COLUMNS))


@query(
    "stored_room_events",
    f"""WITH {LOG} SELECT {", ".join(COLUMNS)} FROM log
    WHERE room_id = '{ROOM}' AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
)
def stored_room_events(spark, sf):
    """One room between two dates: other dates are not listed, other rooms' row groups not read."""
    log = read_log(spark, stored(spark, sf), START, END)
    return plain(log.where(F.col("room_id") == ROOM).select(*COLUMNS))


@query(
    "stored_recent_of_room",
    f"""WITH {LOG} SELECT {", ".join(COLUMNS)} FROM log WHERE room_id = '{ROOM}' AND ts >= TIMESTAMP '2024-01-10'
    ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def stored_recent_of_room(spark, sf):
    log = read_log(spark, stored(spark, sf), START).where(F.col("room_id") == ROOM)
    return plain(log.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select(*COLUMNS))


BATCHES = 4


@query("stored_event_by_id", f"WITH {LOG} SELECT {', '.join(COLUMNS)} FROM log WHERE event_id = (SELECT max(event_id) FROM log)")
def stored_event_by_id(spark, sf):
    """One event of a log that came in batches: of the files of its day only those that may hold the id are opened."""
    path = scratch_path(use_utc(spark), "stored-log")
    log = log_of(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for batch in range(BATCHES):
        write_log(log.where(F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)) == batch), path)
    wanted = log.agg(F.max("event_id")).first()[0]
    return plain(read_log(spark, path).where(F.col("event_id") == wanted).select(*COLUMNS))


@query(
    "stored_last_writes",
    f"""WITH {LOG}, twice AS (SELECT * FROM log UNION ALL SELECT * REPLACE (event_id || '-b' AS event_id, value + 1 AS value) FROM log
      WHERE CAST(event_id AS BIGINT) % 3 = 0)
    SELECT room_id, ts, event_id, value FROM twice QUALIFY row_number() OVER (PARTITION BY room_id, ts ORDER BY event_id DESC) = 1""",
)
def stored_last_writes(spark, sf):
    """Puts are appended to the log; the last put of a key is taken on reading."""
    path = stored(spark, sf)
    log = log_of(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    again = log.where(F.col("event_id").cast("bigint") % 3 == 0)
    write_log(again.withColumns({"event_id": F.concat("event_id", F.lit("-b")), "value": F.col("value") + 1}), path)
    return plain(records.collapse_events(read_log(spark, path)).select("room_id", "ts", "event_id", "value"))


@query(
    "typed_file_rejects",
    f"""WITH {READINGS}, s AS (SELECT CAST(event_id AS BIGINT) % 4 = 2 AS broken, sensor_type = 'pressure' AS unknown FROM readings)
    SELECT 'unprocessable' AS reject_class, 'status:domain' AS reason, count(*) AS n FROM s WHERE broken HAVING count(*) > 0
    UNION ALL SELECT 'unprocessable', 'sensor_type:domain', count(*) FROM s WHERE unknown HAVING count(*) > 0""",
)
def typed_file_rejects(spark, sf):
    """Typed files with a status column, some values of which are none; read with the given schema."""
    path = scratch_path(use_utc(spark), "typed")
    number = F.col("event_id").cast("bigint") % 4
    status = F.when(number == 0, "normal").when(number == 1, "alert").when(number == 2, "broken")
    sent = tables.readings(spark, sf).withColumns({"ts": F.col("ts").cast("timestamp"), "status": status})
    fields = [f.name for f in raw.EVENT_SCHEMA]
    sent.select(*[c if c in sent.columns else F.lit(None).cast("string").alias(c) for c in fields]).write.json(path)
    return ingest.rejects_by_reason(validate.reject(raw.read_events(spark, path, "json")))
