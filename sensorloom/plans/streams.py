"""Streaming queries, run to the end of the given tables and read back."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import state
from sensorloom.operators.classify import classify
from sensorloom.operators.enrich import enrich
from sensorloom.operators.ingest import rejects_by_reason
from sensorloom.operators.validate import accept
from sensorloom.plans import ORACLES, query, rooms
from sensorloom.plans.devices import ADMIT, MESSAGES
from sensorloom.plans.rooms import FLAT_ROOM
from sensorloom.plans.sql import EPOCH, LOG, REGISTRY, ROOMS
from sensorloom.session import scratch_path, ship_package, use_utc
from sensorloom.sources import tables
from sensorloom.sources.log import read_log
from sensorloom.streaming import admission, ingest, sinks, timers
from sensorloom.streaming import events as upserts

ONCE = {"availableNow": True}


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    schema = tables.table(spark, sf, "events").schema
    return use_utc(spark).readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def reading_stream(spark: SparkSession, sf: str) -> DataFrame:
    return tables.as_readings(event_stream(spark, sf))


def naive(df: DataFrame) -> DataFrame:
    """Instants without a zone, as the given tables have them."""
    stamps = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in stamps})


@contextmanager
def one_state_store_per_core(spark: SparkSession):
    """The number of state stores is fixed when a stream first starts; one per core is enough."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drained(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    root = scratch_path(spark, name)
    with one_state_store_per_core(spark):
        sinks.append_rows(stream, f"{root}/rows", f"{root}/checkpoint", **ONCE).awaitTermination()
    return naive(spark.read.schema(stream.schema).parquet(f"{root}/rows"))


@query("stream_room_state", f"WITH {ROOMS} SELECT {FLAT_ROOM} FROM rooms")
def stream_room_state(spark, sf):
    """Ingest to the log, then rooms from the log: two queries with their own checkpoints."""
    root = scratch_path(spark, "rooms")
    with one_state_store_per_core(spark):
        ingest.ingest_log(spark, reading_stream(spark, sf), f"{root}/log", f"{root}/checkpoints/log", **ONCE).awaitTermination()
        ingest.start_rooms(spark, root, **ONCE).awaitTermination()
    table = sinks.StateTable(spark, f"{root}/rooms", ["room_id"])
    return naive(state.flat_state(table.read()))


def accepted(rows: DataFrame) -> DataFrame:
    return classify(enrich(ingest.split_readings(rows)[0]))


def numbered(rows: DataFrame, batches: int):
    """The rows cut into batches by the checksum of their ids."""
    number = F.crc32(F.col("event_id").cast("binary")) % batches
    return [(i, rows.where(number == i)) for i in range(batches)]


@query("stream_replayed_rooms", ORACLES["stream_room_state"])
def stream_replayed_rooms(spark, sf):
    """Batches reach the log, rooms follow, and then batches are written again, as after a crash before the commit."""
    root = scratch_path(use_utc(spark), "replayed")
    log = sinks.LogTable(spark, f"{root}/log")
    log.create()
    batches = numbered(tables.readings(spark, sf), 3)
    with one_state_store_per_core(spark):
        for i, rows in batches:
            log.append(accepted(rows), i)
            if i:
                ingest.start_rooms(spark, root, **ONCE).awaitTermination()
                log.append(accepted(rows), i)
        ingest.start_rooms(spark, root, **ONCE).awaitTermination()
    return naive(state.flat_state(sinks.StateTable(spark, f"{root}/rooms", ["room_id"]).read()))


@query(
    "stream_counts",
    f"""WITH {LOG}, t AS (SELECT (SELECT count(*) FROM readings) AS n, (SELECT count(*) FROM log) AS a,
      (SELECT count(*) FROM readings WHERE CAST(event_id AS BIGINT) % 5 = 0) AS n2,
      (SELECT count(*) FROM log WHERE CAST(event_id AS BIGINT) % 5 = 0) AS a2)
    SELECT n + n2 AS total, a + a2 AS accepted, n + n2 - a - a2 AS rejected, a AS stored, a2 AS duplicates FROM t""",
)
def stream_counts(spark, sf):
    """What each batch brought, kept and refused, as it was observed on the way; every fifth reading comes twice."""
    root = scratch_path(use_utc(spark), "counts")
    log = sinks.LogTable(spark, f"{root}/log")
    once = tables.as_readings(spread(tables.table(spark, sf, "events")))
    twice = F.when(F.col("event_id").cast("bigint") % 5 == 0, 1).otherwise(0)
    sent = once.withColumn("_copy", F.explode(F.sequence(F.lit(0), twice))).drop("_copy")
    for source in by_arrival(spark, sent, F.pmod(F.hash("event_id", "value"), F.lit(4)), "counted"):
        ingest.ingest_log(spark, source, f"{root}/log", f"{root}/checkpoint", **ONCE).awaitTermination()
    columns = ("total", "accepted", "rejected", "stored", "duplicates")
    return log.stats().agg(*[F.sum(c).cast("bigint").alias(c) for c in columns])


BATCHINGS = (1, 3, 6)


@query(
    "stream_batchings",
    f"""WITH {LOG}, twice AS (SELECT event_id, room_id, sensor_type, value, ts, status FROM log
      UNION ALL SELECT event_id, room_id, sensor_type, value, ts + INTERVAL 3 HOUR, status FROM log WHERE CAST(event_id AS BIGINT) % 11 = 0)
    SELECT b.batches, t.* FROM twice t, (VALUES {", ".join(f"({n})" for n in BATCHINGS)}) b(batches)""",
)
def stream_batchings(spark, sf):
    """The same readings in one, three and six batches: some come twice, some ids are used again three hours later."""
    once = tables.readings(use_utc(spark), sf)
    number = F.col("event_id").cast("bigint")
    again = once.where(number % 11 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3 HOURS"))
    sent = once.withColumn("_copy", F.lit(0)).unionByName(again.withColumn("_copy", F.lit(1))).unionByName(once.where(number % 4 == 1).withColumn("_copy", F.lit(2)))
    out = None
    for batches in BATCHINGS:
        log = sinks.LogTable(spark, scratch_path(spark, f"batching-{batches}") + "/log")
        log.create()
        place = F.pmod(F.xxhash64("event_id", "_copy"), F.lit(batches))
        for i in range(batches):
            log.append(accepted(sent.where(place == i).drop("_copy")), i)
        rows = read_log(spark, log.path).select(F.lit(batches).alias("batches"), "event_id", "room_id", "sensor_type", "value", "ts", "status")
        out = rows if out is None else out.unionByName(rows)
    return naive(out)


@query(
    "stream_last_writes",
    f"""WITH {LOG}, puts AS (SELECT event_id, room_id, sensor_type, value + b AS value, date_trunc('hour', ts)::TIMESTAMP AS ts, b FROM log,
      (VALUES (0), (1), (2), (3)) t(b) WHERE b = CAST(event_id AS BIGINT) % 3 OR (b = 3 AND CAST(event_id AS BIGINT) % 7 = 0))
    SELECT room_id, ts, event_id, sensor_type, value FROM puts
    QUALIFY row_number() OVER (PARTITION BY room_id, ts ORDER BY b DESC, event_id DESC) = 1""",
)
def stream_last_writes(spark, sf):
    """Puts in four batches with a compaction between them; one batch is put twice."""
    log = accepted(tables.readings(use_utc(spark), sf)).withColumn("ts", F.date_trunc("hour", "ts"))
    number = F.col("event_id").cast("bigint")
    table = upserts.EventTable(spark, scratch_path(spark, "upserts"))
    for batch in (0, 1, 1, 2, 3):
        if batch == 2:
            table.compact(1)
        chosen = number % 7 == 0 if batch == 3 else number % 3 == batch
        table.put(log.where(chosen).withColumn("value", F.col("value") + batch), batch)
    return naive(table.read().select("room_id", "ts", "event_id", "sensor_type", "value"))


@query(
    "stream_dedup",
    f"""WITH {LOG} SELECT room_id || '_' || {EPOCH} || '_' || sensor_type AS event_id, room_id, sensor_type, value, ts
    FROM log""",
)
def stream_dedup(spark, sf):
    """Each reading arrives one to three times without an id."""
    copies = F.sequence(F.lit(0), (F.col("event_id").cast("bigint") % 3).cast("int"))
    sent = reading_stream(spark, sf).withColumn("_copy", F.explode(copies))
    sent = sent.withColumn("event_id", F.lit(None).cast("string")).drop("_copy")
    root = scratch_path(spark, "dedup")
    ingest.ingest_log(spark, sent, f"{root}/log", f"{root}/checkpoint", **ONCE).awaitTermination()
    return naive(read_log(spark, f"{root}/log").select("event_id", "room_id", "sensor_type", "value", "ts"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores, however few files and row groups they come from."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def by_arrival(spark, rows: DataFrame, number, name: str, batches: int = 4) -> Iterator[DataFrame]:
    """The rows as a stream of several batches, by their ``number`` from 0.

    The stream is handed out once for each batch, when its files have come; a query that is then run to the
    end and keeps its checkpoint takes them as one batch. ``rows`` are computed once, and each batch has as many files as ``rows`` have tasks.
    """
    root = scratch_path(spark, name)
    dealt = T.StructType([*rows.schema.fields, T.StructField("_batch", T.IntegerType())])
    rows.withColumn("_batch", number).write.partitionBy("_batch").parquet(f"{root}/all")
    for i in range(batches):
        part = spark.read.schema(dealt).parquet(f"{root}/all").where(F.col("_batch") == i).drop("_batch")
        part.write.mode("append").parquet(f"{root}/come")
        yield spark.readStream.schema(rows.schema).parquet(f"{root}/come")


def run_of_times(rows: DataFrame, arrival, batches: int = 4):
    """Number of the equal span of arrival times that a row falls into, oldest first."""
    low, high = rows.agg(F.min(arrival), F.max(arrival)).first()
    width = (high - low) / batches
    number = F.lit(0)
    for i in range(1, batches):
        number = F.when(arrival >= F.lit(low + i * width), i).otherwise(number)
    return number


def arrivals(events: DataFrame) -> DataFrame:
    """Readings with an ``_arrival``, from one scan: a row for each time a reading is delivered."""
    number = F.col("event_id").cast("bigint")
    late = F.col("ts") + F.when(number % 7 == 0, F.expr("INTERVAL 72 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    again = F.col("ts") + F.expr("INTERVAL 100 HOURS")
    return tables.as_readings(events).withColumn("_arrival", F.explode(F.when(number % 5 == 0, F.array(late, again)).otherwise(F.array(late))))


@query(
    "stream_late_readings",
    f"""WITH {LOG} SELECT event_id, room_id, sensor_type, value, ts, status FROM log""",
)
def stream_late_readings(spark, sf):
    """Four batches; every seventh reading arrives three days late, every fifth is delivered twice, the second time late."""
    given = tables.table(spark, sf, "events")
    root = scratch_path(spark, "late-log")
    for source in by_arrival(spark, arrivals(spread(given)), run_of_times(arrivals(given), F.col("_arrival")), "late"):
        ingest.ingest_log(spark, source.drop("_arrival"), f"{root}/log", f"{root}/checkpoint", **ONCE).awaitTermination()
    return naive(read_log(spark, f"{root}/log").select("event_id", "room_id", "sensor_type", "value", "ts", "status"))


def body_stream(spark, sf) -> Iterator[DataFrame]:
    """The damaged bodies of ``parsed_bodies`` as a stream of four batches."""
    rows = rooms.as_bodies(tables.as_readings(spread(tables.table(spark, sf, "events"))))
    return by_arrival(spark, rows, (F.crc32(F.coalesce("body", F.lit("")).cast("binary")) % 4).cast("int"), "bodies")


@query("stream_bodies", ORACLES["parsed_bodies"])
def stream_bodies(spark, sf):
    root = scratch_path(spark, "body-log")
    for source in body_stream(use_utc(spark), sf):
        ingest.ingest_log(spark, source, f"{root}/log", f"{root}/checkpoint", ingest.split_bodies, **ONCE).awaitTermination()
    return naive(read_log(spark, f"{root}/log")).select(*rooms.LOG_COLUMNS)


@query("stream_body_rejects", ORACLES["parsed_rejects"])
def stream_body_rejects(spark, sf):
    root = scratch_path(spark, "body-rejects")
    for source in body_stream(use_utc(spark), sf):
        rejected = ingest.split_bodies(source)[1].select("reject_class", "reject_reasons")
        sinks.append_rows(rejected, f"{root}/rows", f"{root}/checkpoint", **ONCE).awaitTermination()
    return rejects_by_reason(spark.read.schema(rejected.schema).parquet(f"{root}/rows"))


CLOCK = "~clock"


def with_clock(spark, stream: DataFrame, rows: DataFrame, key: str, hours: int) -> DataFrame:
    """``stream`` and one more row of a source of its own, ``hours`` after the newest of ``rows``.

    A stream closes what lies before its watermark. Over a finite table that clock row, as a live source's
    next rows would, brings the watermark past everything the table holds. Its own results are left out by ``key``.
    """
    path = scratch_path(spark, "clock")
    last = F.max("ts") + F.expr(f"INTERVAL {hours} HOURS")
    name = F.lit(CLOCK if rows.schema[key].dataType.typeName() == "string" else -1).cast(rows.schema[key].dataType)
    others = [F.first(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in ("ts", key)]
    rows.agg(last.cast(rows.schema["ts"].dataType).alias("ts"), name.alias(key), *others).select(*rows.columns).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(rows.schema).parquet(path))


def clocked_log(spark, sf, hours: int) -> DataFrame:
    normal = tables.readings(spark, sf).where((F.col("sensor_type") == "motion") & (F.col("value") == 0))
    return classify(enrich(accept(with_clock(spark, reading_stream(spark, sf), normal, "room_id", hours))))


@query(
    "stream_rolling_alerts",
    f"""WITH {LOG},
    m AS (SELECT room_id, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE AS e, count(*) AS n FROM log
      WHERE status <> 'normal' GROUP BY ALL),
    steps AS (SELECT room_id, e, n FROM m UNION ALL SELECT room_id, e + INTERVAL 24 HOUR, -n FROM m),
    s AS (SELECT room_id, e, sum(n) AS n FROM steps GROUP BY ALL)
    SELECT room_id, e AS "at", CAST(sum(n) OVER (PARTITION BY room_id ORDER BY e) AS BIGINT) AS anomalies_in_span FROM s""",
)
def stream_rolling_alerts(spark, sf):
    with timers.rocksdb(spark):
        return drained(timers.rolling_counts(ingest.timed(clocked_log(spark, sf, 26))), "rolling").where(F.col("room_id") != CLOCK)


SILENT = 6 * 3600


@query(
    "stream_silent_rooms",
    f"""WITH {LOG},
    m AS (SELECT DISTINCT room_id, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE AS e FROM log),
    g AS (SELECT *, lead(e) OVER (PARTITION BY room_id ORDER BY e) AS nxt FROM m)
    SELECT room_id, 'offline' AS status, e + INTERVAL {SILENT} SECOND AS at FROM g
      WHERE nxt - e > INTERVAL {SILENT} SECOND OR nxt IS NULL
    UNION ALL SELECT room_id, 'active', nxt FROM g WHERE nxt - e > INTERVAL {SILENT} SECOND""",
)
def stream_silent_rooms(spark, sf):
    with timers.rocksdb(spark):
        found = timers.silent_rooms(ingest.timed(clocked_log(spark, sf, SILENT // 3600 + 2)), SILENT)
        return drained(found, "silent").where(F.col("room_id") != CLOCK)


def message_stream(spark, sf):
    return tables.as_messages(event_stream(spark, sf)).select("message_id", "device_id", "ts")


STREAM_TIERS = {"free": 1, "standard": 3}


@query(
    "stream_rate_limit",
    f"""WITH {REGISTRY}, {MESSAGES}, c AS (SELECT device_id,
      date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS request_count FROM messages GROUP BY ALL),
    l AS (SELECT c.*, CAST(CASE tier WHEN 'free' THEN {STREAM_TIERS["free"]} WHEN 'standard' THEN {STREAM_TIERS["standard"]} END AS BIGINT) AS "limit"
      FROM c LEFT JOIN registry r ON c.device_id = r.device_id)
    SELECT *, CAST(greatest("limit" - request_count, 0) AS BIGINT) AS remaining, coalesce(request_count > "limit", false) AS exceeded FROM l""",
)
def stream_rate_limit(spark, sf):
    """Small limits, so that some hours exceed them."""
    registry = tables.device_registry(spark, sf)
    messages = tables.as_messages(tables.table(spark, sf, "events")).select("message_id", "device_id", "ts")
    sent = with_clock(spark, message_stream(spark, sf), messages, "device_id", 3)
    return drained(ingest.closed_hours(sent, registry, tiers=STREAM_TIERS), "limits").where("device_id <> -1")


@query(
    "stream_admission",
    f"""WITH {MESSAGES} SELECT message_id, device_id, ts, row_number() OVER (PARTITION BY device_id, date_trunc('hour', ts)
    ORDER BY ts, message_id) AS number, row_number() OVER (PARTITION BY device_id, date_trunc('hour', ts)
    ORDER BY ts, message_id) <= {ADMIT} AS admitted FROM messages""",
)
def stream_admission(spark, sf):
    root = scratch_path(spark, "admission")
    admission.start_admission(spark, message_stream(spark, sf), root, ADMIT, **ONCE).awaitTermination()
    return spark.read.parquet(f"{root}/decisions").drop("batch", "window_no")


TIER_LIMITS = {"free": 1, "standard": 2}


@query(
    "stream_admission_by_tier",
    f"""WITH {REGISTRY}, {MESSAGES}, m AS (SELECT m.message_id, m.device_id, m.ts, tier, row_number() OVER (PARTITION BY m.device_id,
      date_trunc('hour', m.ts) ORDER BY m.ts, message_id) AS number FROM messages m LEFT JOIN registry r ON m.device_id = r.device_id)
    SELECT message_id, device_id, ts, number, coalesce(number <= CASE tier WHEN 'free' THEN {TIER_LIMITS["free"]}
      WHEN 'standard' THEN {TIER_LIMITS["standard"]} END, true) AS admitted FROM m""",
)
def stream_admission_by_tier(spark, sf):
    """Four batches in order of time, the limit taken from each device's tier."""
    tier = F.col("tier")
    limits = tables.device_registry(spark, sf).select(
        "device_id", F.when(tier == "free", TIER_LIMITS["free"]).when(tier == "standard", TIER_LIMITS["standard"]).alias("limit")
    )
    messages = tables.as_messages(spread(tables.table(use_utc(spark), sf, "events"))).select("message_id", "device_id", "ts")
    root = scratch_path(spark, "tier-admission")
    for source in by_arrival(spark, messages, run_of_times(messages, F.col("ts")), "messages"):
        admission.start_admission(spark, source, root, limits, **ONCE).awaitTermination()
    return spark.read.parquet(f"{root}/decisions").drop("batch", "window_no")


@query(
    "stream_admission_shuffled",
    f"""WITH {MESSAGES}, m AS (SELECT message_id, device_id, ts, row_number() OVER (PARTITION BY device_id, date_trunc('hour', ts)
      ORDER BY CAST(message_id AS BIGINT) % 3, ts, message_id) AS number FROM messages)
    SELECT message_id, device_id, ts, number, number <= {ADMIT} AS admitted FROM m""",
)
def stream_admission_shuffled(spark, sf):
    """Batches that each reach every hour: a message is counted when it comes, whatever time it carries."""
    messages = tables.as_messages(spread(tables.table(use_utc(spark), sf, "events"))).select("message_id", "device_id", "ts")
    root = scratch_path(spark, "shuffled-admission")
    for source in by_arrival(spark, messages, (F.col("message_id").cast("bigint") % 3).cast("int"), "shuffled", 3):
        admission.start_admission(spark, source, root, ADMIT, **ONCE).awaitTermination()
    return spark.read.parquet(f"{root}/decisions").drop("batch", "window_no")
