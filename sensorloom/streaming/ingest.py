"""Ingest and state as separate streaming queries over one accepted log."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators import partials
from sensorloom.operators.classify import classify
from sensorloom.operators.devices import hourly_usage
from sensorloom.operators.enrich import enrich
from sensorloom.operators.validate import accept, any_problem, check_parsed, event_problems, reject
from sensorloom.schema import HOURLY_TIERS, LOG_SCHEMA
from sensorloom.sources.raw import parse_bodies
from sensorloom.streaming.merge import MergeTable
from sensorloom.streaming.sinks import LogTable, StateTable, append_rows, each_batch

LATENESS = "1 hour"


def timed(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Event time as TIMESTAMP with a watermark, which streams need."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def observed(readings: DataFrame, name: str = "ingest") -> DataFrame:
    """Count accepted and rejected readings on the way; see ``observedMetrics`` of the progress."""
    bad = any_problem(event_problems())
    return readings.observe(
        name, F.count("*").alias("total"), F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected")
    )


Split = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def split_readings(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of typed readings."""
    readings = readings.withColumn("ts", F.col("ts").cast("timestamp"))
    return accept(readings), reject(readings)


def split_bodies(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of raw JSON bodies (column ``body``)."""
    return check_parsed(parse_bodies(bodies))


def ingest_log(spark: SparkSession, source: DataFrame, path: str, checkpoint: str, split: Split = split_readings, **trigger) -> StreamingQuery:
    """Append every accepted reading to the log once, however late it comes.

    Per batch, total = stored + rejected + duplicates (see ``LogTable.stats``); these are observed on the
    way, not counted by jobs of their own. Nothing is held in a state store and no watermark
    drops a row: a gateway that was away for a day delivers its readings like any other. The
    source is read once a batch.
    """
    table = LogTable(spark, path)
    table.create()

    def work(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("n"))
        table.append(classify(enrich(split(counted)[0])), batch_id, seen)

    return each_batch(source, work, checkpoint, "append", **trigger)


class RoomTable:
    """Room state from committed batches of the log: one partial fold per batch, and the rooms they add up to.

    Partials are kept by the number of the log's batch (``<path>_parts``), so a batch that is replayed
    into the log, or into this table, replaces its own. ``<path>`` is the table to read, one version per micro-batch.
    """

    def __init__(self, spark: SparkSession, path: str, log: LogTable):
        self.log = log
        schema = partials.room_parts(spark.createDataFrame([], LOG_SCHEMA)).schema
        self.parts = MergeTable(spark, f"{path}_parts", schema, partials.merge_room_parts)
        self.rooms = StateTable(spark, path, ["room_id"])

    def take(self, commits: DataFrame, batch_id: int) -> None:
        new = commits.where("stored > 0").collect()  # one row per batch of the log
        if not new:
            return
        self.parts.put(partials.room_parts(self.log.read_batches(new), keys=("room_id", "batch")))
        changed = self.log.read_batches(new).select("room_id").distinct()
        merged = self.parts.read().join(changed, "room_id", "left_semi")
        self.rooms.merge(partials.rooms_of_parts(merged), batch_id)
        self._compact()

    def _compact(self) -> None:
        """Fold what lies before the first committed batch that is still to come (commits may be listed out of order)."""
        through = max(self.parts.versions().values(), default=-1)
        committed = self.log.stats().where((F.col("batch") > through) & (F.col("stored") > 0)).select("batch")
        missing = committed.join(self.parts.batches(), "batch", "left_anti").agg(F.min("batch")).first()[0]
        end = committed.agg(F.max("batch")).first()[0] if missing is None else missing - 1
        if end is not None and end - through >= self.parts.compact_every:
            self.parts.compact(end)


def closed_hours(
    messages: DataFrame, registry: DataFrame, lateness: str = LATENESS, tiers: Mapping[str, int] = HOURLY_TIERS
) -> DataFrame:
    """Rate-limit counters of hours that can no longer change."""
    return hourly_usage(timed(messages, lateness), registry, tiers)


@dataclass
class Running:
    log: StreamingQuery
    rejects: StreamingQuery
    rooms: StreamingQuery

    def all(self) -> list[StreamingQuery]:
        return [self.log, self.rejects, self.rooms]


def start(spark: SparkSession, readings: DataFrame, root: str, split: Split = split_readings, **trigger) -> Running:
    """Start ingest, rejects and room state from typed readings, or from raw bodies with ``split_bodies``.

    Each query has its own checkpoint: if the room query fails, events are still accepted,
    and the room query catches up from the log when it is started again.
    """
    log = ingest_log(spark, readings, f"{root}/log", f"{root}/checkpoints/log", split, **trigger)
    rejects = append_rows(split(readings)[1], f"{root}/rejects", f"{root}/checkpoints/rejects", **trigger)
    return Running(log, rejects, start_rooms(spark, root, **trigger))


def start_rooms(spark: SparkSession, root: str, **trigger) -> StreamingQuery:
    """Keep the room table in ``root/rooms`` current with the log in ``root/log``."""
    log = LogTable(spark, f"{root}/log")
    table = RoomTable(spark, f"{root}/rooms", log)
    return each_batch(log.commit_stream(), table.take, f"{root}/checkpoints/rooms", "append", **trigger)
