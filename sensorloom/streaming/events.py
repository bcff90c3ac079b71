"""Upserts of events on a stream: the last put per key holds, also after compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom.schema import EVENT_SCHEMA
from sensorloom.streaming.merge import MergeTable, day_of, last_write
from sensorloom.streaming.sinks import each_batch

KEY = ("room_id", "ts")


class EventTable:
    """Events keyed by room and time, one part per day.

    A later batch overwrites an earlier one; inside a batch the last by ``order`` holds. Puts are
    written as they come and folded on reading; compaction leaves one row per key. A reader that
    runs meanwhile keeps the files it started with.
    """

    def __init__(self, spark: SparkSession, path: str, order: Sequence[str] = ("event_id",), key: Sequence[str] = KEY):
        schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("put_no", T.LongType())])
        self.table = MergeTable(spark, path, schema, last_write(key, ("put_no", *order)))

    def put(self, events: DataFrame, batch_id: int) -> None:
        rows = events.select(*EVENT_SCHEMA.names).withColumns({"put_no": F.lit(batch_id).cast("bigint"), "part": day_of(F.col("ts"))})
        self.table.put(self.table.fold(rows), batch_id)

    def take(self, events: DataFrame, batch_id: int) -> None:
        """Put one micro-batch, compacting what lies before it from time to time."""
        self.table.maybe_compact(batch_id)
        self.put(events, batch_id)

    def read(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Last writes; of the days from ``start`` to ``end`` (``yyyy-MM-dd``, both in) only these are listed and read."""
        parts = None
        if start is not None or end is not None:
            known = self.table.parts()
            parts = [p for p in known if (start is None or p >= start) and (end is None or p <= end)]
        return self.table.read(parts=parts).select(*EVENT_SCHEMA.names)

    def compact(self, through: int) -> None:
        self.table.compact(through)


def start_upserts(spark: SparkSession, events: DataFrame, root: str, **trigger) -> StreamingQuery:
    """Keep the event table in ``root/events`` current with a stream of puts."""
    table = EventTable(spark, f"{root}/events")
    return each_batch(events, table.take, f"{root}/checkpoints/events", "append", **trigger)
