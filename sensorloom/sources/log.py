"""The accepted log: parquet by event date, read with date pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.schema import LOG_SCHEMA

#: For reads of one room or one event in a huge day. Rows lie in order of rooms, so small pages let the page
#: index cut a room out of a file; ids lie in no order, so a Bloom filter tells which row groups to open.
#: Its size follows the number of ids.
POINT_READS = {
    "parquet.page.row.count.limit": "2000",
    "parquet.bloom.filter.enabled#event_id": "true",
    "parquet.bloom.filter.enabled#room_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}


def with_event_date(df: DataFrame) -> DataFrame:
    return df.withColumn("event_date", F.to_date("ts"))


def write_log(events: DataFrame, path: str, mode: str = "append") -> None:
    """Write accepted events by date, sorted so that files can be skipped by room and time.

    Rebalancing by date lets AQE split a busy day over many files and join quiet ones.
    """
    (
        with_event_date(events)
        .hint("rebalance", F.col("event_date"))
        .sortWithinPartitions("event_date", "room_id", "ts")
        .write.mode(mode)
        .options(**POINT_READS)
        .partitionBy("event_date")
        .parquet(path)
    )


def read_log(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Read the log; ``start`` and ``end`` (ISO text, inclusive) prune dates as well as rows.

    Pruning does not follow from a filter on ``ts``, so the date predicate is added here.
    """
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    for text, keep in ((start, "__ge__"), (end, "__le__")):
        if text is not None:
            instant = F.lit(text).cast("timestamp")
            log = log.filter(getattr(F.col("event_date"), keep)(F.to_date(instant)))
            log = log.filter(getattr(F.col("ts"), keep)(instant))
    return log.drop("event_date")
