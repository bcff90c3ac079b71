"""Admit or deny messages as they arrive, with counters that survive a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom.functions.times import time_chunk
from sensorloom.operators.devices import HOUR, admission
from sensorloom.streaming.merge import MergeTable, day_of, summed
from sensorloom.streaming.sinks import each_batch

KEY = ["device_id", "window_no"]


def counters(spark: SparkSession, path: str, id_type: T.DataType) -> MergeTable:
    """Messages per device and window, one part per day.

    A batch writes the counts of its own devices and windows only, and reads the days its own
    messages reach. Nothing is evicted by the time of other messages: a wrong clock touches its
    own day, and a late message finds its counter.
    """
    fields = [("device_id", id_type), ("window_no", T.LongType()), ("used", T.LongType())]
    return MergeTable(spark, path, T.StructType([T.StructField(n, t) for n, t in fields]), summed(KEY, "used"))


def start_admission(
    spark: SparkSession, messages: DataFrame, root: str, limit: int | DataFrame, window_seconds: int = HOUR, **trigger
) -> StreamingQuery:
    """Write decisions to ``root/decisions/batch=N`` and counters to ``root/counters``.

    ``limit`` is one number, or a frame of ``device_id`` and ``limit`` as tiers give it; a device
    that it does not name, or names with null, has no limit. Inside a micro-batch messages
    are numbered like in batch, in slices, so one flooding device does not end up in one task.
    The batch is read once. A replayed batch overwrites its own output and its own counts.
    """
    table = counters(spark, f"{root}/counters", messages.schema["device_id"].dataType)

    def decide(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            limits = F.lit(limit) if isinstance(limit, int) else F.col("_limit")
            rows = batch if isinstance(limit, int) else batch.join(limit.select("device_id", F.col("limit").alias("_limit")), "device_id", "left")
            rows = admission(rows, limits, window_seconds).withColumn("window_no", time_chunk(F.col("ts"), window_seconds).cast("long"))
            part = day_of(F.timestamp_seconds(F.col("window_no") * window_seconds))
            days = [r[0] for r in batch.select(time_chunk(F.col("ts"), window_seconds).cast("long").alias("window_no")).select(part).distinct().collect()]
            if not days:
                return
            table.maybe_compact(batch_id)
            used = table.read(before=batch_id, parts=days).select(*KEY, F.col("used").alias("_used"))
            rows = rows.join(used, KEY, "left").withColumn("number", F.col("number") + F.coalesce("_used", F.lit(0).cast("bigint")))
            rows = rows.withColumn("admitted", F.coalesce(F.col("number") <= limits, F.lit(True))).drop("_limit", "_used")
            decided = f"{root}/decisions/batch={batch_id}"
            rows.write.mode("overwrite").parquet(decided)
            # The counts follow from what was written, not from a second run of the batch.
            written = spark.read.schema(rows.schema).parquet(decided)
            table.put(written.groupBy(*KEY, part.alias("part")).agg(F.count("*").alias("used")), batch_id)
        finally:
            batch.unpersist()

    return each_batch(messages, decide, f"{root}/checkpoints/admission", "append", **trigger)
