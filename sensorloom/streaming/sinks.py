"""Sinks for streaming queries: append-only files and a small versioned state table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators.records import upsert
from sensorloom.schema import LOG_FIELDS, LOG_SCHEMA
from sensorloom.session import durable
from sensorloom.sources.log import POINT_READS, with_event_date


class StateTable:
    """One row per key, written as a whole version per micro-batch.

    Batch N reads the version before it and writes ``v=N``, so a replayed batch repeats its
    own result and no plan reads what it overwrites. It fits tables that are small next to
    the events, such as rooms; the events themselves go to an append-only log.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key

    def _folder(self, name: str | None = None):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(name or self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._folder(name)
        return fs.exists(path)

    def delete(self, name: str) -> None:
        fs, path = self._folder(name)
        fs.delete(path, True)

    def numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the folders ``<prefix>N`` in a folder."""
        fs, path = self._folder(folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Numbers of the finished versions."""
        return [v for v in self.numbers(self.path, "v=") if self.exists(f"{self.path}/v={v}/_SUCCESS")]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest one before a batch; None if there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/v={found[-1]}") if found else None

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        # The version before stays for readers that started with it.
        for old in [v for v in self.versions() if v < batch_id][:-1]:
            self.delete(f"{self.path}/v={old}")

    def merge(self, changed: DataFrame, batch_id: int) -> None:
        """Rows of ``changed`` replace those with the same key."""
        current = self.read(before=batch_id)
        if current is None:
            self.write(changed, batch_id)
            return
        # Used twice below; without this the micro-batch would run twice.
        changed = changed.withColumn("_key", F.struct(*self.key)).persist()
        try:
            merged = upsert(current.withColumn("_key", F.struct(*self.key)), changed, "_key")
            self.write(merged.drop("_key"), batch_id)
        finally:
            changed.unpersist()


COMMIT = "total bigint, accepted bigint, rejected bigint, stored bigint, duplicates bigint, first_date date, last_date date, batch bigint"


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows, each once, that ``known`` does not have.

    One grouping by all columns finds copies on both sides, and a null is equal to a null there. A null-safe
    join would make two keys of each column.
    """
    every = rows.withColumn("_known", F.lit(0)).unionByName(known.select(*rows.columns).withColumn("_known", F.lit(1)))
    return every.groupBy(*rows.columns).agg(F.max("_known").alias("_known")).where("_known = 0").drop("_known")


class LogTable:
    """The accepted log as micro-batches write it: ``event_date=D/batch=N``, every reading once.

    A reading is a copy of another if all its fields are equal; a sender that uses an id again for
    another reading sent two. That rule does not depend on how rows fall into batches.
    Readings of any age are taken. A batch is compared with stored readings of its own dates and
    time span only (a copy carries the time of what it repeats), so on-time batches read the
    newest files and late ones just the days they reach back to.

    A replayed batch overwrites its own partitions, and then its commit: one row in ``<path>_commits/batch=N`` with
    its counts and dates, written last. Readers downstream go by the numbers of committed batches,
    never by file names, so what is replayed is the same batch to them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.commits = f"{path}_commits"

    def create(self) -> None:
        """The folders have to exist before they are read, the commits as a stream."""
        empty = self.spark.createDataFrame([], LOG_SCHEMA).withColumn("batch", F.lit(0).cast("bigint"))
        empty.write.mode("append").partitionBy("event_date", "batch").parquet(self.path)
        self.spark.createDataFrame([], COMMIT).write.mode("append").partitionBy("batch").parquet(self.commits)

    def _stored(self) -> DataFrame:
        schema = T.StructType([*LOG_SCHEMA.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def append(self, accepted: DataFrame, batch_id: int, seen: Observation | None = None) -> int:
        """Store the readings that are new, then commit the batch; their number.

        ``accepted`` is evaluated once. ``seen`` is an observation below it with the number ``n`` of all rows the
        batch brought, without it only accepted ones are counted. (A task that is run again after a
        lost executor may be observed twice; what is stored is counted from the files.)
        """
        taken = Observation()
        rows = accepted.select(*LOG_FIELDS).observe(taken, F.count(F.lit(1)).alias("n"))
        rows = with_event_date(rows).persist()
        try:
            low, high, first, last, n = rows.agg(
                F.min("ts"), F.max("ts"), F.min("event_date"), F.max("event_date"), F.count("*")
            ).first()
            if n:
                stored = self._stored().where(F.col("event_date").between(first, last) & F.col("ts").between(low, high))
                (
                    unknown(rows, stored.where(F.col("batch") != batch_id))
                    .withColumn("batch", F.lit(batch_id).cast("bigint"))
                    .hint("rebalance", F.col("event_date"))
                    .sortWithinPartitions("event_date", "room_id", "ts")
                    .write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .options(**POINT_READS)
                    .partitionBy("event_date", "batch")
                    .parquet(self.path)
                )
        finally:
            rows.unpersist()
        here = F.col("event_date").between(first, last) & (F.col("batch") == batch_id)
        count = self._stored().where(here).count() if n else 0
        total, kept = (seen or taken).get["n"], taken.get["n"]
        row = [(total, kept, total - kept, count, kept - count, first, last, batch_id)]
        commit = self.spark.createDataFrame(row, COMMIT).coalesce(1)
        commit.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.commits)
        return count

    def stats(self) -> DataFrame:
        """Counts of the committed batches: total = stored + rejected + duplicates in each."""
        return self.spark.read.schema(COMMIT).parquet(self.commits)

    def commit_stream(self) -> DataFrame:
        """The commits as a stream, for queries downstream of the log."""
        return self.spark.readStream.schema(COMMIT).parquet(self.commits)

    def read_batches(self, commits: list[Row]) -> DataFrame:
        """The log's rows of some committed batches, with their ``batch``; other dates and batches are not listed."""
        dated = [c for c in commits if c.first_date is not None]
        if not dated:
            return self._stored().limit(0)
        dates = F.col("event_date").between(min(c.first_date for c in dated), max(c.last_date for c in dated))
        return self._stored().where(dates & F.col("batch").isin([c.batch for c in dated]))

    def compact(self, date: str) -> None:
        """Rewrite a closed day's many small files as few, sorted by room and time, as batch -1.

        For days that no running stream appends to any more and no stream has yet to read.
        """
        day = F.lit(date).cast("date")
        rows = durable(self._stored().where(F.col("event_date") == day)).withColumn("batch", F.lit(-1).cast("bigint"))
        ordered = rows.drop("event_date").hint("rebalance").sortWithinPartitions("room_id", "ts")
        ordered.write.mode("overwrite").options(**POINT_READS).partitionBy("batch").parquet(f"{self.path}/event_date={date}")


def append_log(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append to parquet by event date; the file sink's own log makes it exactly-once."""
    return (
        with_event_date(stream)
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .options(**POINT_READS)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def append_rows(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str, **trigger
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
