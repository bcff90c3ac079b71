"""Keyed tables on plain files: a delta per batch, folded on reading, compacted behind a manifest.

A batch writes only rows of its own keys. Reading folds a base and the deltas after it with an
associative function, so the table is the same however its rows were cut into batches. A batch
that is put again overwrites its own delta, and one that the base already holds is not read:
replays never count twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.streaming.sinks import StateTable

WHOLE = "all"
MANIFEST = "part string, version bigint"


class MergeTable:
    """Rows of ``schema`` that ``fold`` reduces to one per key.

    ``delta/batch=N/part=P`` holds what batch N put, ``base/version=K/part=P`` the fold of all
    deltas up to K, and the manifest (one row per part, a whole version at a time) says which base
    a reader takes for each part. ``part`` is a column of the rows if parts (days, say) are to be
    read and compacted on their own, else there is one part.

    Compaction writes new files and then the next manifest. A reader keeps the files of the
    manifest it started with: they are removed by the compaction after the next one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame], compact_every: int = 16):
        self.spark, self.path, self.schema, self.fold, self.compact_every = spark, path, schema, fold, compact_every
        self.manifest = StateTable(spark, f"{path}/manifest", ["part"])

    def put(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Write the delta of one batch, or of those a column ``batch`` names."""
        if "part" not in rows.columns:
            rows = rows.withColumn("part", F.lit(WHOLE))
        if batch_id is not None:
            rows = rows.withColumn("batch", F.lit(batch_id).cast("bigint"))
        (
            rows.select(*self.schema.names, "batch", "part")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", "part")
            .parquet(f"{self.path}/delta")
        )

    def _files(self, name: str, number: str) -> DataFrame:
        fields = [*self.schema.fields, T.StructField(number, T.LongType()), T.StructField("part", T.StringType())]
        if not self.manifest.exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], T.StructType(fields))
        return self.spark.read.schema(T.StructType(fields)).parquet(f"{self.path}/{name}")

    def versions(self) -> dict[str, int]:
        """The base of each part: the last batch folded into it. One row per part, a day's worth of data each."""
        rows = self.manifest.read()
        return {r.part: r.version for r in rows.collect()} if rows is not None else {}

    def read(self, before: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """The folded rows of all batches, or of those before one; only the given parts are listed and read.

        ``before`` must lie after the last compaction, which leaves out the batch that is being written.
        """
        return self._folded(self.versions(), before, parts)

    def _folded(self, versions: dict[str, int], before: int | None, parts: Sequence[str] | None) -> DataFrame:
        if parts is not None:
            versions = {p: v for p, v in versions.items() if p in set(parts)}
        by_version: dict[int, list[str]] = {}
        for part, version in versions.items():
            by_version.setdefault(version, []).append(part)
        based, held = F.lit(False), F.lit(False)
        for version, names in sorted(by_version.items()):
            based |= (F.col("version") == version) & F.col("part").isin(names)
            held |= (F.col("batch") <= version) & F.col("part").isin(names)
        delta = self._files("delta", "batch").where(~held)
        if before is not None:
            delta = delta.where(F.col("batch") < before)
        if parts is not None:
            delta = delta.where(F.col("part").isin(list(parts)))
        base = self._files("base", "version").where(based)
        return self.fold(base.drop("version").unionByName(delta.drop("batch")))

    def batches(self) -> DataFrame:
        """Numbers of the batches whose deltas are there."""
        return self._files("delta", "batch").select("batch").distinct()

    def parts(self) -> list[str]:
        """Names of all parts, from the folders and the manifest."""
        named = {r.part for r in self._files("delta", "batch").select("part").distinct().collect()}
        return sorted(named | self.versions().keys())

    def compact(self, through: int) -> None:
        """Fold all deltas up to a batch into new bases of the parts they touch."""
        before = self.versions()
        touched = self._files("delta", "batch").where(F.col("batch") <= through).select("part", "batch").distinct()
        parts = sorted({r.part for r in touched.collect() if r.batch > before.get(r.part, -1)})
        if not parts:
            return
        rows = self._folded(before, through + 1, parts)
        (
            rows.select(*self.schema.names, F.lit(through).cast("bigint").alias("version"), "part")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("version", "part")
            .parquet(f"{self.path}/base")
        )
        after = before | dict.fromkeys(parts, through)
        self.manifest.write(self.spark.createDataFrame(sorted(after.items()), MANIFEST).coalesce(1), through)
        self._clean(before, after)

    def _clean(self, before: dict[str, int], after: dict[str, int]) -> None:
        """Remove what neither this manifest nor the one before it needs."""
        kept = {*before.items(), *after.items()}
        folded = max(before.values(), default=-1)
        for batch in self.manifest.numbers(f"{self.path}/delta", "batch="):
            if batch <= folded:
                self.manifest.delete(f"{self.path}/delta/batch={batch}")
        for version in self.manifest.numbers(f"{self.path}/base", "version="):
            if not any(v == version for _, v in kept):
                self.manifest.delete(f"{self.path}/base/version={version}")

    def maybe_compact(self, batch_id: int) -> None:
        """Every ``compact_every`` batches, fold what lies before ``batch_id``; a replay of it still reads its own past."""
        if batch_id - 1 - max(self.versions().values(), default=-1) >= self.compact_every:
            self.compact(batch_id - 1)


def summed(key: Sequence[str], column: str) -> Callable[[DataFrame], DataFrame]:
    """Fold that adds up one column by key."""
    return lambda rows: rows.groupBy("part", *key).agg(F.sum(column).cast("bigint").alias(column))


def last_write(key: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold that keeps the last row of each key."""

    def fold(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*key, "part")]
        last = rows.groupBy("part", *key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        return last.select("part", *key, *[F.col(f"_last.{c}").alias(c) for c in rest])

    return fold


def day_of(ts: Column) -> Column:
    """The UTC day of an instant, as the part of a table that is kept by day."""
    return F.date_format(ts, "yyyy-MM-dd")
