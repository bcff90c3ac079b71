"""Partial results that add up in any order: room state (A33, A34) and baselines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.state import ORDER, STATE_FIELDS, is_anomaly, room_name
from sensorloom.schema import DEFAULT_ROOM_STATUS


def room_parts(log: DataFrame, order: Sequence[str] = ORDER, keys: Sequence[str] = ("room_id",)) -> DataFrame:
    """What some rows of the log say about their rooms: newest reading per sensor, newest anomaly, counts."""
    at = F.struct(*order)
    heads = [F.max(F.when(F.col("sensor_type") == s, F.struct(at.alias("at"), "value"))).alias(s) for s in STATE_FIELDS]
    return log.groupBy(*keys).agg(
        *heads,
        F.max(F.when(is_anomaly(), F.struct(at.alias("at"), "status"))).alias("bad"),
        F.max(at).alias("at"),
        F.count_if(is_anomaly()).alias("n_bad"),
    )


def merge_room_parts(parts: DataFrame, keys: Sequence[str] = ("part", "room_id")) -> DataFrame:
    """One row per room from parts of disjoint rows."""
    newest = [F.max(c).alias(c) for c in (*STATE_FIELDS, "bad", "at")]
    return parts.groupBy(*keys).agg(*newest, F.sum("n_bad").alias("n_bad"))


def rooms_of_parts(merged: DataFrame) -> DataFrame:
    """The rooms that merged parts describe, as ``state.fold_rooms`` gives them."""
    state = [typed(F.col(f"{s}.value")).alias(s) for s, typed in STATE_FIELDS.items()]
    return merged.select(
        "room_id",
        room_name(F.col("room_id")).alias("name"),
        F.coalesce("bad.status", F.lit(DEFAULT_ROOM_STATUS)).alias("status"),
        F.col("at.ts").alias("last_update"),
        F.struct(*state).alias("current_state"),
        F.col("n_bad").alias("alert_count_24h"),
    )


def moments(readings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean and sum of squared deviations by group."""
    return readings.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count("value")).alias("m2")
    ).where("n > 0")


def merge_moments(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Fold of moments of disjoint rows, without the cancellation of sums of squares.

    A group has one row per delta since the last compaction; these few are put in order and added up.
    """

    def add(total: Column, part: Column) -> Column:
        n = total["n"] + part["n"]
        gap = part["mean"] - total["mean"]
        return F.struct(
            n.alias("n"),
            (total["mean"] + gap * part["n"] / n).alias("mean"),
            (total["m2"] + part["m2"] + gap * gap * total["n"] * part["n"] / n).alias("m2"),
        )

    def fold(parts: DataFrame) -> DataFrame:
        listed = parts.groupBy("part", *keys).agg(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))).alias("_parts"))
        nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
        return listed.select("part", *keys, F.aggregate("_parts", nothing, add).alias("_sum")).select("part", *keys, "_sum.*")

    return fold


def baselines_of_moments(merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Baselines as ``behavior.baselines`` gives them; the deviation of a single reading is null."""
    sd = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select(*keys, "mean", sd.alias("sd"), "n")
