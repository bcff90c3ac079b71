"""From readings to the accepted log, acknowledgements and ingest counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.classify import classify
from sensorloom.operators.enrich import enrich
from sensorloom.operators.validate import any_problem, accept, event_problems
from sensorloom.schema import DEFAULT_RULES, EVENT_SCHEMA, Rule


def accepted_log(readings: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Validate, fill in, classify: one narrow chain, for batch and streaming frames."""
    return classify(enrich(accept(readings)), rules)


def acknowledgements(log: DataFrame) -> DataFrame:
    """What the sender gets back: id, resulting status, outcome and processing time."""
    return log.select(
        "event_id",
        F.col("status").alias("event_status"),
        F.lit("success").alias("processing_status"),
        F.current_timestamp().alias("processed_at"),
    )


def ingest_stats(readings: DataFrame) -> DataFrame:
    """Totals, accepted, rejected and success percentage (0 when nothing came in)."""
    bad = any_problem(event_problems())
    return readings.agg(
        F.count("*").alias("total"),
        F.count_if(~bad).alias("accepted"),
        F.count_if(bad).alias("rejected"),
    ).withColumn(
        "success_pct",
        F.coalesce(F.round(F.try_divide(F.col("accepted") * 100.0, F.col("total")), 6), F.lit(0.0)),
    )


def drop_retries(events: DataFrame) -> DataFrame:
    """Batch form: copies are readings that are equal in every field, as in ``LogTable``.

    Columns beside the fields of a reading do not count. Copies are combined map-side, however many there are of one reading.
    """
    return events.dropDuplicates([c for c in EVENT_SCHEMA.names if c in events.columns])


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("sensor_type", "status").agg(F.count("*").alias("n"))


def rejects_by_reason(rejected: DataFrame) -> DataFrame:
    """How often each reason was given; a row with two reasons counts under both."""
    # Few different lists exist, so they are counted before they are opened.
    lists = rejected.groupBy("reject_class", "reject_reasons").agg(F.count("*").alias("_n"))
    return (
        lists.select("reject_class", F.explode("reject_reasons").alias("reason"), "_n")
        .groupBy("reject_class", "reason")
        .agg(F.sum("_n").alias("n"))
    )
