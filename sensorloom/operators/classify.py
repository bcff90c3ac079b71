"""Threshold classification, breach explanation and escalation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.once import compute_once
from sensorloom.operators.validate import is_finite
from sensorloom.schema import DEFAULT_RULES, EVENT_STATUSES, RULE_SCHEMA, UNITS, Rule

BOUNDS = ("critical_min", "min", "max", "critical_max")


def rule_frame(spark: SparkSession, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.sensor_type, r.critical_min, r.min, r.max, r.critical_max) for r in rules],
        RULE_SCHEMA,
    )


def _per_rule(rules: Sequence[Rule], sensor_type: Column, make, default: Column) -> Column:
    """One CASE over sensor types, with the bounds as literals: no join, one branch per rule."""
    case = default
    for rule in rules:
        limits = {b: F.lit(float(v)) for b in BOUNDS if (v := getattr(rule, b)) is not None}
        case = F.when(sensor_type == rule.sensor_type, make(limits)).otherwise(case)
    return case


def _tests(value: Column, bounds: dict[str, Column]) -> list[tuple[str, Column, Column]]:
    """Breach kind, condition and limit, critical bounds (which include their limit) first."""
    every = [
        ("critical_high", "critical_max", lambda b: value >= b),
        ("critical_low", "critical_min", lambda b: value <= b),
        ("high", "max", lambda b: value > b),
        ("low", "min", lambda b: value < b),
    ]
    return [(kind, test(bounds[b]), bounds[b]) for kind, b, test in every if b in bounds]


def breach_level(value: Column, bounds: dict[str, Column]) -> Column:
    """0 normal, 1 warning, 2 alert. Non-finite values break no bound."""
    level = F.lit(0)
    for kind, broken, _ in reversed(_tests(value, bounds)):
        level = F.when(broken, 2 if kind.startswith("critical") else 1).otherwise(level)
    return F.when(is_finite(value), level).otherwise(0)


def severity(status: Column) -> Column:
    return F.when(status == "alert", 2).when(status == "warning", 1).otherwise(0)


def status_of(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in EVENT_STATUSES]), level + 1)


def _classified(df: DataFrame, level: Column) -> DataFrame:
    """The supplied status may be raised but is never lowered."""
    supplied = severity(F.col("status")) if "status" in df.columns else F.lit(0)
    return df.withColumns(
        {"detected_status": status_of(level), "status": status_of(F.greatest(level, supplied))}
    )


def classify(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Add ``detected_status`` and escalate ``status``; sensors without a rule are normal."""
    value = F.col("value")
    level = _per_rule(rules, F.col("sensor_type"), lambda b: breach_level(value, b), F.lit(0))
    return _classified(df, level)


def classify_by_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``classify``, with the bounds in a table of any size (one row per sensor type)."""
    named = rules.select("sensor_type", *[F.col(b).alias(f"_{b}") for b in BOUNDS])
    joined = df.join(named, "sensor_type", "left")
    out = _classified(joined, breach_level(F.col("value"), {b: F.col(f"_{b}") for b in BOUNDS}))
    return out.select(*[c for c in df.columns if c != "status"], "detected_status", "status")


WORDING = {
    "critical_high": " reaches the critical maximum ",
    "critical_low": " reaches the critical minimum ",
    "high": " exceeds the maximum ",
    "low": " is under the minimum ",
}


def explain_breaches(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """Only the readings that break a bound, with a ``breach`` struct and a readable text."""
    value, sensor = F.col("value"), F.col("sensor_type")
    nothing = F.lit(None).cast("struct<kind:string,limit:double>")

    def found(bounds: dict[str, Column]) -> Column:
        case = nothing
        for kind, broken, limit in reversed(_tests(value, bounds)):
            case = F.when(broken, F.struct(F.lit(kind).alias("kind"), limit.alias("limit"))).otherwise(case)
        return F.when(is_finite(value), case)

    unit = F.lit("")
    for name, text in UNITS.items():
        unit = F.when(sensor == name, text).otherwise(unit)
    kind, limit = F.col("_b.kind"), F.col("_b.limit")
    wording = F.lit(None).cast("string")
    for name, text in WORDING.items():
        wording = F.when(kind == name, text).otherwise(wording)
    message = F.concat(
        sensor, F.lit(" "), value.cast("string"), unit, wording, limit.cast("string"), unit
    )
    breach = F.struct(
        kind.alias("kind"),
        limit.alias("limit"),
        F.when(kind.startswith("critical"), "alert").otherwise("warning").alias("severity"),
        message.alias("text"),
    )
    return (
        compute_once(df, {"_b": _per_rule(rules, sensor, found, nothing)})
        .filter(F.col("_b").isNotNull())
        .withColumn("breach", breach)
        .drop("_b")
    )
