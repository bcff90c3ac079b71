"""Validation of readings and rooms: accepted and rejected frames, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.once import compute_once
from sensorloom.schema import EVENT_STATUSES, ROOM_ID_LENGTH, ROOM_STATUSES, SENSOR_TYPES

BAD_REQUEST = "bad_request"
UNPROCESSABLE = "unprocessable"
INTERNAL = "internal"

REJECT_COLUMNS = ("reject_class", "reject_reasons")

Problem = tuple[str, Column]


def is_finite(value: Column) -> Column:
    # NaN sorts above every number in Spark, so it has to be named.
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def id_length_ok(room_id: Column) -> Column:
    return F.length(room_id).between(*ROOM_ID_LENGTH)


def event_problems(sensor_types: tuple[str, ...] = SENSOR_TYPES) -> list[Problem]:
    """Reason code and the condition under which a typed reading has it."""
    c = F.col
    return [
        ("missing:room_id", c("room_id").isNull()),
        ("missing:sensor_type", c("sensor_type").isNull()),
        ("missing:value", c("value").isNull()),
        ("missing:timestamp", c("ts").isNull()),
        ("room_id:length", ~id_length_ok(c("room_id"))),
        ("sensor_type:domain", ~c("sensor_type").isin(*sensor_types)),
        ("value:not_finite", ~is_finite(c("value"))),
        ("status:domain", ~c("status").isin(*EVENT_STATUSES)),
    ]


def room_problems() -> list[Problem]:
    c = F.col
    return [
        ("room_id:length", c("room_id").isNull() | ~id_length_ok(c("room_id"))),
        ("name:missing", c("name").isNull()),
        ("status:domain", ~c("status").isin(*ROOM_STATUSES)),
        ("last_update:missing", c("last_update").isNull()),
        ("alert_count_24h:negative", c("alert_count_24h") < 0),
    ]


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def reasons(problems: list[Problem]) -> Column:
    """All reason codes that hold, as one comma list (empty when there are none)."""
    return F.concat_ws(",", *[F.when(_holds(bad), code) for code, bad in problems])


def any_problem(problems: list[Problem]) -> Column:
    bad = F.lit(False)
    for _, condition in problems:
        bad = bad | _holds(condition)
    return bad


def reject_class(reason_list: Column) -> Column:
    return (
        F.when(reason_list.rlike(r"(^|,)internal:"), INTERNAL)
        .when(reason_list.rlike(r"(^|,)(body|missing):"), BAD_REQUEST)
        .otherwise(UNPROCESSABLE)
    )


def _with_reasons(df: DataFrame, reason_list: Column) -> DataFrame:
    return (
        compute_once(df, {"_reasons": reason_list})
        .withColumns(
            {
                "reject_class": reject_class(F.col("_reasons")),
                "reject_reasons": F.split("_reasons", ","),
            }
        )
        .drop("_reasons")
    )


def accept(df: DataFrame, sensor_types: tuple[str, ...] = SENSOR_TYPES) -> DataFrame:
    """Typed readings that pass every check; one filter, no reason is built."""
    return df.filter(~any_problem(event_problems(sensor_types)))


def reject(df: DataFrame, sensor_types: tuple[str, ...] = SENSOR_TYPES) -> DataFrame:
    """Typed readings that fail, with ``reject_class`` and ``reject_reasons``."""
    problems = event_problems(sensor_types)
    return _with_reasons(df.filter(any_problem(problems)), reasons(problems))


def check_rooms(rooms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected room records."""
    problems = room_problems()
    bad = any_problem(problems)
    return rooms.filter(~bad), _with_reasons(rooms.filter(bad), reasons(problems))


def check_parsed(
    parsed: DataFrame, sensor_types: tuple[str, ...] = SENSOR_TYPES
) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a parsed body frame.

    Its ``parse_problems`` hold what only the text shows (a missing key against an explicit
    null, a wrong JSON type); a field listed there is not reported a second time.
    """
    typed = event_problems(sensor_types)
    domain = [p for p in typed if not p[0].startswith("missing:")]
    unparsed = F.col("parse_problems") != ""
    bad = unparsed | any_problem(domain)
    every = F.concat_ws(
        ",",
        F.when(unparsed, F.col("parse_problems")),
        *[F.when(_holds(problem), code) for code, problem in domain],
    )
    accepted = parsed.filter(~bad).drop("parse_problems")
    rejected = _with_reasons(parsed.filter(bad), every).drop("parse_problems")
    return accepted, rejected
