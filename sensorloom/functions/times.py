"""Time expressions. They take TIMESTAMP or TIMESTAMP_NTZ columns; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ISO 8601 shapes accepted as event time (date, optional time, optional zone).
ISO_PATTERN = (
    r"^\d{4}-?\d{2}-?\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
EXTENDED_PATTERN = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
# Steps from the compact to the extended form, applied in this order.
ISO_TO_EXTENDED = (
    (r"^(\d{4})(\d{2})(\d{2})", "$1-$2-$3"),
    (r"^(.{10}[T ]\d{2})(Z|[+-].*)?$", "$1:00$2"),
    (r"^(.{10}[T ]\d{2})(\d{2})", "$1:$2"),
    (r"^(.{10}[T ]\d{2}:\d{2})(\d{2})", "$1:$2"),
    (r",(\d+)", ".$1"),
)
# Numbers above this are epoch milliseconds, below it epoch seconds.
EPOCH_MILLIS_FROM = 2e10


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_chunk(ts: Column, seconds: int) -> Column:
    """Number of the ``seconds``-long slice of time that holds ``ts``."""
    return F.floor(micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def like(df: DataFrame, text: str, column: str = "ts") -> Column:
    """Literal instant of the same type as ``df[column]``, so a filter on it is pushed down."""
    return F.lit(text).cast(df.schema[column].dataType)


def trunc_like(df: DataFrame, unit: str, ts: Column, column: str = "ts") -> Column:
    """``ts`` cut to the unit, in the type of ``df[column]``."""
    return F.date_trunc(unit, ts).cast(df.schema[column].dataType)


def parse_iso(text: Column) -> Column:
    """ISO 8601 text to an instant; null if malformed. Text without a zone is UTC."""
    extended = text
    for pattern, form in ISO_TO_EXTENDED:
        extended = F.regexp_replace(extended, pattern, form)
    usual = F.when(text.rlike(EXTENDED_PATTERN), text.try_cast("timestamp"))
    return usual.when(text.rlike(ISO_PATTERN), extended.try_cast("timestamp"))


def from_epoch(number: Column) -> Column:
    scale = F.when(F.abs(number) > EPOCH_MILLIS_FROM, 1e3).otherwise(1e6)
    return F.timestamp_micros((number * scale).try_cast("bigint"))


def iso_text(ts: Column) -> Column:
    """ISO text in UTC; the fraction is written only when there is one."""
    fraction = F.pmod(micros(ts), F.lit(1_000_000))
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == 0, "").otherwise(
            F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
        ),
        F.lit("+00:00"),
    )


def epoch_text(ts: Column) -> Column:
    """Epoch seconds as decimal text with the shortest fraction, at least one digit."""
    us = micros(ts)
    seconds = F.floor(us / 1_000_000).cast("bigint").cast("string")
    fraction = F.rtrim(
        F.lpad(F.pmod(us, F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("0")
    )
    return F.concat(seconds, F.lit("."), F.when(fraction == "", "0").otherwise(fraction))


def age_seconds(ts: Column, as_of: Column) -> Column:
    return F.floor((micros(as_of) - micros(ts)) / 1_000_000).cast("bigint")


def age_text(seconds: Column) -> Column:
    """``12s ago``, ``5m ago``, ``3h ago``; units are cut off, not rounded."""

    def units(length: int, suffix: str) -> Column:
        return F.concat(
            F.floor(seconds / length).cast("bigint").cast("string"), F.lit(suffix)
        )

    return (
        F.when(seconds < 60, units(1, "s ago"))
        .when(seconds < 3600, units(60, "m ago"))
        .when(seconds >= 3600, units(3600, "h ago"))
    )
