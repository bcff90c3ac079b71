"""JSON bodies and typed files to reading columns, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.once import compute_once
from sensorloom.functions.times import from_epoch, parse_iso
from sensorloom.schema import EVENT_SCHEMA, REQUIRED_FIELDS

# Fixed value: decimal number text; suffixes such as "1f" are not numbers.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
NON_FINITE_PATTERN = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
NUMERIC_KINDS = ("BIGINT", "DOUBLE", "FLOAT")

# A flat JSON object of at most 40 keys, without escapes or very long numbers.
_SPACE = r"[ \t\r\n]*"
_TEXT = r'"[^"\\\x00-\x1f]*+"'
_PLAIN = rf"(?:{_TEXT}|-?(?:0|[1-9]\d{{0,15}})(?:\.\d{{1,17}})?(?:[eE][+-]?\d{{1,2}})?|true|false|null)"
_PAIR = rf"{_TEXT}{_SPACE}:{_SPACE}{_PLAIN}{_SPACE}"
FLAT_BODY = rf"\A{_SPACE}\{{{_SPACE}(?:{_PAIR}(?:,{_SPACE}{_PAIR}){{0,39}})?\}}{_SPACE}\z"


def read_bodies(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One JSON body per line, in a column ``body``."""
    reader = spark.readStream if stream else spark.read
    return reader.text(path).withColumnRenamed("value", "body")


def read_events(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    stream: bool = False,
    schema: T.StructType = EVENT_SCHEMA,
) -> DataFrame:
    """Typed events; the schema is given, never inferred."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).format(fmt).load(path)


FIELDS = (*REQUIRED_FIELDS, "event_id", "unit", "status")
FIELD_KEY = rf'"(?:{"|".join(FIELDS)})"{_SPACE}:'


def _typed(field: str, kind: Column, text: Column) -> Column:
    """The field in its type from its JSON kind and text; null when it does not fit."""
    is_text = kind == "STRING"
    is_number = kind.isin(*NUMERIC_KINDS) | kind.startswith("DECIMAL")
    if field == "value":
        return (
            F.when(is_number, text.try_cast("double"))
            .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
            .when(is_text & text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
            .when(is_text & text.rlike(NON_FINITE_PATTERN), F.lit(float("nan")))
        )
    if field == "timestamp":
        return F.when(is_text, parse_iso(text)).when(is_number, from_epoch(text.try_cast("double")))
    return F.when(is_text, text)


def _flat_token(body: str, field: str) -> Column:
    """The JSON text of a field's value in a flat body; empty if the key is absent."""
    return F.regexp_extract(body, rf'"{field}"{_SPACE}:{_SPACE}("[^"]*"|[^,}} \t\r\n]+)', 1)


def parse_bodies(df: DataFrame, body: str = "body", fast: bool = True) -> DataFrame:
    """Reading columns plus ``parse_problems``, a comma list that is empty when the text is fine.

    A body must be one JSON object with the required keys. Text where a number belongs is
    read as a number; a number where text belongs is refused. The parser stops after the
    first value, so the body is read as the first of two list items: only if the checksum
    follows as the second did it end where its value ended. Of a repeated key the last holds,
    as in common JSON readers; the session setting for that is switched on here.

    Most bodies are flat objects without escapes or repeated keys. A pattern finds them, and their fields are
    cut out as they stand; only the rest goes through the parser. ``fast`` false sends every row there.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    mark = F.crc32(F.col(body).cast("binary"))
    doc = F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit(","), mark.cast("string"), F.lit("]")))
    shape = F.coalesce(F.col(body).rlike(FLAT_BODY), F.lit(False)) if fast else F.lit(False)
    tokens = {f"_v_{f}": F.when(F.col("_shape"), _flat_token(body, f)) for f in FIELDS}
    cut = compute_once(compute_once(df, {"_shape": shape}), tokens)
    # As many keys of ours as have a value: none comes twice.
    keys = F.when(F.col("_shape"), F.regexp_count(F.col(body), F.lit(FIELD_KEY)))
    once = compute_once(cut, {"_flat": F.coalesce(keys == sum((F.col(t) != "").cast("int") for t in tokens), F.lit(False))})
    parsed = compute_once(once.withColumn("_mark", mark), {"_list": F.when(~F.col("_flat"), doc)})

    def item(path: str, kind: str) -> Column:
        return F.try_variant_get("_list", path, kind)

    whole = (item("$[1]", "bigint") == F.col("_mark")) & item("$[2]", "variant").isNull()
    # The kind is null when the key is absent and VOID for an explicit null.
    first = F.substring(F.ltrim(F.col(body), F.lit(" \t\r\n")), 1, 1)
    cells = compute_once(parsed, {"_root": F.when(F.col("_flat"), F.lit("{")).when(whole, first)})
    column = {f: "ts" if f == "timestamp" else f for f in FIELDS}
    readable = F.col("_root").isNotNull()
    # A step for each field: the code of one for all of them is too long for the JVM to compile.
    for f in FIELDS:
        token, initial = F.col(f"_v_{f}"), F.col("_initial")
        cells = compute_once(cells, {"_initial": F.substring(token, 1, 1), "_item": item(f"$[0].{f}", "variant")})
        kind = F.when(initial == '"', "STRING").when(initial == "n", "VOID").when(initial.isin("t", "f"), "BOOLEAN").when(initial != "", "DOUBLE")
        text = F.when(initial == '"', F.substring(token, F.lit(2), F.length(token) - 2)).when(~initial.isin("n", ""), token)
        read = {
            f"_k_{f}": F.when(F.col("_flat"), kind).otherwise(F.schema_of_variant("_item")),
            "_text": F.when(F.col("_flat"), text).otherwise(F.try_variant_get("_item", "$", "string")),
        }
        cells = compute_once(cells, read).drop("_initial", "_item")
        typed = F.when(readable, _typed(f, F.col(f"_k_{f}"), F.col("_text")))
        cells = compute_once(cells, {column[f]: typed}).drop("_text", f"_v_{f}")
    values = cells

    required = [
        check
        for f in REQUIRED_FIELDS
        for check in (
            F.when(F.col(f"_k_{f}").isNull(), f"missing:{f}"),
            F.when(F.col(f"_k_{f}").isNotNull() & F.col(column[f]).isNull(), f"{f}:invalid"),
        )
    ]
    # An explicit null is allowed where the default is null, but not for status.
    optional = [
        F.when(~F.col(f"_k_{f}").isin("STRING", "VOID"), f"{f}:invalid") for f in ("event_id", "unit")
    ] + [F.when(F.col("_k_status") != "STRING", "status:invalid")]
    # Lists and texts hold no keys; other scalars cannot be asked for keys at all.
    keyed = F.col("_root").isin("{", "[", '"')
    problems = (
        F.when(F.col(body).isNull() | (F.col(body) == ""), "body:empty")
        .when(F.col("_root").isNull(), "body:malformed")
        .when(~keyed, "internal:body_is_a_scalar")
        .otherwise(F.concat_ws(",", *required, *optional))
    )
    helpers = ["_shape", "_flat", "_list", "_mark", "_root", *[f"_k_{f}" for f in FIELDS]]
    return values.withColumn("parse_problems", problems).drop(*helpers)
