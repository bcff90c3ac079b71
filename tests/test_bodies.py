"""The fast way through flat bodies gives what the parser gives."""

import json
import random
import re

import pytest
from helpers import dicts

from sensorloom.operators.classify import classify
from sensorloom.operators.enrich import enrich
from sensorloom.operators.validate import check_parsed
from sensorloom.sources.raw import FIELDS, parse_bodies


def bodies(seed, count=600):
    rng = random.Random(seed)
    values = ["", "a", "room-1", "21.5", " 7 ", "nan", "Infinity", "1f", "2026-01-15T12:00:00Z", "2026-01-15 12:00", "alert", "é", "a,b", "x:y", "{z}", "null", "a\\b", 'q"q', "line\n"]
    plain = [0, 1, -3, 21.5, 1e-7, 1.7684784e9, 1768478400000, 10**30, 1.5e308, True, False, None, [], {}, [1], {"a": 1}]
    out = ["", " ", "{}", "[]", "[1]", '"text"', "7", "null", "true", "{", "}", '{"a"}', '{"a":}', '{"a":1,}', "{,}", '{"value":01}', '{"value":+1}', '{"value":1.}', '{"value":.5}', '{"value":1e999}', '{"value":--1}', "﻿{}", '{"a":1}]', '{"a":1} x', '{"room_id":"a"}{"room_id":"b"}', '{"value":1,"value":"2"}', '{"room_id": "x" , "room_id" :null}', "{'a':1}", '{"value":NaN}', '{"room_id":"a\nb"}', '{"room_id":"\\u0061"}', "{" + ",".join(f'"k{i}":{i}' for i in range(60)) + ',"value":3}', None]
    for _ in range(count):
        keys = [k for k in (*FIELDS, "extra", "room", "value2") if rng.random() < 0.8]
        rng.shuffle(keys)
        record = {k: rng.choice(values if rng.random() < 0.6 else plain) for k in keys}
        text = json.dumps(record, ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": "), (" ,\t", " : ")]))
        out.append(text if rng.random() < 0.8 else text[: rng.randrange(len(text) + 1)] + rng.choice(["", "}", ",", '"', " "]))
    return out


def test_both_ways_agree(spark):
    frame = spark.createDataFrame([(i, b) for i, b in enumerate(bodies(5))], "n int, body string")
    fast, slow = (sorted(map(str, dicts(parse_bodies(frame, fast=way)))) for way in (True, False))
    assert fast == slow


# The JVM compiles no method of more than 8000 bytes; it interprets it, row after row.
COMPILED = 8000


@pytest.mark.parametrize("side", (0, 1))
def test_generated_code_is_short_enough_to_be_compiled(spark, tmp_path, side):
    spark.createDataFrame([(b,) for b in bodies(5, 20)], "body string").write.parquet(f"{tmp_path}/bodies")
    rows = check_parsed(parse_bodies(spark.read.parquet(f"{tmp_path}/bodies")))[side]
    plan = (rows if side else classify(enrich(rows)))._jdf.queryExecution().executedPlan()
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < COMPILED
