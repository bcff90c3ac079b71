"""Bodies, validation, defaults and ids."""

import datetime as dt
import json

from helpers import START, dicts, event_row, events
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sensorloom.operators import ingest
from sensorloom.operators.enrich import enrich
from sensorloom.operators.validate import accept, check_parsed, check_rooms, reject
from sensorloom.schema import ROOM_SCHEMA
from sensorloom.sources.raw import parse_bodies

GOOD = {"room_id": "room-a", "sensor_type": "temperature", "value": 21.5, "timestamp": "2026-01-15T12:00:00Z"}


def body(drop=(), **changes):
    return json.dumps({k: v for k, v in {**GOOD, **changes}.items() if k not in drop})


def split(spark, bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    good, bad = check_parsed(parse_bodies(df))
    return dicts(good), dicts(bad)


REJECTS = [
    (None, "bad_request", ["body:empty"]),
    ("", "bad_request", ["body:empty"]),
    ("   ", "bad_request", ["body:malformed"]),
    ("{not json", "bad_request", ["body:malformed"]),
    (body() + "]", "bad_request", ["body:malformed"]),
    (body() + " " + body(), "bad_request", ["body:malformed"]),
    (body() + "," + body(), "bad_request", ["body:malformed"]),
    ("[]", "bad_request", [f"missing:{f}" for f in ("room_id", "sensor_type", "value", "timestamp")]),
    ('"text"', "bad_request", [f"missing:{f}" for f in ("room_id", "sensor_type", "value", "timestamp")]),
    ("{}", "bad_request", [f"missing:{f}" for f in ("room_id", "sensor_type", "value", "timestamp")]),
    ("42", "internal", ["internal:body_is_a_scalar"]),
    ("null", "internal", ["internal:body_is_a_scalar"]),
    (body(drop=["value"]), "bad_request", ["missing:value"]),
    (body(drop=["room_id", "timestamp"]), "bad_request", ["missing:room_id", "missing:timestamp"]),
    (body(value=None), "unprocessable", ["value:invalid"]),
    (body(value="warm"), "unprocessable", ["value:invalid"]),
    (body(value="1f"), "unprocessable", ["value:invalid"]),
    (body(value=[1]), "unprocessable", ["value:invalid"]),
    (body(value="NaN"), "unprocessable", ["value:not_finite"]),
    (body(value="-inf"), "unprocessable", ["value:not_finite"]),
    (body(room_id=""), "unprocessable", ["room_id:length"]),
    (body(room_id="x" * 51), "unprocessable", ["room_id:length"]),
    (body(room_id=7), "unprocessable", ["room_id:invalid"]),
    (body(sensor_type="pressure"), "unprocessable", ["sensor_type:domain"]),
    (body(sensor_type=None), "unprocessable", ["sensor_type:invalid"]),
    (body(status="broken"), "unprocessable", ["status:domain"]),
    (body(status=None), "unprocessable", ["status:invalid"]),
    (body(unit=5), "unprocessable", ["unit:invalid"]),
    (body(timestamp="yesterday"), "unprocessable", ["timestamp:invalid"]),
    (body(timestamp="2026-13-01"), "unprocessable", ["timestamp:invalid"]),
    (body(timestamp="2026-01"), "unprocessable", ["timestamp:invalid"]),
    (body(room_id="", value="warm"), "unprocessable", ["value:invalid", "room_id:length"]),
]


def test_rejects(spark):
    good, bad = split(spark, [b for b, _, _ in REJECTS])
    assert good == []
    got = {r["body"]: (r["reject_class"], r["reject_reasons"]) for r in bad}
    assert got == {b: (c, reasons) for b, c, reasons in REJECTS}


ACCEPTED = [
    (body(), 21.5, START),
    (body(value="22.25"), 22.25, START),
    (body(value=True), 1.0, START),
    (body(value=-3), -3.0, START),
    (body(value="1e1"), 10.0, START),
    (body(room_id="x" * 50), 21.5, START),
    (body(timestamp="2026-01-15T14:00:00+02:00"), 21.5, START),
    (body(timestamp="2026-01-15T14:00:00+0200"), 21.5, START),
    (body(timestamp="2026-01-15 12:00:00"), 21.5, START),
    (body(timestamp="2026-01-15"), 21.5, START.replace(hour=0)),
    (body(timestamp="20260115T120000"), 21.5, START),
    (body(timestamp="20260115T120000Z"), 21.5, START),
    (body(timestamp="2026-01-15T12"), 21.5, START),
    (body(timestamp="2026-01-15T12:00:00.25Z"), 21.5, START + dt.timedelta(milliseconds=250)),
    (body(timestamp="2026-01-15T12:00:00,123456789"), 21.5, START + dt.timedelta(microseconds=123456)),
    (body(timestamp=START.replace(tzinfo=dt.timezone.utc).timestamp()), 21.5, START),
    (body(timestamp=int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1000), 21.5, START),
    (body(unit=None, event_id=None), 21.5, START),
    ("\n " + body() + " \n", 21.5, START),
]


def test_accepted(spark):
    good, bad = split(spark, [b for b, _, _ in ACCEPTED])
    assert bad == []
    got = {r["body"]: (r["value"], r["ts"]) for r in good}
    assert got == {b: (v, ts) for b, v, ts in ACCEPTED}


json_values = st.none() | st.booleans() | st.integers(-5, 5) | st.text(max_size=4) | st.lists(st.integers(), max_size=2)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(
        st.text(max_size=20)
        | st.dictionaries(st.sampled_from(list(GOOD) + ["status"]), json_values).map(json.dumps)
        | json_values.map(json.dumps),
        min_size=1, max_size=40,
    )
)
def test_every_body_lands_once(spark, bodies):
    good, bad = split(spark, bodies)
    assert len(good) + len(bad) == len(bodies)
    for r in bad:
        assert r["reject_reasons"] and all(r["reject_reasons"])


def test_typed_events(spark):
    df = events(
        spark,
        [
            event_row("ok", "r", "motion", 1, 0),
            event_row("nan", "r", "motion", float("nan"), 0),
            event_row("inf", "r", "motion", float("-inf"), 0),
            event_row("none", None, "motion", None, 0),
            event_row("kind", "r", "noise", 1, 0),
            event_row("status", "r", "motion", 1, 0, status="odd"),
        ],
    )
    assert [r["event_id"] for r in dicts(accept(df))] == ["ok"]
    assert {r["event_id"]: (r["reject_class"], r["reject_reasons"]) for r in dicts(reject(df))} == {
        "nan": ("unprocessable", ["value:not_finite"]),
        "inf": ("unprocessable", ["value:not_finite"]),
        "none": ("bad_request", ["missing:room_id", "missing:value"]),
        "kind": ("unprocessable", ["sensor_type:domain"]),
        "status": ("unprocessable", ["status:domain"]),
    }
    stats = dicts(ingest.ingest_stats(df))[0]
    assert (stats["total"], stats["accepted"], stats["rejected"]) == (6, 1, 5)
    assert dicts(ingest.ingest_stats(df.limit(0)))[0]["success_pct"] == 0.0


def test_defaults_and_ids(spark):
    df = events(
        spark,
        [
            event_row(None, "room-a", "temperature", 20, 0),
            event_row("", "room-a", "humidity", 20, 0.5 / 60),
            event_row("mine", "room-a", "occupancy", 20, 0, unit="heads", status="alert"),
        ],
    )
    got = {r["sensor_type"]: (r["event_id"], r["unit"], r["status"]) for r in dicts(enrich(df))}
    assert got == {
        "temperature": ("room-a_1768478400.0_temperature", "°C", "normal"),
        "humidity": ("room-a_1768478400.5_humidity", "%", "normal"),
        "occupancy": ("mine", "heads", "alert"),
    }
    assert dicts(enrich(df, literal_ids=True))[0]["event_id"] == "room-a_1768478400.0"


def test_retries_are_dropped(spark):
    row = event_row(None, "room-a", "temperature", 20, 0)
    df = enrich(events(spark, [row, row, row, event_row(None, "room-a", "humidity", 50, 0)]))
    assert ingest.drop_retries(df).count() == 2


def test_room_checks(spark):
    rows = [
        ("a", "A", "active", START, None, 0), ("", "A", "active", START, None, 0), ("c", None, "open", START, None, -1),
        ("d", "D", "offline", None, None, 1),
    ]
    good, bad = check_rooms(spark.createDataFrame(rows, ROOM_SCHEMA))
    assert [r["room_id"] for r in dicts(good)] == ["a"]
    assert {r["room_id"]: r["reject_reasons"] for r in dicts(bad)} == {
        "": ["room_id:length"],
        "c": ["name:missing", "status:domain", "alert_count_24h:negative"],
        "d": ["last_update:missing"],
    }


def test_accept_is_one_narrow_stage(spark):
    df = events(spark, [event_row("e", "r", "motion", 1, 0)])
    plan = ingest.accepted_log(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
