"""Patterns, statistics, devices."""

import datetime as dt
import statistics

from helpers import START, at, dicts, event_row, events
from pyspark.sql import functions as F

from sensorloom.operators import alerts, behavior, devices, reads
from sensorloom.operators.classify import classify

MESSAGE = "message_id string, device_id bigint, ts timestamp, status string"


def test_schedule(spark):
    # 2026-01-12 is a Monday. Hours 9 and 10 are used on both Mondays, 11 on one, 14 on none.
    rows = []
    for week in (0, 7):
        for hour, value in ((9, 3), (10, 1), (11, 1 if week else 0), (14, 0)):
            minutes = (dt.datetime(2026, 1, 12 + week, hour) - START).total_seconds() / 60
            rows.append(event_row(f"{week}-{hour}", "a", "occupancy", value, minutes))
    got = dicts(behavior.occupancy_schedule(events(spark, rows)))
    assert [(r["weekday"], r["from_hour"], r["to_hour"], float(r["confidence"])) for r in got] == [(1, 9, 12, 0.83)]


def test_z_scores(spark):
    values = [10.0] * 30 + [11.0] * 30 + [60.0]
    rows = [event_row(f"{i:02d}", "a", "temperature", v, i) for i, v in enumerate(values)]
    rows += [event_row("flat1", "b", "temperature", 5, 0), event_row("flat2", "b", "temperature", 5, 1)]
    rows += [event_row("one", "c", "temperature", 5, 0)]
    got = dicts(behavior.anomalies_with_resolution(events(spark, rows)))
    z = (60 - statistics.mean(values)) / statistics.stdev(values)
    assert [(r["event_id"], r["severity"], r["resolved"]) for r in got] == [("60", "high", False)]
    assert abs(got[0]["z"] - z) < 1e-6
    later = rows + [event_row("z", "a", "temperature", 10, 100)]
    found = behavior.anomalies_with_resolution(events(spark, later))
    assert dicts(found)[0]["resolved"] is True and behavior.unresolved(found, "room_id").count() == 0


def test_baseline_beyond_the_broadcast_limit(spark, monkeypatch):
    from sensorloom import session

    rows = [event_row(str(i), "ab"[i % 2], "temperature", i, i) for i in range(20)]
    small = behavior.z_scores(events(spark, rows), ["room_id"])
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    side = session.sized_side(behavior.baselines(events(spark, rows), ["room_id"]), 0)
    assert "broadcast" not in side._jdf.queryExecution().logical().toString().lower()
    assert small.count() == 20


def test_pages_keep_every_item(spark):
    items = spark.createDataFrame(
        [("a", at(i), f"{i:03d}", (i,)) for i in range(25)], "room_id string, ts timestamp, item_id string, item struct<n:int>"
    )
    pages = dicts(behavior.insight_pages(items.limit(0), items, page_size=10).orderBy("page"))
    assert [p["page"] for p in pages] == [0, 1, 2] and all(p["patterns"] == [] for p in pages)
    assert [i["n"] for p in pages for i in p["anomalies"]] == list(range(25))


def test_validity_is_half_open(spark):
    found = spark.createDataFrame(
        [("a", "p", at(0)), ("a", "p", at(10))], "room_id string, pattern_type string, detected_at timestamp"
    )
    patterns = behavior.versioned_patterns(found)
    assert [r["valid_from"] for r in dicts(behavior.valid_at(patterns, F.lit(at(9.9))))] == [at(0)]
    assert [r["valid_from"] for r in dicts(behavior.valid_at(patterns, F.lit(at(10))))] == [at(10)]
    assert behavior.valid_at(patterns, F.lit(at(-1))).count() == 0


def test_activity_fills_empty_hours(spark):
    rows = [event_row("1", "a", "motion", 1, 0), event_row("2", "a", "motion", 1, 1), event_row("3", "a", "motion", 1, -120),
            event_row("old", "a", "motion", 1, -60 * 30)]
    got = sorted(dicts(behavior.hourly_activity(events(spark, rows))), key=lambda r: r["hour"])
    assert len(got) == 24 and sum(r["n"] for r in got) == 3
    assert (got[-1]["n"], got[-1]["height_pct"], got[-3]["height_pct"], got[-2]["n"]) == (2, 100.0, 50.0, 0)


def test_slices_and_increments(spark):
    df = events(spark, [event_row(str(d), "ab"[d % 2], "motion", 1, d * 60 * 24) for d in range(6)])
    part = behavior.analysis_slice(df, "2026-01-16", "2026-01-18")
    typed = df.withColumn("entity_type", F.when(F.col("room_id") == df.first()["room_id"], "office").otherwise("hall"))
    office = behavior.analysis_slice(typed, "2026-01-01", "2026-01-31", entity_type="office")
    assert {r["room_id"] for r in dicts(office)} == {df.first()["room_id"]}
    assert sorted(r["event_id"] for r in dicts(part)) == ["1", "2", "3"]
    ids = spark.createDataFrame([("b",)], "room_id string")
    assert behavior.analysis_slice(df, "2026-01-16", "2026-01-18", ids).count() == 2
    raw = spark.createDataFrame([("1", '{"k": 1.5, "j": 2}'), ("2", "{bad"), ("3", '{"k": 1}')], "id string, data string")
    left = behavior.unprocessed(raw, spark.createDataFrame([("3",)], "id string"))
    assert sorted((r["id"], r["field"], r["value"]) for r in dicts(behavior.json_fields(left))) == [("1", "j", 2.0), ("1", "k", 1.5)]


def test_wide_and_long(spark):
    rows = [event_row("1", "a", "temperature", 20, 0), event_row("2", "a", "humidity", 40, 0), event_row("3", "a", "motion", 1, 5)]
    wide = reads.wide_history(events(spark, rows))
    got = {r["ts"]: (r["temperature"], r["humidity"], r["motion"], r["occupancy"]) for r in dicts(wide)}
    assert got == {at(0): (20.0, 40.0, None, None), at(5): (None, None, 1.0, None)}
    long = alerts.unpivot_wide(wide.withColumn("occupancy", F.col("motion") == 1))
    assert sorted((r["sensor_type"], r["value"]) for r in dicts(long)) == [
        ("humidity", 40.0), ("motion", 1.0), ("occupancy", 1.0), ("temperature", 20.0),
    ]
    assert reads.wide_history(events(spark, rows), limit=1).count() == 1
    assert reads.wide_history(events(spark, rows), F.lit(at(0)), F.lit(at(0))).count() == 1


def messages(spark, rows):
    return spark.createDataFrame([(f"m{i:03d}", d, at(m), "processed") for i, (d, m) in enumerate(rows)], MESSAGE)


def registry(spark):
    return spark.createDataFrame(
        [(1, "t", "free", "registered", {"location": "a"}), (2, "t", "standard", "suspended", {}), (3, "h", "free", "registered", None)],
        "device_id bigint, device_type string, tier string, status string, metadata map<string,string>",
    )


def test_device_status(spark):
    sent = messages(spark, [(1, 0), (1, 30), (1, 59.9), (2, 59.5), (1, 60 * 24)])
    got = {r["device_id"]: r for r in dicts(devices.device_status(registry(spark), sent, F.lit(at(60)), {"free": 2, "standard": 5}))}
    assert (got[1]["status"], got[1]["health"], got[1]["message_count_today"], got[1]["rate_limit_remaining"]) == ("online", "ok", 3, 2)
    assert (got[2]["status"], got[2]["health"]) == ("suspended", "slow")
    assert (got[3]["status"], got[3]["health"], got[3]["last_seen"], got[3]["age"]) == ("offline", "down", None, None)


def test_health_bounds(spark):
    df = spark.createDataFrame([(s,) for s in (2, 5, 29, 30, 45, 299, 300, 10800, None)], "s int")
    got = [r[0] for r in df.select(devices.heartbeat_health(F.col("s"))).collect()]
    assert got == ["ok", "ok", "ok", "slow", "slow", "slow", "down", "down", "down"]


def test_limits(spark):
    sent = messages(spark, [(1, 0), (1, 10), (1, 20), (1, 60), (2, 0), (9, 0)])
    got = {(r["device_id"], r["window_start"]): r for r in dicts(devices.hourly_usage(sent, registry(spark), {"free": 2, "standard": 5}))}
    assert (got[1, at(0)]["request_count"], got[1, at(0)]["remaining"], got[1, at(0)]["exceeded"]) == (3, 0, True)
    assert (got[2, at(0)]["remaining"], got[2, at(0)]["exceeded"]) == (4, False)
    assert (got[9, at(0)]["limit"], got[9, at(0)]["exceeded"]) == (None, False)
    admitted = {r["message_id"]: r["admitted"] for r in dicts(devices.admission(sent, 2))}
    assert admitted == {"m000": True, "m001": True, "m002": False, "m003": True, "m004": True, "m005": True}


def test_bursts(spark):
    sent = messages(spark, [(1, 0.9), (1, 0.95), (1, 1.05), (2, 0)])
    assert dicts(devices.bursts(sent, 2)) == []
    sliding = dicts(devices.bursts(sent, 2, "10 seconds"))
    assert {r["device_id"] for r in sliding} == {1} and {r["n"] for r in sliding} == {3}
    assert dicts(devices.rate_per_minute(sent, F.lit(at(1.5)))) == [{"device_id": 1, "per_minute": 2}, {"device_id": 2, "per_minute": 1}]


def test_payload_readings(spark):
    sent = spark.createDataFrame(
        [("m1", 1, at(0), {"temperature": 35.0, "humidity": 45.0}), ("m2", 3, at(0), {"temperature": 20.0})],
        "message_id string, device_id bigint, ts timestamp, payload map<string,double>",
    )
    got = {r["event_id"]: r for r in dicts(classify(devices.payload_readings(sent, registry(spark))))}
    assert (got["m1_temperature"]["room_id"], got["m1_temperature"]["status"], got["m1_humidity"]["status"]) == ("a", "alert", "normal")
    assert got["m2_temperature"]["room_id"] is None


def test_registration(spark):
    base = registry(spark).withColumn("registered_at", F.lit(at(0)))
    new = base.filter("device_id = 1").withColumns({"tier": F.lit("standard"), "registered_at": F.lit(at(1))})
    newer = new.withColumns({"tier": F.lit("gold"), "registered_at": F.lit(at(2))})
    got = {r["device_id"]: r["tier"] for r in dicts(devices.register(base, new.unionByName(newer)))}
    assert got == {1: "gold", 2: "standard", 3: "free"}
