"""Folds, running values and images, against plain Python."""

import datetime as dt

from helpers import START, at, dicts, event_row, events
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.functions.times import time_chunk
from sensorloom.operators import alerts, reads, state
from sensorloom.operators.classify import classify
from sensorloom.operators.ingest import accepted_log
from sensorloom.operators.sequence import ordered_fold

QUICK = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
SENSORS = ["temperature", "humidity", "occupancy", "motion"]

reading = st.tuples(
    st.sampled_from(["a", "b"]), st.sampled_from(SENSORS), st.integers(-5, 40), st.integers(0, 4000)
)


def log(spark, readings):
    rows = [event_row(f"{i:03d}", room, sensor, value, minute) for i, (room, sensor, value, minute) in enumerate(readings)]
    return accepted_log(events(spark, rows))


def by_hand(rows):
    """Fold in (ts, event_id) order, one event at a time."""
    rooms = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        room = rooms.setdefault(
            r["room_id"],
            {"name": "Room " + r["room_id"], "status": "active", "alert_count_24h": 0, "current_state": dict.fromkeys(SENSORS)},
        )
        value = r["value"]
        typed = {"motion": bool(value), "occupancy": int(value)}.get(r["sensor_type"], value)
        room["current_state"][r["sensor_type"]] = typed
        room["last_update"] = r["ts"]
        if r["status"] != "normal":
            room["status"] = r["status"]
            room["alert_count_24h"] += 1
    return rooms


def keyed(df):
    return {r.pop("room_id"): r for r in dicts(df)}


@QUICK
@given(st.lists(reading, min_size=1, max_size=60), st.integers(1, 6))
def test_fold_equals_one_by_one(spark, readings, parts):
    df = log(spark, readings)
    expected = by_hand(dicts(df))
    assert keyed(state.fold_rooms(df.repartition(parts))) == expected
    assert keyed(state.fold_rooms_by_sensor(df.repartition(parts, "sensor_type"))) == expected


def test_sticky_status(spark):
    df = log(spark, [("a", "temperature", 35, 0), ("a", "temperature", 27, 1), ("a", "temperature", 20, 2)])
    room = keyed(state.fold_rooms(df))["a"]
    assert (room["status"], room["alert_count_24h"], room["last_update"]) == ("warning", 2, at(2))


def test_arrival_order(spark):
    df = log(spark, [("a", "temperature", 21, 10), ("a", "temperature", 22, 5)])
    arrived = df.withColumn("arrival", F.col("event_id").cast("int"))
    late = keyed(state.fold_rooms(arrived, ("arrival",)))["a"]
    assert late["current_state"]["temperature"] == 22.0 and late["last_update"] == at(5)
    assert keyed(state.fold_rooms(df))["a"]["current_state"]["temperature"] == 21.0


def test_occupancy_is_cut_and_motion_is_a_flag(spark):
    df = events(spark, [event_row("1", "a", "occupancy", -2.9, 0), event_row("2", "a", "motion", 0.5, 0)])
    got = keyed(state.fold_rooms(classify(df)))["a"]["current_state"]
    assert got == {"temperature": None, "humidity": None, "occupancy": -2, "motion": True}


@QUICK
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 300), st.integers(-3, 3)), min_size=1, max_size=50),
       st.integers(1, 40))
def test_running_values(spark, rows, width):
    data = [(k, t, i, v if v else None) for i, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "k string, t int, i int, v int")
    got = ordered_fold(
        df, ["k"], ["t", "i"], F.floor(F.col("t") / width),
        sums={"total": F.coalesce("v", F.lit(0))}, totals={"all": "total"},
        values={"v": F.col("v")}, lasts={"last": "v"}, priors={"prior": "v"},
    )
    for r in dicts(got):
        mine = sorted((d for d in data if d[0] == r["k"]), key=lambda d: d[1:3])
        upto = [d[3] for d in mine if d[1:3] <= (r["t"], r["i"])]
        seen = [v for v in upto if v is not None]
        before = [v for v in upto[:-1] if v is not None]
        assert r["total"] == sum(seen)
        assert r["all"] == sum(d[3] or 0 for d in mine)
        assert r["last"] == (seen[-1] if seen else None)
        assert r["prior"] == (before[-1] if before else None)


@QUICK
@given(st.lists(reading, min_size=1, max_size=60))
def test_rolling_count(spark, readings):
    df = log(spark, readings)
    bad = [r for r in dicts(df) if r["status"] != "normal"]
    day = dt.timedelta(hours=24)
    expected = {
        r["event_id"]: sum(o["room_id"] == r["room_id"] and r["ts"] - day < o["ts"] <= r["ts"] for o in bad) for r in bad
    }
    assert {r["event_id"]: r["anomalies_in_span"] for r in dicts(state.rolling_anomalies(df))} == expected


def test_count_as_of(spark):
    df = log(spark, [("a", "temperature", 35, 0), ("a", "temperature", 35, 1), ("b", "temperature", 20, 1)])
    as_of = F.lit(START + dt.timedelta(hours=24))
    got = {r["room_id"]: r["anomalies_in_span"] for r in dicts(state.anomalies_as_of(df, as_of))}
    assert got == {"a": 1, "b": 0}


@QUICK
@given(st.lists(reading, min_size=1, max_size=40))
def test_images(spark, readings):
    df = log(spark, readings)
    rows = sorted(dicts(df), key=lambda r: (r["ts"], r["event_id"]))
    feed = {r["event_id"]: r for r in dicts(state.room_changes(df))}
    for i, r in enumerate(rows):
        image = feed[r["event_id"]]
        new = by_hand(rows[: i + 1])[r["room_id"]]
        old = by_hand(rows[:i]).get(r["room_id"])
        for side, expected in (("new_image", new), ("old_image", old)):
            got = image[side]
            assert (got is None) == (expected is None)
            if expected:
                assert got == {k: v for k, v in expected.items() if k != "name"}
        assert image["change"] == ("MODIFY" if old else "INSERT")


@QUICK
@given(st.lists(reading, min_size=1, max_size=60))
def test_episodes(spark, readings):
    df = log(spark, readings)
    expected = []
    keys = {(r["room_id"], r["sensor_type"]) for r in dicts(df)}
    for key in keys:
        run = None
        mine = sorted((r for r in dicts(df) if (r["room_id"], r["sensor_type"]) == key), key=lambda r: (r["ts"], r["event_id"]))
        for r in mine:
            if r["status"] == "normal":
                if run:
                    run["resolved"] = True
                run = None
                continue
            if run is None:
                run = {"key": key, "start": r["ts"], "n": 0, "severity": "warning", "resolved": False}
                expected.append(run)
            run["n"] += 1
            run["end"] = r["ts"]
            if r["status"] == "alert":
                run["severity"] = "critical"
    got = [
        {"key": (r["room_id"], r["alert_type"]), "start": r["timestamp"], "end": r["last_seen"], "n": r["readings"],
         "severity": r["severity"], "resolved": r["resolved"]}
        for r in dicts(alerts.alert_episodes(df))
    ]
    order = lambda r: (r["key"], r["start"], r["end"])
    assert sorted(got, key=order) == sorted(expected, key=order)


def test_offline_and_age(spark):
    df = log(spark, [("a", "temperature", 20, 0), ("b", "temperature", 35, 59), ("c", "motion", 1, 119.5)])
    rooms = state.mark_offline(state.fold_rooms(df), F.lit(at(120)))
    got = {r["room_id"]: (r["status"], r["age"]) for r in dicts(rooms)}
    assert got == {"a": ("offline", "2h ago"), "b": ("offline", "1h ago"), "c": ("active", "30s ago")}
    edge = state.mark_offline(state.fold_rooms(df), F.lit(at(60)))
    assert {r["room_id"]: r["status"] for r in dicts(edge)}["a"] == "active"


def test_utilisation(spark):
    df = log(spark, [("a", "occupancy", 5, 0), ("b", "occupancy", 5, 0), ("c", "occupancy", 5, 0)])
    dim = spark.createDataFrame([("a", "A", 1, 10), ("b", "B", 1, None), ("c", "C", 1, 0)], "room_id string, name string, floor int, capacity int")
    got = {r["room_id"]: r["utilisation"] for r in dicts(state.utilisation(state.fold_rooms(df), dim))}
    assert got == {"a": 0.5, "b": None, "c": None}
    assert dicts(state.name_rooms(state.fold_rooms(df), dim.limit(1)).orderBy("room_id"))[0]["name"] == "A"


def test_reads(spark):
    df = log(spark, [("a", "motion", 1, m) for m in range(120)] + [("b", "motion", 1, 500)])
    assert [r["ts"] for r in dicts(reads.events_of_room(df, "a"))] == [at(m) for m in range(120)]
    newest = dicts(reads.recent_of_room(df, "a", 3, F.lit(at(118))))
    assert [r["ts"] for r in newest] == [at(119), at(118)]
    assert dicts(reads.recent_global(df, 1))[0]["room_id"] == "b"
    assert reads.recent_per_key(df).groupBy("room_id").count().orderBy("room_id").collect() == [("a", 50), ("b", 1)]
    many = reads.recent_per_key(df, limit=1001)
    assert many.count() == 121 and dicts(many.filter("room_id = 'b'"))[0]["rank"] == 1
    rooms = spark.createDataFrame([("b", "B"), ("c", "C")], "room_id string, name string")
    assert reads.events_of_known_rooms(df, rooms).count() == 1
    assert dicts(reads.unknown_rooms(df, rooms)) == [{"room_id": "a", "events": 120}]
    details = {r["room_id"]: r for r in dicts(reads.room_details(rooms, df))}
    assert (details["b"]["event_count"], details["c"]["event_count"], details["c"]["recent_events"]) == (1, 0, [])


def test_group_limit_is_pushed_to_the_map_side(spark):
    df = log(spark, [("a", "motion", 1, 0)])
    plan = reads.recent_per_key(df.repartition(2))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_slices_never_decrease(spark):
    df = spark.createDataFrame([(at(m),) for m in (-90, -1, 0, 1, 59, 60, 61)], "ts timestamp")
    got = [r[0] for r in df.orderBy("ts").select(time_chunk(F.col("ts"), 3600)).collect()]
    assert got == sorted(got) and len(set(got)) == 4


def test_a_busy_room_is_spread_over_tasks(spark):
    rows = [("a" if i % 3 else f"r{i % 50}", "temperature", 20 + i % 20, i) for i in range(3000)]
    df = log(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        feed = state.room_changes(df).withColumn("_p", F.spark_partition_id())
        sizes = [r["count"] for r in feed.groupBy("_p").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 3000 and max(sizes) < 3000 * 0.4
