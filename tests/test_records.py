"""Stored forms, upserts and patches."""

import json
from decimal import Decimal

from helpers import START, at, dicts, event_row, events
from pyspark.sql import functions as F

from sensorloom.operators import records
from sensorloom.schema import ROOM_SCHEMA
from sensorloom.sources.log import read_log, write_log


def rooms(spark):
    return spark.createDataFrame(
        [
            ("a", "Room a", "alert", START, (21.5, True, None, 40.0), 3),
            ("b", "Room b", "active", at(0.5 / 60), (None, None, None, None), 0),
            ("c", "Room c", "active", at(1), (None, False, 4, None), 1),
        ],
        ROOM_SCHEMA,
    )


def test_event_record(spark):
    df = events(spark, [event_row("e", "a", "temperature", 21.7, 0, "°C", "normal")])
    assert dicts(records.event_records(df)) == [
        {"room_id": "a", "timestamp": "2026-01-15T12:00:00+00:00", "event_id": "e", "sensor_type": "temperature",
         "value": "21.7", "unit": "°C", "status": "normal"}
    ]


def test_event_values_are_exact_whatever_their_size(spark):
    values = [1e-12, 1e30, 0.1234567890123456, 12345678901234567.0, -0.0, 5e-324]
    df = events(spark, [event_row(str(i), "a", "temperature", v, i) for i, v in enumerate(values)])
    stored = {r["event_id"]: r["value"] for r in dicts(records.event_records(df))}
    assert [float(Decimal(stored[str(i)])) for i in range(len(values))] == values


def test_room_round_trip(spark):
    stored = records.room_records(rooms(spark))
    got = {r["room_id"]: r for r in dicts(stored)}
    assert got["a"]["current_state"] == {"temperature": "21.5", "motion": "true", "humidity": "40.0"}
    assert got["b"]["current_state"] == {} and got["b"]["last_update"] == "2026-01-15T12:00:00.500000+00:00"
    assert sorted(records.rooms_from_records(stored).collect()) == sorted(rooms(spark).collect())


def test_missing_state_and_count(spark):
    bare = records.room_records(rooms(spark)).withColumns(
        {"current_state": F.lit(None).cast("map<string,string>"), "alert_count_24h": F.lit(None).cast("bigint")}
    )
    back = dicts(records.rooms_from_records(bare))[0]
    assert back["alert_count_24h"] == 0 and set(back["current_state"].values()) == {None}


def test_collapse_keeps_the_last_put(spark):
    df = events(spark, [event_row(str(i), "a", s, i, 0) for i, s in enumerate(["motion", "humidity", "occupancy"])])
    many = df.unionByName(df).unionByName(df)
    assert dicts(records.collapse_events(many)) == dicts(df.filter("event_id = '2'"))


def test_upsert(spark):
    new = rooms(spark).filter("room_id = 'a'").withColumn("status", F.lit("active"))
    new = new.unionByName(new.withColumn("room_id", F.lit("d")))
    got = {r["room_id"]: r["status"] for r in dicts(records.upsert(rooms(spark), new, "room_id"))}
    assert got == {"a": "active", "b": "active", "c": "active", "d": "active"}
    twice = new.unionByName(new.withColumns({"last_update": F.lit(at(5)), "status": F.lit("warning")}))
    last = records.upsert(rooms(spark), twice, "room_id", order=("last_update",))
    assert {r["room_id"]: r["status"] for r in dicts(last)}["a"] == "warning" and last.count() == 4


def test_patch(spark):
    patches = spark.createDataFrame(
        [("a", "temperature", 1.0, at(3)), ("a", "temperature", 2.0, at(2)), ("c", "occupancy", 7.9, at(4)),
         ("a", "co2", 9.0, at(9)), ("z", "temperature", 5.0, at(1))],
        "room_id string, sensor_type string, value double, at timestamp",
    )
    got = {r["room_id"]: r for r in dicts(records.patch_rooms(rooms(spark), patches))}
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["current_state"] == {"temperature": 1.0, "motion": True, "occupancy": None, "humidity": 40.0}
    assert (got["a"]["last_update"], got["b"]["last_update"]) == (at(3), at(0.5 / 60))
    assert got["c"]["current_state"]["occupancy"] == 7 and got["c"]["status"] == "active"
    assert [r["room_id"] for r in dicts(records.unmatched_patches(rooms(spark), patches))] == ["z"]


def test_json_rows(spark):
    got = sorted(r["json"] for r in dicts(records.json_rows(rooms(spark))))
    first = json.loads(got[0])
    assert first["current_state"] == {"temperature": 21.5, "motion": True, "humidity": 40.0}
    assert first["last_update"] == "2026-01-15T12:00:00+00:00"


def test_log_is_pruned_by_date_and_pushed_down(spark, tmp_path):
    rows = [event_row(str(m), "a", "motion", 1, m * 60 * 24) for m in range(5)]
    path = str(tmp_path / "log")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    write_log(events(spark, rows), path)
    part = read_log(spark, path, start="2026-01-17T00:00:00Z", end="2026-01-18T12:00:00Z")
    assert sorted(r["event_id"] for r in dicts(part)) == ["2", "3"]
    plan = part.filter("room_id = 'a'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "EqualTo(room_id,a)" in plan and "GreaterThanOrEqual(ts" in plan and "value" not in plan.split("ReadSchema")[1]


def rows_scanned(df):
    """Rows that the parquet scan of a plan gives out: those of the pages and row groups it opened."""
    execution = df.select("*")._jdf.queryExecution()  # a run of its own: metrics add up
    execution.executedPlan().executeCollect()
    leaf = execution.executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_point_reads_open_few_pages(spark, tmp_path):
    path, batches, rooms_of_log, each = str(tmp_path / "log"), 4, 2000, 20
    n = rooms_of_log * each
    numbers = spark.range(n).selectExpr(
        "md5(cast(id as string)) as event_id", f"concat('room-', lpad(id % {rooms_of_log}, 5, '0')) as room_id", "'motion' as sensor_type",
        "double(id) as value", "'bool' as unit", f"timestamp'2026-01-15' + make_interval(0, 0, 0, 0, 0, 0, id div {rooms_of_log}) as ts",
        "'normal' as status", "id",
    )
    for batch in range(batches):
        write_log(numbers.where(F.col("id") % batches == batch).drop("id"), path)
    log = read_log(spark, path)
    assert log.count() == n

    # Rooms interleave in time and come in every fourth number, so one batch holds a room; its names span all files.
    room = log.where("room_id = 'room-00777'")
    assert room.count() == each
    assert rows_scanned(room) <= 2 * 2000 < n / batches

    event = log.where(F.col("event_id") == F.md5(F.lit("12345")))
    assert [r["value"] for r in dicts(event)] == [12345.0]
    assert rows_scanned(event) <= n / batches
    missing = log.where(F.col("event_id") == F.md5(F.lit("no such event")))
    assert rows_scanned(missing) <= n / batches  # a filter errs for one id in a hundred
