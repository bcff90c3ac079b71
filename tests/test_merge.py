"""Keyed tables: deltas, replays, compaction, and what is built on them."""

import random

import pytest
from helpers import at, dicts, event_row, events
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.operators import behavior, ingest, partials, state
from sensorloom.operators.records import collapse_events
from sensorloom.schema import EVENT_SCHEMA
from sensorloom.sources.log import read_log
from sensorloom.streaming import events as upserts
from sensorloom.streaming import ingest as ingest_stream
from sensorloom.streaming import sinks
from sensorloom.streaming.merge import MergeTable, summed

ONCE = {"availableNow": True}
SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def table(spark, path, every=16):
    return MergeTable(spark, str(path), SCHEMA, summed(["k"], "n"), every)


def counts(df):
    return {(r["part"], r["k"]): r["n"] for r in dicts(df)}


def put(spark, t, batch, *rows):
    t.put(spark.createDataFrame(list(rows), "part string, k string, n bigint"), batch)


def test_replays_count_once_before_and_after_compaction(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert counts(t.read()) == {}
    put(spark, t, 0, ("d1", "a", 1), ("d1", "b", 1))
    put(spark, t, 1, ("d1", "a", 2), ("d2", "a", 5))
    put(spark, t, 1, ("d1", "a", 2), ("d2", "a", 5))
    wanted = {("d1", "a"): 3, ("d1", "b"): 1, ("d2", "a"): 5}
    assert counts(t.read()) == wanted
    assert counts(t.read(before=1)) == {("d1", "a"): 1, ("d1", "b"): 1}
    assert counts(t.read(parts=["d2"])) == {("d2", "a"): 5}
    t.compact(1)
    assert counts(t.read()) == wanted and t.versions() == {"d1": 1, "d2": 1}
    put(spark, t, 1, ("d1", "a", 2), ("d2", "a", 5))  # the base already holds it
    put(spark, t, 2, ("d3", "c", 7))
    assert counts(t.read()) == wanted | {("d3", "c"): 7}
    t.compact(2)
    assert t.versions() == {"d1": 1, "d2": 1, "d3": 2}
    assert counts(t.read()) == wanted | {("d3", "c"): 7} and t.parts() == ["d1", "d2", "d3"]


def test_a_reader_keeps_its_files_through_a_compaction(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    put(spark, t, 0, ("d", "a", 1))
    t.compact(0)
    put(spark, t, 1, ("d", "a", 1))
    started = t.read()
    t.compact(1)
    put(spark, t, 2, ("d", "a", 1))
    assert counts(started) == {("d", "a"): 2}
    assert counts(t.read()) == {("d", "a"): 3}


def test_any_batching_and_compaction_gives_the_same_sums(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"d{rng.randrange(3)}", f"k{rng.randrange(4)}", rng.randrange(9)) for _ in range(60)]
    wanted = {}
    for part, k, n in rows:
        wanted[part, k] = wanted.get((part, k), 0) + n
    t = table(spark, tmp_path / "t", every=3)
    for batch in range(8):
        t.maybe_compact(batch)
        put(spark, t, batch, *rows[batch::8])
    assert t.versions() and counts(t.read()) == wanted


def test_a_written_batch_touches_its_own_keys_only(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    put(spark, t, 0, *[("d", f"k{i}", 1) for i in range(500)])
    put(spark, t, 1, ("d", "k1", 1))
    written = spark.read.parquet(str(tmp_path / "t" / "delta")).groupBy("batch").count()
    assert {r["batch"]: r["count"] for r in dicts(written)} == {0: 500, 1: 1}


def alerts(*names):
    return [event_row(n, "a", "temperature", 35, int(n)) for n in names]


def rooms_now(spark, root):
    ingest_stream.start_rooms(spark, root, **ONCE).awaitTermination()
    return {r["room_id"]: r["alert_count_24h"] for r in dicts(sinks.StateTable(spark, f"{root}/rooms", ["room_id"]).read())}


def test_a_replayed_batch_counts_once_in_rooms(spark, tmp_path):
    root = str(tmp_path)
    log = sinks.LogTable(spark, f"{root}/log")
    log.create()
    rows = ingest.accepted_log(events(spark, alerts("1", "2", "3")))
    assert log.append(rows, 0) == 3
    assert rooms_now(spark, root) == {"a": 3}
    assert log.append(rows, 0) == 3
    assert rooms_now(spark, root) == {"a": 3}
    assert log.append(ingest.accepted_log(events(spark, alerts("3", "4"))), 1) == 1
    assert rooms_now(spark, root) == {"a": 4}
    assert read_log(spark, f"{root}/log").count() == 4


def test_files_without_a_commit_are_not_read_downstream(spark, tmp_path):
    """A crash after the write and before the commit; then the batch is run again."""
    root = str(tmp_path)
    log = sinks.LogTable(spark, f"{root}/log")
    log.create()
    log.append(ingest.accepted_log(events(spark, alerts("1"))), 0)
    assert rooms_now(spark, root) == {"a": 1}
    rows = ingest.accepted_log(events(spark, alerts("2", "3")))
    stopped = sinks.LogTable(spark, f"{root}/log")
    stopped.commits = f"{root}/nowhere"
    stopped.append(rows, 1)
    assert rooms_now(spark, root) == {"a": 1}
    log.append(rows, 1)
    assert rooms_now(spark, root) == {"a": 3}


def test_room_partials_are_compacted_in_order(spark, tmp_path):
    root = str(tmp_path)
    log = sinks.LogTable(spark, f"{root}/log")
    log.create()
    for i in range(3):
        log.append(ingest.accepted_log(events(spark, alerts(str(i + 1)))), i)
    rooms = ingest_stream.RoomTable(spark, f"{root}/rooms", log)
    rooms.parts.compact_every = 1
    late = log.stats().where("batch <> 1")  # the second commit is listed last
    rooms.take(late, 0)
    assert rooms.parts.versions() == {"all": 0}
    rooms.take(log.stats().where("batch = 1"), 1)
    assert rooms.parts.versions() == {"all": 2}
    assert [r["alert_count_24h"] for r in dicts(rooms.rooms.read())] == [3]


def test_parts_of_rooms_give_the_fold(spark):
    rng = random.Random(1)
    kinds = ("temperature", "humidity", "occupancy", "motion")
    rows = [event_row(str(i), rng.choice("abc"), rng.choice(kinds), rng.randrange(40), rng.randrange(90)) for i in range(200)]
    log = ingest.accepted_log(events(spark, rows))
    cut = F.crc32(F.col("event_id").cast("binary")) % 5
    parts = partials.room_parts(log.withColumn("cut", cut), keys=("room_id", "cut")).withColumn("part", F.lit("all"))
    got = partials.rooms_of_parts(partials.merge_room_parts(parts))
    assert sorted(map(str, dicts(got))) == sorted(map(str, dicts(state.fold_rooms(log))))


def test_moments_add_up_without_cancellation(spark, tmp_path):
    rng = random.Random(2)
    rows = [("a", 1e9 + rng.random()) for _ in range(300)] + [("b", 3.0), ("c", None)]
    frame = spark.createDataFrame(rows, "k string, value double").withColumn("cut", F.abs(F.hash("value")) % 7)
    fold = partials.merge_moments(["k"])
    parts = partials.moments(frame, ["k", "cut"]).withColumn("part", F.lit("all"))
    got = {r["k"]: r for r in dicts(partials.baselines_of_moments(fold(parts), ["k"]))}
    whole = {r["k"]: r for r in dicts(behavior.baselines(frame.where("value is not null"), ["k"]))}
    assert got.keys() == {"a", "b"} and got["b"]["sd"] is None and got["b"]["n"] == 1
    assert got["a"]["sd"] == pytest.approx(whole["a"]["sd"], rel=1e-6) and got["a"]["mean"] == pytest.approx(whole["a"]["mean"])


def test_event_table_keeps_last_writes(spark, tmp_path):
    rng = random.Random(3)
    t = upserts.EventTable(spark, str(tmp_path / "t"))
    sent = []
    for batch in range(6):
        rows = [event_row(f"{batch}-{i}", rng.choice("ab"), "humidity", rng.randrange(99), 60 * 24 * rng.randrange(3)) for i in range(8)]
        t.table.compact_every = 2
        t.take(events(spark, rows), batch)
        sent += [(*r, batch) for r in rows]
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("batch", T.LongType())])
    wanted = collapse_events(spark.createDataFrame(sent, schema), ("room_id", "ts"), ("batch", "event_id")).drop("batch")
    assert t.table.versions()
    assert sorted(map(str, dicts(t.read()))) == sorted(map(str, dicts(wanted)))
    day = wanted.where(F.to_date("ts") == F.to_date(F.lit(at(60 * 24))))
    assert sorted(map(str, dicts(t.read("2026-01-16", "2026-01-16")))) == sorted(map(str, dicts(day)))


def test_upserts_as_a_stream(spark, tmp_path):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for value in (1, 2, 3):
        events(spark, [event_row("x", "a", "humidity", value, 0), event_row(f"y{value}", "a", "humidity", value, value)]).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
        upserts.start_upserts(spark, stream, root, **ONCE).awaitTermination()
    rows = dicts(upserts.EventTable(spark, f"{root}/events").read())
    assert sorted((r["event_id"], r["value"]) for r in rows) == [("x", 3), ("y1", 1), ("y2", 2), ("y3", 3)]


@pytest.mark.parametrize("batches", [1, 4, 12])
def test_the_log_does_not_depend_on_batches(spark, tmp_path, batches):
    """Copies, and ids that are used again at another time or for another value."""
    rows = [event_row(str(i), "a", "humidity", i, i) for i in range(20)]
    rows += rows[:10] + [event_row(str(i), "a", "humidity", i, i + 180) for i in range(5)] + [event_row("7", "a", "humidity", 50, 7)]
    log = sinks.LogTable(spark, str(tmp_path / "log"))
    log.create()
    random.Random(batches).shuffle(rows)
    for i in range(batches):
        if rows[i::batches]:
            log.append(ingest.accepted_log(events(spark, rows[i::batches])), i)
    got = sorted((r["event_id"], r["value"], r["ts"]) for r in dicts(read_log(spark, log.path)))
    assert got == sorted({(r[0], r[3], r[5]) for r in rows}) and len(got) == 26
    stats = log.stats().agg(*(F.sum(c).alias(c) for c in ("total", "stored", "rejected", "duplicates"))).first()
    assert tuple(stats) == (36, 26, 0, 10)


PATTERNS = "room_id string, pattern_type string, valid_from timestamp, valid_until timestamp, note string"


def test_readings_meet_the_patterns_in_force(spark):
    rng = random.Random(6)
    hour = 60
    patterns = [
        ("a", "open", at(-90 * 24 * hour), None, "x"), ("a", "long", at(-4000 * 24 * hour), at(4000 * 24 * hour), "x"), ("a", "short", at(0), at(30), "x"),
        ("a", "never", at(10), at(10), "x"), ("a", "backwards", at(50), at(-50), "x"), ("b", "later", at(10_000 * hour), None, "x"), ("z", "other", at(-1), None, "x"),
        ("a", "no start", None, at(5), "x"),
    ]
    patterns += [("b", f"p{i}", at(s := rng.randrange(-5000, 5000)), at(s + rng.randrange(1, 40_000)), "x") for i in range(20)]
    readings = [(str(i), rng.choice("abc"), at(rng.randrange(-20_000, 20_000))) for i in range(300)] + [("e", "a", at(30)), ("s", "a", at(0)), ("n", None, at(0)), ("t", "a", None)]
    log = spark.createDataFrame(readings, "event_id string, room_id string, ts timestamp")
    found = behavior.with_pattern_in_force(log, spark.createDataFrame(patterns, PATTERNS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wanted = []
    for name, room, ts in readings:
        held = [p[1] for p in patterns if ts and p[2] and p[0] == room and p[2] <= ts and (p[3] is None or p[3] > ts)]
        wanted += [(name, p) for p in held or [None]]
    assert sorted(((r["event_id"], r["pattern_type"]) for r in dicts(found)), key=str) == sorted(wanted, key=str)
    assert behavior.with_pattern_in_force(log.limit(0), spark.createDataFrame(patterns, PATTERNS)).count() == 0
