"""Streams give what the batch gives, also over several batches, restarts and failures."""

import pytest
from helpers import at, dicts, event_row, events
from pyspark.sql import functions as F

from sensorloom.operators import devices, ingest, state
from sensorloom.operators.classify import classify
from sensorloom.plans import streams
from sensorloom.schema import EVENT_SCHEMA
from sensorloom.sources.log import read_log
from sensorloom.sources.raw import read_bodies, read_events
from sensorloom.streaming import admission, sinks, timers
from sensorloom.streaming import ingest as ingest_stream
from sensorloom.streaming.sinks import StateTable

ONCE = {"availableNow": True}

ROWS = [
    event_row("1", "a", "temperature", 35, 0), event_row("2", "b", "humidity", 50, 1),
    event_row("3", "a", "noise", 1, 2), event_row("4", "a", "temperature", 27, 3),
    event_row("5", "a", "motion", 1, 4), event_row("5", "a", "motion", 1, 4),
    event_row("6", "b", "humidity", 85, 5), event_row("7", "c", "occupancy", 3.7, 6),
]


def source(spark, folder, rows):
    """Add one parquet file per call; the stream reads a file a batch."""
    events(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    return stream(spark, folder)


def stream(spark, folder):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(running):
    for q in running.all():
        q.awaitTermination()


def expected_rooms(spark, rows):
    return sorted(map(str, dicts(state.fold_rooms(ingest.drop_retries(ingest.accepted_log(events(spark, rows)))))))


def rooms(spark, root):
    return sorted(map(str, dicts(StateTable(spark, f"{root}/rooms", ["room_id"]).read())))


def test_ingest_over_batches_and_restarts(spark, tmp_path):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    source(spark, folder, ROWS[:3])
    # The log has to exist before it is read as a stream.
    finish(ingest_stream.start(spark, source(spark, folder, ROWS[3:6]), root, **ONCE))
    ingest_stream.start_rooms(spark, root, **ONCE).awaitTermination()
    assert rooms(spark, root) == expected_rooms(spark, ROWS[:6])
    # New files, all queries started again from their checkpoints.
    finish(ingest_stream.start(spark, source(spark, folder, ROWS[6:]), root, **ONCE))
    ingest_stream.start_rooms(spark, root, **ONCE).awaitTermination()
    assert rooms(spark, root) == expected_rooms(spark, ROWS)
    log = spark.read.parquet(f"{root}/log")
    assert sorted(r["event_id"] for r in dicts(log)) == ["1", "2", "4", "5", "6", "7"]
    assert [r["event_id"] for r in dicts(spark.read.parquet(f"{root}/rejects"))] == ["3"]


def test_late_readings_reach_the_log(spark, tmp_path):
    """12:00, 13:00, 09:00 and 14:00, and the 09:00 one again: one batch each, restarted in between."""
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    for name, minute in (("1", 0), ("2", 60), ("3", -180), ("4", 120), ("3", -180)):
        rows = [event_row(name, "a", "temperature", 20, minute), event_row(f"bad{name}", "a", "noise", 1, minute)]
        source(spark, folder, rows)
        ingest_stream.ingest_log(spark, stream(spark, folder), f"{root}/log", f"{root}/ck", **ONCE).awaitTermination()
    table = sinks.LogTable(spark, f"{root}/log")
    assert sorted(r["event_id"] for r in dicts(read_log(spark, f"{root}/log"))) == ["1", "2", "3", "4"]
    stats = table.stats().agg(*(F.sum(c).alias(c) for c in ("total", "accepted", "rejected", "duplicates"))).first()
    assert tuple(stats) == (10, 5, 5, 1) and stats.total == 4 + stats.rejected + stats.duplicates
    table.compact("2026-01-15")
    assert sorted(r["event_id"] for r in dicts(read_log(spark, f"{root}/log"))) == ["1", "2", "3", "4"]


def test_counts_fall_back_without_anomalies(spark, tmp_path):
    folder = str(tmp_path / "in")
    for hour, value in ((0, 35), (30, 20), (60, 20), (90, 20)):
        src = source(spark, folder, [event_row(f"{hour}", "a", "temperature", value, hour * 60)])
    with timers.rocksdb(spark):
        counts = timers.rolling_counts(classify(ingest_stream.timed(src)))
        sinks.append_rows(counts, str(tmp_path / "o"), str(tmp_path / "c"), **ONCE).awaitTermination()
    got = [(r["at"], r["anomalies_in_span"]) for r in dicts(spark.read.parquet(str(tmp_path / "o")))]
    assert sorted(got) == [(at(1), 1), (at(24 * 60 + 1), 0)]


def test_room_failure_does_not_stop_events(spark, tmp_path, monkeypatch):
    root, folder = str(tmp_path / "out"), str(tmp_path / "in")
    ingest_stream.ingest_log(spark, source(spark, folder, ROWS), f"{root}/log", f"{root}/checkpoints/log", **ONCE).awaitTermination()

    def broken(self, changed, batch_id):
        raise RuntimeError("store is away")

    monkeypatch.setattr(StateTable, "merge", broken)
    with pytest.raises(Exception, match="store is away"):
        ingest_stream.start_rooms(spark, root, **ONCE).awaitTermination()
    assert spark.read.parquet(f"{root}/log").count() == 6
    monkeypatch.undo()
    ingest_stream.start_rooms(spark, root, **ONCE).awaitTermination()
    assert rooms(spark, root) == expected_rooms(spark, ROWS)


def test_state_table_replay(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["k"])
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert table.read() is None
    table.merge(frame(("a", 1), ("b", 1)), 0)
    table.merge(frame(("b", 2), ("c", 2)), 1)
    table.merge(frame(("b", 2), ("c", 2)), 1)
    table.merge(frame(("a", 3)), 2)
    assert sorted(table.read().collect()) == [("a", 3), ("b", 2), ("c", 2)]
    assert table.versions() == [1, 2]


def test_ingest_counts_are_observed(spark, tmp_path):
    readings = source(spark, str(tmp_path / "in"), ROWS)
    query = sinks.append_rows(ingest_stream.observed(readings), str(tmp_path / "o"), str(tmp_path / "c"), **ONCE)
    query.awaitTermination()
    seen = [p["observedMetrics"]["ingest"] for p in query.recentProgress if "ingest" in p["observedMetrics"]]
    assert [sum(m[k] for m in seen) for k in ("total", "accepted", "rejected")] == [8, 7, 1]


def test_rolling_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([0, 0.5, 30], [60 * 20], [60 * 24 + 10], [60 * 60]):
        rows = [event_row(f"{m}", "a", "temperature", 35, m) for m in part]
        src = source(spark, folder, rows + [event_row(f"q{part[0]}", "z", "temperature", 35, part[0])])
    with timers.rocksdb(spark):
        log = classify(ingest_stream.timed(src))
        counts = timers.rolling_counts(log)
        sinks.append_rows(counts, str(tmp_path / "o"), str(tmp_path / "c"), **ONCE).awaitTermination()
    got = {r["at"]: r["anomalies_in_span"] for r in dicts(spark.read.parquet(str(tmp_path / "o"))) if r["room_id"] == "a"}
    day = 60 * 24
    assert got == {
        at(1): 2, at(31): 3, at(60 * 20 + 1): 4, at(day + 1): 2, at(day + 11): 3, at(day + 31): 2,
        at(60 * 20 + 1 + day): 1, at(2 * day + 11): 0,
    }


def test_silence(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([0, 30, 55], [200, 210], [1000]):
        rows = [event_row(f"a{m}", "a", "motion", 1, m) for m in part] + [event_row(f"b{part[0]}", "b", "motion", 1, part[0])]
        src = source(spark, folder, rows)
    with timers.rocksdb(spark):
        found = timers.silent_rooms(ingest_stream.timed(src))
        sinks.append_rows(found, str(tmp_path / "o"), str(tmp_path / "c"), **ONCE).awaitTermination()
    got = sorted((r["at"], r["status"]) for r in dicts(spark.read.parquet(str(tmp_path / "o"))) if r["room_id"] == "a")
    assert got == [(at(116), "offline"), (at(201), "active"), (at(271), "offline")]


def test_admission_over_batches(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "message_id string, device_id bigint, ts timestamp"
    sent = [("m1", 1, at(0)), ("m2", 1, at(1)), ("m3", 2, at(1)), ("m4", 1, at(2)), ("m5", 2, at(3)), ("m6", 1, at(61))]
    for part in (sent[:2], sent[2:4], sent[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        admission.start_admission(spark, src, root, 2, **ONCE).awaitTermination()
    got = {r["message_id"]: (r["number"], r["admitted"]) for r in dicts(spark.read.parquet(f"{root}/decisions"))}
    batch = devices.admission(spark.createDataFrame(sent, schema), 2)
    assert got == {r["message_id"]: (r["number"], r["admitted"]) for r in dicts(batch)}


def test_wrong_clocks_and_late_messages_keep_their_counters(spark, tmp_path):
    """Limit 2: device 1 sends two, device 9 one dated next year, device 1 two more in its hour, one a day late."""
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "message_id string, device_id bigint, ts timestamp"
    parts = [[("m1", 1, at(0)), ("m2", 1, at(1))], [("m3", 9, at(60 * 24 * 365))], [("m4", 1, at(2)), ("m5", 1, at(3))], [("m6", 1, at(60 * 24))], [("m7", 1, at(4))]]
    limits = spark.createDataFrame([(1, 2), (7, None)], "device_id bigint, limit int")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        admission.start_admission(spark, src, root, limits, **ONCE).awaitTermination()
    got = {r["message_id"]: (r["number"], r["admitted"]) for r in dicts(spark.read.parquet(f"{root}/decisions"))}
    assert got == {"m1": (1, True), "m2": (2, True), "m3": (1, True), "m4": (3, False), "m5": (4, False), "m6": (1, True), "m7": (5, False)}


def test_sources_read_as_streams(spark, tmp_path):
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies" / "1.json").write_text('{"room_id":"a"}\n{}\n')
    bodies = read_bodies(spark, str(tmp_path / "bodies"), stream=True)
    sinks.append_rows(bodies, str(tmp_path / "o"), str(tmp_path / "c"), **ONCE).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    typed = read_events(spark, str(tmp_path / "bodies"), "json")
    assert typed.schema == EVENT_SCHEMA and typed.filter(F.col("room_id") == "a").count() == 1


def test_batches_by_arrival_come_in_several_files(spark, tmp_path):
    """One task wrote each batch and one file held it, so nothing before the first shuffle ran on more than one core."""
    rows = streams.spread(spark.range(1000).withColumn("at", F.timestamp_seconds(F.col("id") * 60)))
    sizes, tasks = {}, {}

    def look(batch, batch_id):
        files = batch.select("id", F.input_file_name().alias("f"))
        sizes[batch_id] = sorted(r.id for r in batch.collect())
        tasks[batch_id] = files.select("f").distinct().count()

    for come in streams.by_arrival(spark, rows, streams.run_of_times(rows, F.col("at")), "test"):
        sinks.each_batch(come, look, str(tmp_path / "checkpoint"), "append", **ONCE).awaitTermination()
    low, high = 0, 999
    cuts = [low + (high - low) * i / 4 for i in range(5)]
    assert sizes == {i: [n for n in range(1000) if cuts[i] <= n and (n < cuts[i + 1] or i == 3)] for i in range(4)}
    assert min(tasks.values()) > 1


def test_unknown_rows_by_one_grouping(spark):
    kind = "event_id string, ts int, unit string, value double"
    new = [("1", 1, None, 1.0), ("1", 1, None, 1.0), ("2", 1, None, 2.0), ("3", 1, "C", 0.0), ("3", 2, "C", 0.0), ("4", 1, None, float("nan"))]
    known = [("2", 1, None, 2.0), ("3", 1, None, 0.0), ("3", 2, "C", -0.0), ("4", 1, None, float("nan")), ("5", 1, None, 5.0)]
    found = sinks.unknown(spark.createDataFrame(new, kind), spark.createDataFrame(known, kind))
    assert sorted(map(tuple, found.collect()), key=str) == [("1", 1, None, 1.0), ("3", 1, "C", 0.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Aggregate") == 1


def test_late_readings_are_sent_from_one_scan(spark, tmp_path):
    frame = spark.range(70).selectExpr("id AS event_id", "TIMESTAMP_NTZ'2024-01-01' AS ts", "id AS user_id", "'view' AS event_type", "1.5D AS value", "'' AS props")
    frame.write.parquet(f"{tmp_path}/events")
    sent = streams.arrivals(spark.read.parquet(f"{tmp_path}/events"))
    hours = {(int(r.event_id), (r._arrival - r.ts).total_seconds() / 3600) for r in sent.collect()}
    assert hours == {(i, 72 if i % 7 == 0 else 0) for i in range(70)} | {(i, 100) for i in range(0, 70, 5)}
    assert sent._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
