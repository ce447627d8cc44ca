"""Streams over small files: source, state machines, late rows and registration."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomframe.streaming import events, machines, sinks

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def session(spark):
    return sinks.state_session(spark)


def files(session, folder, schema, batches):
    """One parquet file per batch; read one file per trigger, in order."""
    for i, rows in enumerate(batches):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(
            f"{folder}/in/{i:03d}"
        )
    return (
        session.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(f"{folder}/in")
    )


def run(spark, stream, folder):
    query = sinks.run_to_table(stream, f"{folder}/out")
    return query, spark.read.parquet(f"{folder}/out/rows")


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_event_lines(session, spark, tmp_path):
    good = {"event": "stage_failed", "stage": "probe", "job_id": "j", "duration_ms": 5, "error": "E", "ts": "2024-01-01T00:00:00Z"}
    lines = [json.dumps(good), "{broken", json.dumps({**good, "event": "other"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    stream = events.stream_stage_events(session, str(tmp_path / "in"))
    _, rows = run(spark, stream, tmp_path)
    got = {r.reason: r for r in rows.collect()}
    assert set(got) == {None, "malformed", "unknown_event"}
    assert got[None].duration_ms == 5 and got[None].line is None
    assert got["malformed"].line == "{broken"


JOBS = "job_id BIGINT, event_id BIGINT, ts TIMESTAMP, status STRING"


def test_job_lease_timers(session, spark, tmp_path):
    # Job 1 runs out of its lease while the stream goes on; job 2 ends in time; job 3
    # claims three times; the last batch only moves the watermark.
    first = [
        (1, 1, at(0), "created"), (1, 2, at(1), "queued"), (1, 3, at(2), "processing"),
        (2, 4, at(0), "queued"), (2, 5, at(1), "processing"), (2, 6, at(5), "completed"),
        (2, 7, at(6), "queued"),
    ]
    second = [(3, 10 + i, at(20 + 15 * i), s) for i, s in enumerate(["queued"] + ["processing"] * 3)]
    last = [(9, 99, at(500), "created")]
    stream = files(session, tmp_path, JOBS, [first, second, last])
    _, rows = run(spark, machines.stream_jobs(stream, "1 minute"), tmp_path)
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.ts_us, r.event_id or 0)):
        got.setdefault(r.job_id, []).append((r.verdict, r.after, r.attempt))
    assert got[1] == [
        ("initial", "created", 0), ("legal", "queued", 0), ("legal", "processing", 1),
        ("lease_expired", "queued", 1),
    ]
    assert got[2][-2:] == [("legal", "completed", 1), ("illegal", "completed", 1)]
    assert got[3] == [
        ("initial", "queued", 0), ("legal", "processing", 1), ("lease_expired", "queued", 1),
        ("legal", "processing", 2), ("lease_expired", "queued", 2), ("legal", "processing", 3),
        ("lease_expired", "failed", 3),
    ]


def test_delivery_machine_over_batches(session, spark, tmp_path):
    schema = "job_id BIGINT, artifact_id BIGINT, event_id BIGINT, ts TIMESTAMP, state STRING"
    steps = {
        1: ["intent", "sent", "intent", "sent"],
        2: ["intent", "failed", "intent", "failed", "intent", "failed", "intent", "terminal", "intent"],
        3: ["intent", "intent", "sent"],
        4: ["sent"],
    }
    rows = [
        (1, a, 100 * a + i, at(i), s) for a, states in steps.items() for i, s in enumerate(states)
    ]
    batches = [[r for r in rows if r[3] < at(2)], [r for r in rows if r[3] >= at(2)]]
    stream = files(session, tmp_path, schema, batches)
    _, out = run(spark, machines.stream_deliveries(stream), tmp_path)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.event_id):
        got.setdefault(r.artifact_id, []).append(r.verdict)
    assert got[1] == ["send", "sent", "skip_sent", "illegal"]
    assert got[2] == [
        "send", "failed", "retry", "failed", "retry", "failed", "give_up", "terminal", "give_up",
    ]
    assert got[3] == ["send", "hold", "illegal"]
    assert got[4] == ["no_intent"]


STAGES = "event STRING, stage STRING, job_id STRING, ts TIMESTAMP"


def test_late_rows_are_dropped_and_counted(session, spark, tmp_path):
    batches = [
        [("stage_completed", "s", "a", at(1)), ("stage_failed", "s", "b", at(2))],
        [("stage_completed", "s", "c", at(100))],
        # The watermark of one batch makes rows late from the batch after the next.
        [("stage_completed", "s", "c", at(101))],
        [("stage_completed", "s", "d", at(3))],
        [("stage_completed", "s", "e", at(300))],
    ]
    stream = files(session, tmp_path, STAGES, batches)
    query, rows = run(spark, events.stream_stage_rates(stream, "5 minutes", "10 minutes"), tmp_path)
    got = sorted((r.window_start, r.ended, r.failed) for r in rows.collect())
    assert [g[1:] for g in got] == [(2, 1), (2, 0)]
    assert events.late_rows(query) == 1


def test_unfinished_stages_end_null(session, spark, tmp_path):
    batches = [
        [("stage_started", "s", "a", at(0)), ("stage_completed", "s", "a", at(4))],
        [("stage_started", "s", "b", at(5))],
        [("stage_started", "s", "z", at(500)), ("stage_completed", "s", "y", at(500))],
        [("stage_started", "s", "z", at(900)), ("stage_completed", "s", "y", at(900))],
    ]
    stream = files(session, tmp_path, STAGES, batches)
    _, rows = run(spark, events.stream_stage_durations(stream, "1 minute", "1 hour"), tmp_path)
    got = {r.job_id: (r.outcome, r.duration_ms) for r in rows.collect() if r.started_at < at(400)}
    assert got == {"a": ("stage_completed", 240_000), "b": (None, None)}


def test_dedup_keeps_rows_without_a_key(session, spark, tmp_path):
    schema = "submitted_by INT, source_message_id INT, ts TIMESTAMP"
    batches = [[(1, 5, at(0)), (1, None, at(0)), (1, None, at(1))], [(1, 5, at(2)), (2, 5, at(2))]]
    stream = files(session, tmp_path, schema, batches)
    _, rows = run(spark, events.stream_dedup(stream, "10 minutes"), tmp_path)
    got = sorted(((r.submitted_by, r.source_message_id) for r in rows.collect()), key=repr)
    assert got == [(1, 5), (1, None), (1, None), (2, 5)]


def test_registering_a_batch_again_changes_nothing(spark, tmp_path):
    schema = (
        "job_id INT, type STRING, storage_path STRING, sha256 STRING, size_bytes INT, "
        "mime_type STRING, created_at INT"
    )
    registry = str(tmp_path / "registry")
    first = spark.createDataFrame([(1, "g", "p", "a", 1, "m", 1), (1, "g", "p", "b", 1, "m", 2)], schema)
    second = spark.createDataFrame([(1, "g", "p", "c", 1, "m", 3), (2, "g", "p", "d", 1, "m", 4)], schema)
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0)):
        sinks.register_batch(batch, number, registry, ["created_at"])
    inserts = spark.read.parquet(f"{registry}/inserts")
    conflicts = spark.read.parquet(f"{registry}/conflicts")
    assert sorted((r.job_id, r.sha256, r.batch_id) for r in inserts.collect()) == [(1, "a", 0), (2, "d", 1)]
    assert sorted((r.sha256, r.registered_sha256) for r in conflicts.collect()) == [("b", "a"), ("c", "a")]


def test_stages_by_sliding_window(session, spark, tmp_path):
    rows = [("stage_failed", "s", "a", at(7)), ("stage_completed", "s", "b", at(400))]
    stream = files(session, tmp_path, STAGES, [rows])
    rates = events.stream_stage_rates(stream, "1 minute", "10 minutes", "5 minutes")
    _, out = run(spark, rates.withColumn("n", F.col("ended")), tmp_path)
    assert out.count() == 2 and {r.failure_rate for r in out.collect()} == {1.0}


def test_unfinished_stages_are_a_query(spark):
    from loomframe.plans import stream_plans
    from tests.compare import compare, connect

    folder, name = "/root/testdata/sf0.001", "stream_stage_unfinished"
    build, sql = stream_plans.QUERIES[name], stream_plans.ORACLES[name]
    status, rows, _ = compare(spark, connect(folder), folder, name, build, sql)
    assert status == "ok" and rows > 0


def _log(seed, keys, n, values, make):
    import random

    draw = random.Random(seed)
    return [make(draw.randrange(keys), i, at(draw.randrange(0, 600)), draw.choice(values)) for i in range(n)]


def _batches(rows, n, slack, column):
    """Out of order inside what the delay allows: rows come by a time that is off by some."""
    import random

    draw = random.Random(1)
    arrival = sorted(rows, key=lambda r: r[column] + timedelta(minutes=draw.uniform(0, slack)))
    size = -(-len(rows) // n)
    return [arrival[i : i + size] for i in range(0, len(rows), size)]


def _folded(rules, rows, keys, watermark):
    """The rules applied to all events of each key in order; deadlines up to the watermark."""
    states, out = {}, []
    for row in sorted(rows, key=lambda r: (r[-2], r[keys])):
        key, micros = row[:keys], int((row[-2] - T0).total_seconds() * 1e6) + 1704067200 * 10**6
        state, made = rules.on_event(key, states.get(key, (None, 0, None)), micros, row[keys], row[-1])
        states[key] = state
        out += made
    for key, state in states.items():
        if state[2] is not None and state[2] // 1000 + 1 <= watermark:
            out.append(rules.on_deadline(key, state)[1])
    return sorted(out, key=repr)


def test_out_of_order_jobs_in_many_batches(session, spark, tmp_path):
    statuses = ["created", "queued", "processing", "processing", "completed", "failed"]
    rows = _log(2, 9, 500, statuses, lambda k, i, t, v: (k, i, t, v))
    stream = files(session, tmp_path, JOBS, _batches(rows, 6, 25, 2))
    rules = machines.JobRules(1800, 3)
    query, out = run(spark, machines.stream_jobs(stream, "30 minutes", 1800, 3), tmp_path)
    assert events.late_rows(query) == 0
    rest = machines.drain(session, f"{tmp_path}/out/checkpoint", rules)
    got = sorted((tuple(r) for r in out.unionByName(rest).collect()), key=repr)
    latest = int((max(r[2] for r in rows) - T0).total_seconds() * 1000) + 1704067200 * 1000
    assert got == _folded(rules, rows, 1, latest - 30 * 60_000)
    # What lies behind the watermark is no longer held.
    held = session.read.format("statestore").option("path", f"{tmp_path}/out/checkpoint")
    held = held.option("stateVarName", "held").option("flattenCollectionTypes", "true").load()
    kept = held.select(F.inline("user_map_value.events")).count()
    assert 0 < kept == rest.filter("event_id IS NOT NULL").count() < 100


def test_out_of_order_deliveries_in_many_batches(session, spark, tmp_path):
    states = ["intent", "intent", "sent", "failed", "unknown", "terminal"]
    rows = _log(4, 6, 400, states, lambda k, i, t, v: (k % 2, k // 2, i, t, v))
    schema = "job_id BIGINT, artifact_id BIGINT, event_id BIGINT, ts TIMESTAMP, state STRING"
    stream = files(session, tmp_path, schema, _batches(rows, 5, 25, 3))
    rules = machines.DeliveryRules(3)
    _, out = run(spark, machines.stream_deliveries(stream, 3, "30 minutes"), tmp_path)
    rest = machines.drain(session, f"{tmp_path}/out/checkpoint", rules)
    got = sorted((tuple(r) for r in out.unionByName(rest).collect()), key=repr)
    assert got == _folded(rules, rows, 2, 0)


def test_one_key_with_more_events_than_a_slot(session, spark, tmp_path):
    rows = [(1, i, T0 + timedelta(milliseconds=i * 37 % 60_000), "queued") for i in range(6_000)]
    stream = files(session, tmp_path, JOBS, [rows[:3_001], rows[3_001:], [(2, 0, at(100), "queued")], [(2, 1, at(200), "queued")]])
    _, out = run(spark, machines.stream_jobs(stream, "5 minutes"), tmp_path)
    got = [(r.ts_us, r.event_id) for r in out.filter("job_id = 1").collect()]
    assert len(got) == 6_000 and sorted(got) == sorted(got, key=lambda x: x)
    verdicts = {r.event_id: r.verdict for r in out.filter("job_id = 1").collect()}
    assert [k for k, v in verdicts.items() if v == "initial"] == [min(got)[1]]


def test_state_of_ended_and_silent_keys_falls(session, spark, tmp_path):
    """Ended jobs leave after an hour, silent ones after four; later events start anew."""
    first = [(j, 10 * j + i, at(i), s) for j in range(20) for i, s in enumerate(["queued", "processing", "completed"])]
    silent = [(100 + j, 1000 + j, at(3), "queued") for j in range(10)]
    clock = [[(999, 5000 + i, at(t), "queued")] for i, t in enumerate((30, 100, 150, 300, 500))]
    again = [(0, 9000, at(501), "created"), (100, 9001, at(502), "created")]
    stream = files(session, tmp_path, JOBS, [first + silent, *clock, again, [(999, 9999, at(900), "queued")]])
    followed = machines.stream_jobs(stream, "5 minutes", 600, 3, keep_seconds=3600, forget_seconds=4 * 3600)
    query, out = run(spark, followed, tmp_path)
    counts = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(counts) > 30 > 10 > counts[-1]
    verdicts = {r.event_id: r.verdict for r in out.collect()}
    assert verdicts[9000] == "initial" and verdicts[9001] == "initial"


def test_registry_reads_do_not_grow(spark, tmp_path):
    schema = (
        "job_id INT, type STRING, storage_path STRING, sha256 STRING, size_bytes INT, "
        "mime_type STRING, created_at INT"
    )
    registry, first = str(tmp_path / "registry"), {}
    for number in range(12):
        # Every batch repeats identities of earlier ones, with the same or another content.
        rows = [(i, "g", "p", str(i % 3 if i % 5 else number), 1, "m", number) for i in range(number, number + 30)]
        batch = spark.createDataFrame(rows, schema)
        reads = sinks.register_batch(batch, number, registry, ["created_at"])
        assert all(len(parts) <= sinks.PARTS for parts in reads.values())
        for r in rows:
            first.setdefault(r[0], (r[3], number))
        if number == 7:
            again = sinks.register_batch(batch, number, registry, ["created_at"])
            assert again == reads
    inserts = spark.read.parquet(f"{registry}/inserts").collect()
    assert {r.job_id: (r.sha256, r.batch_id) for r in inserts} == first and len(inserts) == len(first)
    # A batch with one identity reads one bucket.
    one = spark.createDataFrame([(3, "g", "p", "x", 1, "m", 99)], schema)
    reads = sinks.register_batch(one, 12, registry, ["created_at"])
    assert len(reads) == 1
    assert spark.read.parquet(f"{registry}/conflicts/batch_id=12").count() == 1


def test_state_of_a_key_does_not_grow_with_time_buckets(session, spark, tmp_path):
    """A key with an event in each of 300 buckets has a few runs and one timer."""
    rows = [(1, i, at(60 * i), "queued") for i in range(300)]
    stream = files(session, tmp_path, JOBS, [rows, [(1, 300, at(60 * 300), "queued")]])
    query, out = run(spark, machines.stream_jobs(stream, "5 minutes"), tmp_path)
    assert sorted(r.event_id for r in out.collect()) == list(range(300))
    counts = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert 0 < max(counts) < 20


def test_registry_holds_inserts_once(spark, tmp_path, monkeypatch):
    schema = (
        "job_id INT, type STRING, storage_path STRING, sha256 STRING, size_bytes INT, "
        "mime_type STRING, created_at INT"
    )
    monkeypatch.setattr(sinks, "BUCKET_ROWS", 3)
    registry = str(tmp_path / "registry")
    rows = [(i % 400, "g", "p", str(i // 400), 1, "m", i) for i in range(500)]
    for number in range(2):
        sinks.register_batch(spark.createDataFrame(rows, schema), number, registry, ["created_at"])
    sinks.register_batch(spark.createDataFrame([], schema), 2, registry, ["created_at"])
    inserts = spark.read.parquet(f"{registry}/inserts").collect()
    assert sorted((r.job_id, r.sha256, r.batch_id) for r in inserts) == [(i, "0", 0) for i in range(400)]
    assert spark.read.parquet(f"{registry}/conflicts").count() == 200
    # The buckets are the folders of the inserts; nothing is written a second time.
    assert not (tmp_path / "registry" / "index").exists()
    parts = [p for found in sinks.read_manifest(spark, registry, 3).values() for p in found]
    assert parts and all(f"{registry}/inserts/batch_id=0/" in p for p in parts)
