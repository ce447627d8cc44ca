"""State rules of jobs, artifacts and deliveries on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import artifacts, jobs
from loomframe.sources.tables import SCHEMAS, read_ops, split

JOB = (
    "id STRING, status STRING, version INT, attempt INT, owner_id STRING, "
    "lease_expires_at STRING, updated_at STRING"
)
STEP = (
    "job_id STRING, name STRING, status STRING, started_at STRING, completed_at STRING, "
    "retry_count INT, error STRING"
)


def times(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp") for n in names})


def test_recovery(spark):
    now, cutoff = "2024-01-01 12:00:00", "2024-01-01 11:55:00"
    table = times(
        spark.createDataFrame(
            [
                ("a", "processing", 3, 1, "w", "2024-01-01 12:00:00", "2024-01-01 11:00:00"),
                ("b", "processing", 3, 2, "w", "2024-01-01 11:59:59", "2024-01-01 11:00:00"),
                ("c", "processing", 3, 1, "w", "2024-01-01 12:00:01", "2024-01-01 11:00:00"),
                ("d", "processing", 3, 1, "w", None, "2024-01-01 11:00:00"),
            ],
            JOB,
        ),
        "lease_expires_at",
        "updated_at",
    )
    steps = times(
        spark.createDataFrame(
            [
                ("a", "render", "running", "2024-01-01 11:50:00", None, 0, None),
                ("a", "late", "running", "2024-01-01 11:56:00", None, 0, None),
                ("b", "render", "running", "2024-01-01 11:50:00", None, 0, None),
            ],
            STEP,
        ),
        "started_at",
        "completed_at",
    )
    after, stopped = jobs.recover_expired(table, steps, now, cutoff, 2)
    got = {r.id: r for r in after.collect()}
    assert (got["a"].status, got["a"].version, got["a"].owner_id) == ("queued", 4, None)
    assert got["b"].status == "failed"
    assert got["c"].status == "processing" and got["c"].owner_id == "w"
    assert got["d"].status == "processing"
    rows = {(r.job_id, r.name): r for r in stopped.collect()}
    assert rows["a", "render"].status == "failed" and rows["a", "render"].retry_count == 1
    assert rows["a", "late"].status == "running" and rows["b", "render"].status == "running"


def test_stale_queued_breaks_ties_by_id(spark):
    t = "2024-01-01 11:59:50"
    rows = [("z", "queued", t), ("b", "queued", t), ("a", "queued", "2024-01-01 11:59:51")]
    table = times(spark.createDataFrame(rows, "id STRING, status STRING, updated_at STRING"), "updated_at")
    now = "2024-01-01 12:00:00"
    assert [r.id for r in jobs.stale_queued(table, now, 10, 1).collect()] == ["b"]
    assert [r.id for r in jobs.stale_queued(table, now, 10, 9).collect()] == ["b", "z"]
    assert jobs.stale_queued(table, now, 10, 0).count() == 0


@pytest.mark.parametrize("depth", [3, 6, 50])
def test_intake_as_if_one_by_one(spark, depth):
    rng = random.Random(depth)
    t0 = "2024-01-01 00:00:%02d"
    waiting = [(100 + i, "queued", rng.randrange(4), rng.randrange(5), 1, t0 % i) for i in range(2)]
    subs = [
        (i, "new", rng.randrange(6), rng.choice([None, *range(4)]), rng.choice([5, 5, 99]), t0 % i)
        for i in range(40)
    ]
    schema = (
        "id BIGINT, status STRING, submitted_by BIGINT, source_message_id BIGINT, "
        "file_size_bytes BIGINT, updated_at STRING"
    )
    table = times(spark.createDataFrame(waiting, schema), "updated_at")
    incoming = times(spark.createDataFrame(subs, schema), "updated_at")
    allowed = spark.createDataFrame([(u,) for u in range(5)], "submitted_by BIGINT")
    got = {
        r.id: (r.verdict, r.duplicate_of)
        for r in jobs.intake_verdict(incoming, table, allowed, 50, depth).collect()
    }
    known = {(w[2], w[3]): w[0] for w in reversed(waiting)}
    active, want = len(waiting), {}
    for i, _, user, message, size, _ in subs:
        if user >= 5:
            want[i] = ("not_allowed", None)
        elif size > 50:
            want[i] = ("too_large", None)
        elif message is not None and (user, message) in known:
            want[i] = ("duplicate", known[user, message])
        elif active >= depth:
            want[i] = ("queue_full", None)
        else:
            want[i], active = ("accept", None), active + 1
            if message is not None:
                known[user, message] = i
    assert got == want


def test_failure_streaks(spark):
    cycles = [(0, 1, 0), (0, 1, 0), (0, 0, 0), (0, 2, 0), (0, 1, 3), (0, 1, 0)] + [(0, 1, 0)] * 4
    rows = [(0, i, *c) for i, c in enumerate(cycles)]
    report = spark.createDataFrame(
        rows, "s INT, cycle BIGINT, recovered_to_queued INT, dispatch_failures INT, redispatched INT"
    )
    got = jobs.failure_streaks(report, ["s"], "cycle", F.floor(F.col("cycle") / 2)).orderBy("cycle")
    assert [r.streak for r in got.collect()] == [1, 2, 2, 3, 0, 1, 2, 3, 4, 5]
    assert [r.cycle for r in got.filter("alarm").collect()] == [9]


def test_step_durations_are_never_negative(spark):
    rows = [
        ("a", "x", "completed", "2024-01-01 00:00:01", "2024-01-01 00:00:00", 0, None),
        ("a", "x", "running", "2024-01-01 00:00:01", None, 0, None),
    ]
    steps = times(spark.createDataFrame(rows, STEP), "started_at", "completed_at")
    assert [r.duration_ms for r in jobs.step_durations(steps).collect()] == [0, None]


def test_delivery_decisions(spark):
    records = [
        ("j", "a1", "c", 1, "failed", 1), ("j", "a2", "c", 1, "failed", 3),
        ("j", "a3", "c", 1, "intent", 1), ("j", "a4", "c", 1, "sent", 1),
        ("j", "a5", "c", 1, "unknown", 1), ("j", "a6", "c", 1, "terminal", 1),
    ]
    log = spark.createDataFrame(
        records, "job_id STRING, artifact_id STRING, channel STRING, ts INT, state STRING, attempt INT"
    )
    requests = spark.createDataFrame(
        [("j", f"a{i}", "c") for i in range(1, 8)], "job_id STRING, artifact_id STRING, channel STRING"
    )
    got = {r.artifact_id: r.decision for r in artifacts.delivery_decision(requests, log, ["ts"]).collect()}
    assert [got[f"a{i}"] for i in range(1, 8)] == [
        "retry", "give_up", "hold", "skip_sent", "hold", "give_up", "send",
    ]


def test_delivery_violations(spark):
    rows = [
        ("sent", 1, None, None), ("failed", 1, None, None), ("intent", 0, None, None),
        ("sent", 1, "m1", None), ("intent", 1, "m1", None),
    ]
    df = spark.createDataFrame(
        [(i, "c", *r) for i, r in enumerate(rows)],
        "no INT, channel STRING, state STRING, attempt INT, external_ref STRING, error STRING",
    )
    got = {r.no: r.violations for r in artifacts.delivery_violations(df).collect()}
    assert got == {
        0: ["sent_needs_ref"], 1: ["error_needed"], 2: ["attempt"], 4: ["ref_not_allowed"],
    }


def test_registration(spark):
    schema = (
        "job_id INT, type STRING, storage_path STRING, sha256 STRING, size_bytes INT, "
        "mime_type STRING, created_at INT"
    )
    old = spark.createDataFrame([(1, "gif", "p", "s1", 1, "m", 0)], schema)
    new = spark.createDataFrame(
        [
            (1, "gif", "p", "s1", 1, "m", 5),
            (1, "gif", "p", "s2", 1, "m", 6),
            (2, "gif", "p", "s3", 1, "m", 7),
            (2, "gif", "p", "s4", 1, "m", 8),
            (2, "gif", "p", "s3", 1, "m", 9),
            (3, "gif", "p", "s5", 1, "m", 9),
        ],
        schema,
    )
    inserts, conflicts = artifacts.register_artifacts(old, new, ["created_at"])
    assert sorted((r.job_id, r.sha256) for r in inserts.collect()) == [(2, "s3"), (3, "s5")]
    assert sorted((r.job_id, r.sha256) for r in conflicts.collect()) == [(1, "s2"), (2, "s4")]


def test_null_message_ids_do_not_collapse(spark):
    rows = [(1, 7, None, 1), (2, 7, None, 1), (3, 7, 5, 1), (4, 7, 5, 1)]
    subs = spark.createDataFrame(rows, "id INT, submitted_by INT, source_message_id INT, updated_at INT")
    assert sorted(r.id for r in jobs.dedup_submissions(subs).collect()) == [1, 2, 3]


def test_split_keeps_the_end_of_long_messages(spark):
    df = spark.createDataFrame([(1, None), (2, "x:" + "a" * 5000 + "end")], "id INT, reason STRING")
    good, bad = split(df, "probe")
    row = bad.first()
    assert good.count() == 1 and row.error_class == "x"
    assert len(row.error) == 4000 and row.error.endswith("end")


def test_tables_are_read_with_fixed_schemas(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        path = str(tmp_path / name)
        spark.createDataFrame([], schema).write.parquet(path)
        assert read_ops(spark, path, name).columns == [f.split()[0] for f in schema.split(", ")]


def _plain_registration(old, new):
    """Registered contents by identity, then incoming rows in order; nulls match nothing registered."""
    known, first, inserts, conflicts = {}, {}, [], []
    for r in sorted(old, key=lambda r: (r[6], r[3:6])):
        known[r[:3]] = r[3:6]
    for r in sorted(new, key=lambda r: (r[6], *[(x is not None, x) for x in r[:6]])):
        key = r[:3]
        wins = first.get(key) if None in key else known.get(key, first.get(key))
        if wins is None:
            first[key] = r[3:6]
            inserts.append(r)
        elif r[3:6] != wins and None not in key:
            conflicts.append((*r, wins[0]))
    return inserts, conflicts


@pytest.mark.parametrize("crowded", [100_000, 4])
def test_registration_shuffles_whole_rows_once(spark, monkeypatch, crowded):
    monkeypatch.setattr(artifacts, "CROWDED", crowded)
    draw = random.Random(5)
    schema = (
        "job_id INT, type STRING, storage_path STRING, sha256 STRING, size_bytes INT, "
        "mime_type STRING, created_at INT"
    )

    def rows(n, keys):
        made = []
        for i in range(n):
            key = draw.choice([0, draw.randrange(keys), draw.randrange(keys)])
            made.append((key, draw.choice(["g", "g", None]), "p", draw.choice("ab"), draw.choice([1, 1, 2]), "m", i))
        return made

    old, new = rows(40, 12), rows(300, 30)
    frames = [spark.createDataFrame(x, schema) for x in (old, new)]
    inserts, conflicts = artifacts.register_artifacts(*frames, ["created_at"])
    want = _plain_registration(old, new)
    for got, expected in zip((inserts, conflicts), want, strict=True):
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
        if crowded > len(new):
            # One shuffle for the registered rows and one for both sides together.
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan
            assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hash") <= 4
