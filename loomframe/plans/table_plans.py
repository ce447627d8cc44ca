"""Registered queries over operational tables and their cross-check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import artifacts as art
from loomframe.operators import jobs as ops
from loomframe.operators.ordered import id_block, running_sums, time_block
from loomframe.plans.common import micros, six
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views
from loomframe.sources.tables import split

NOW = "1998-06-01 00:00:00"
CUTOFF = "1998-01-01 00:00:00"


def active_jobs(spark: SparkSession, folder: str) -> DataFrame:
    return ops.count_active(data.jobs(spark, folder))


def submission_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_submissions(data.jobs(spark, folder)).select(
        "id", "submitted_by", "source_message_id", "status"
    )


def intake_verdict(spark: SparkSession, folder: str) -> DataFrame:
    jobs = data.jobs(spark, folder)
    subs = jobs.filter(F.col("status") == "created").select(
        "id", "submitted_by", "source_message_id", "file_size_bytes", "updated_at"
    )
    subs = subs.withColumn(
        "file_size_bytes", F.when(F.col("id") % 47 != 0, F.col("file_size_bytes"))
    )
    # Every seventh customer is listed under another id, so its submissions are refused.
    user = F.col("c_custkey")
    allowed = data.table(spark, folder, "customer").select(
        F.when(user % 7 != 0, user).otherwise(-1 - user).alias("submitted_by")
    )
    waiting = jobs.filter(F.col("status") != "created")
    judged = ops.intake_verdict(subs, waiting, allowed, 45_000_000, 8_500)
    return judged.select("id", "verdict", "duplicate_of")


def rejected_submissions(spark: SparkSession, folder: str) -> DataFrame:
    judged = intake_verdict(spark, folder).withColumn(
        "reason", F.when(F.col("verdict") != "accept", F.concat("verdict", F.lit(":intake")))
    )
    good, bad = split(judged, "intake")
    return bad.select("id", "stage", "error_class", "error").unionByName(
        good.select("id", F.lit("next").alias("stage")), allowMissingColumns=True
    )


def transition_audit(spark: SparkSession, folder: str) -> DataFrame:
    return ops.transition_audit(data.history(spark, folder)).select(
        "job_id", "event_id", "previous_status", "status", "transition"
    )


def attempt_numbers(spark: SparkSession, folder: str) -> DataFrame:
    claims = data.history(spark, folder).filter(F.col("status") == "processing")
    return ops.number_attempts(claims).select("job_id", "event_id", "attempt")


def fencing_audit(spark: SparkSession, folder: str) -> DataFrame:
    rows = running_sums(
        data.history(spark, folder),
        ["job_id"],
        ["ts", "event_id"],
        time_block("ts"),
        {"claims": (F.col("status") == "processing").cast("bigint")},
    ).withColumns(
        {
            "owner": F.floor(F.col("value") / 10.0) % 2,
            "version": F.col("claims") - F.when(F.col("event_id") % 7 == 0, 1).otherwise(0),
        }
    )
    claims = rows.filter(F.col("status") == "processing").select(
        "job_id",
        "ts",
        "event_id",
        "owner",
        F.col("claims").alias("version"),
        (F.col("ts") + F.expr("INTERVAL 18 HOURS")).alias("lease_expires_at"),
    )
    commits = rows.filter(F.col("status").isin("completed", "failed"))
    audit = ops.fencing_audit(claims, commits.select("job_id", "ts", "event_id", "owner", "version"))
    return audit.select("job_id", "event_id", "claim_id", "verdict")


def _recovery_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return data.history(spark, folder).select(
        (F.floor(F.unix_micros("ts") / F.lit(300_000_000))).alias("cycle"),
        F.when(F.col("status") == "created", "recovered")
        .when(F.col("status") == "completed", "redispatched")
        .when(F.col("status").isin("failed", "processing"), "dispatch_failed")
        .otherwise("idle")
        .alias("outcome"),
    )


def recovery_report(spark: SparkSession, folder: str) -> DataFrame:
    return ops.recovery_report(_recovery_attempts(spark, folder))


def failure_streaks(spark: SparkSession, folder: str) -> DataFrame:
    report = recovery_report(spark, folder).withColumn("scheduler", F.lit(0))
    streaks = ops.failure_streaks(report, ["scheduler"], "cycle", id_block("cycle", 4096))
    return streaks.select("cycle", "streak", "alarm")


def stale_queued(spark: SparkSession, folder: str) -> DataFrame:
    return micros(ops.stale_queued(data.jobs(spark, folder), NOW), "updated_at")


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    started = F.col("l_shipdate").cast("timestamp")
    return data.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("job_id"),
        F.concat(F.lit("stage_"), F.col("l_linenumber").cast("string")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "running")
        .when(F.col("l_returnflag") == "R", "failed")
        .otherwise("completed")
        .alias("status"),
        started.alias("started_at"),
        F.when(
            F.col("l_linestatus") != "O",
            F.timestamp_micros(
                F.unix_micros(started)
                + F.floor((F.col("l_extendedprice") - 5000) * 1000).cast("bigint")
            ),
        ).alias("completed_at"),
        (F.col("l_partkey") % 3).cast("int").alias("retry_count"),
        F.lit(None).cast("string").alias("error"),
        F.col("l_suppkey").alias("source_id"),
    )


def recovered_jobs(spark: SparkSession, folder: str) -> DataFrame:
    updated, _ = ops.recover_expired(
        data.jobs(spark, folder), _steps(spark, folder), NOW, CUTOFF, 2
    )
    return micros(
        updated.select("id", "status", "owner_id", "version", "lease_expires_at", "updated_at"),
        "lease_expires_at",
        "updated_at",
    )


def recovered_steps(spark: SparkSession, folder: str) -> DataFrame:
    _, steps = ops.recover_expired(
        data.jobs(spark, folder), _steps(spark, folder), NOW, CUTOFF, 2
    )
    return micros(
        steps.select("job_id", "name", "status", "completed_at", "retry_count", "error"),
        "completed_at",
    )


def step_durations(spark: SparkSession, folder: str) -> DataFrame:
    return six(ops.step_summary(_steps(spark, folder), 86_400_000.0), "mean_ms", "p50_ms", "p95_ms")


def job_view(spark: SparkSession, folder: str) -> DataFrame:
    o = data.table(spark, folder, "orders")
    # Documents under another key leave their jobs without one.
    key = F.col("o_orderkey")
    kept = lambda n: F.when(key % n == 0, key).otherwise(-1 - key).alias("job_id")
    specs = o.select(
        kept(3),
        F.concat(F.lit('{"style":"'), "o_orderpriority", F.lit('"}')).alias("document"),
    )
    settings = o.select(
        kept(4),
        F.concat(F.lit('{"fps":'), (F.col("o_custkey") % 30 + 1).cast("string"), F.lit("}")).alias(
            "document"
        ),
    )
    view = ops.job_view(data.jobs(spark, folder).select("id", "status"), specs, settings)
    return view.select("id", "status", "design_spec", "processing_settings")


def orphan_audit(spark: SparkSession, folder: str) -> DataFrame:
    # Every fiftieth job is known under another key, so its artifacts have none.
    parents = data.jobs(spark, folder).select(
        F.when(F.col("id") % 50 != 0, F.col("id")).otherwise(-1 - F.col("id")).alias("id")
    )
    missing = ops.orphans(data.artifacts(spark, folder), parents, "job_id")
    return missing.groupBy("job_id").agg(F.count("*").alias("orphans"))


def orphan_revisions(spark: SparkSession, folder: str) -> DataFrame:
    revisions = data.revisions(spark, folder)
    # Every third revision is known under another id, so its children lose their parent.
    own = F.col("revision_id")
    parents = revisions.select(
        "project_id", F.when(own % 3 != 2, own).otherwise(-1 - own).alias("parent_id")
    )
    return (
        revisions.filter(F.col("parent_id").isNotNull())
        .join(parents, ["project_id", "parent_id"], "left_anti")
        .select("project_id", "revision_id", "parent_id")
    )


def registered_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.artifacts(spark, folder).withColumn("created_at", F.col("expires_at"))
    order = ["created_at", "part_id", "source_id", "size_bytes"]
    old = rows.filter(F.col("source_id") % 4 == 0)
    new = rows.filter(F.col("source_id") % 4 != 0)
    # The latest registered row must be one row; ties in time are broken beforehand.
    old = art.job_artifacts(old.select(*art.IDENTITY, *art.CONTENT, "created_at"))
    inserts, conflicts = art.register_artifacts(old, new, order)
    return inserts.select(*art.IDENTITY, "sha256", F.lit("insert").alias("outcome")).unionByName(
        conflicts.select(*art.IDENTITY, "sha256", F.lit("conflict").alias("outcome"))
    )


def artifact_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return art.artifact_conflicts(data.artifacts(spark, folder))


def expired_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    plan = art.expired_artifacts(data.artifacts(spark, folder), "2000-01-01 00:00:00")
    return micros(plan.select("job_id", "type", "storage_path", "expires_at"), "expires_at")


def retained_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.artifacts(spark, folder)
    # Some artifacts never expire.
    lasting = F.when(F.col("part_id") % 23 != 0, F.col("expires_at"))
    kept = art.retained_artifacts(rows.withColumn("expires_at", lasting), "1998-01-01 00:00:00")
    return micros(kept.select("job_id", "type", "storage_path", "expires_at"), "expires_at")


def newest_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    rows = data.artifacts(spark, folder).withColumnRenamed("expires_at", "created_at")
    newest = art.job_artifacts(rows.drop("part_id", "source_id"), "R")
    return micros(newest, "created_at")


def content_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    docs = data.table(spark, folder, "documents")
    return art.content_duplicates(docs, F.col("text"), "doc_id")


def artifact_hygiene(spark: SparkSession, folder: str) -> DataFrame:
    named = data.artifacts(spark, folder).select(
        "job_id",
        F.when(F.col("size_bytes") % 5 == 0, F.col("storage_path"))
        .when(F.col("size_bytes") % 5 == 1, F.substring("storage_path", 5, 50))
        .when(F.col("size_bytes") % 5 == 2, F.lit("notes.unknown"))
        .when(F.col("size_bytes") % 5 == 3, F.lit("Cover.PNG"))
        .otherwise(F.lit(".."))
        .alias("name"),
        "mime_type",
    )
    return art.artifact_hygiene(named)


def first_intents(spark: SparkSession, folder: str) -> DataFrame:
    return art.first_intents(data.deliveries(spark, folder), ["ts", "event_id"]).select(
        *art.DELIVERY, "event_id"
    )


def delivery_decision(spark: SparkSession, folder: str) -> DataFrame:
    requests = data.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("job_id"),
        (F.col("l_partkey") % 100).alias("artifact_id"),
        F.lit("chat").alias("channel"),
    )
    return art.delivery_decision(
        requests, data.deliveries(spark, folder), ["ts", "event_id"], 2
    ).select("job_id", "artifact_id", "state", "attempt", "decision")


def delivery_violations(spark: SparkSession, folder: str) -> DataFrame:
    broken = art.delivery_violations(data.deliveries(spark, folder))
    return broken.select("event_id", "state", F.concat_ws(",", "violations").alias("violations"))


def ai_run_audit(spark: SparkSession, folder: str) -> DataFrame:
    caps = F.array(F.lit("upscale"), F.lit("segment"), F.lit("caption"))
    models = data.table(spark, folder, "supplier").select(
        F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("name"),
        (F.col("s_suppkey") % 6 != 0).alias("enabled"),
        F.slice(caps, 1, (F.col("s_suppkey") % 3 + 1).cast("int")).alias("capabilities"),
        F.when(F.col("s_suppkey") % 5 != 0, F.sha2(F.col("s_name"), 256)).alias("weight_sha256"),
        (F.col("s_acctbal") > 0).alias("commercial_allowed"),
        F.when(F.col("s_suppkey") % 7 != 0, F.lit(1)).alias("verified_at"),
    )
    runs = data.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.when(
            F.col("l_linenumber") != 7,
            F.concat(F.lit("m"), (F.col("l_suppkey") + F.col("l_partkey") % 9).cast("string")),
        ).alias("model_id"),
        F.get(caps, (F.col("l_quantity") % 4).cast("int")).alias("capability"),
    )
    return ops.ai_run_audit(runs, models)


QUERIES = {
    "active_jobs": active_jobs,
    "submission_dedup": submission_dedup,
    "intake_verdict": intake_verdict,
    "rejected_submissions": rejected_submissions,
    "transition_audit": transition_audit,
    "attempt_numbers": attempt_numbers,
    "fencing_audit": fencing_audit,
    "recovery_report": recovery_report,
    "failure_streaks": failure_streaks,
    "stale_queued": stale_queued,
    "recovered_jobs": recovered_jobs,
    "recovered_steps": recovered_steps,
    "step_durations": step_durations,
    "job_view": job_view,
    "orphan_audit": orphan_audit,
    "orphan_revisions": orphan_revisions,
    "registered_artifacts": registered_artifacts,
    "artifact_conflicts": artifact_conflicts,
    "expired_artifacts": expired_artifacts,
    "retained_artifacts": retained_artifacts,
    "newest_artifacts": newest_artifacts,
    "content_duplicates": content_duplicates,
    "artifact_hygiene": artifact_hygiene,
    "first_intents": first_intents,
    "delivery_decision": delivery_decision,
    "delivery_violations": delivery_violations,
    "ai_run_audit": ai_run_audit,
}

_INTAKE = """subs AS (SELECT * FROM jobs WHERE status = 'created'),
waiting AS (SELECT * FROM jobs WHERE status <> 'created'),
known AS (SELECT submitted_by, source_message_id, min(id) AS existing_id FROM waiting
          WHERE source_message_id IS NOT NULL GROUP BY ALL),
reasons AS (
    SELECT s.*, existing_id,
           CASE WHEN s.submitted_by NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
                    THEN 'not_allowed'
                WHEN s.id % 47 = 0 OR s.file_size_bytes > 45000000 THEN 'too_large'
                WHEN existing_id IS NOT NULL THEN 'duplicate' END AS reason
    FROM subs s LEFT JOIN known USING (submitted_by, source_message_id)),
firsts AS (
    SELECT id, submitted_by, source_message_id, row_number() OVER (ORDER BY updated_at, id) AS place
    FROM (SELECT * FROM reasons WHERE reason IS NULL
          QUALIFY source_message_id IS NULL OR row_number() OVER (
              PARTITION BY submitted_by, source_message_id ORDER BY updated_at, id) = 1)),
accepted AS (
    SELECT * FROM firsts WHERE place <= 8500 -
        (SELECT count(*) FROM waiting WHERE status IN ('created', 'queued', 'processing'))),
judged AS (
    SELECT r.id, CASE WHEN reason IS NOT NULL THEN reason
                      WHEN a.id IS NOT NULL THEN 'accept'
                      WHEN f.id IS NOT NULL THEN 'duplicate' ELSE 'queue_full' END AS verdict,
           existing_id, f.id AS first_id
    FROM reasons r LEFT JOIN accepted a ON a.id = r.id
    LEFT JOIN accepted f ON f.submitted_by = r.submitted_by
        AND f.source_message_id = r.source_message_id)"""

_STEPS = """steps AS (
    SELECT l_orderkey AS job_id, 'stage_' || l_linenumber AS name,
           CASE WHEN l_linestatus = 'O' THEN 'running' WHEN l_returnflag = 'R' THEN 'failed'
                ELSE 'completed' END AS status, l_shipdate AS started_at,
           CASE WHEN l_linestatus <> 'O' THEN epoch_us(l_shipdate)
                + CAST(floor((l_extendedprice - 5000) * 1000) AS BIGINT) END AS completed_us,
           CAST(l_partkey % 3 AS INTEGER) AS retry_count, CAST(NULL AS VARCHAR) AS error
    FROM lineitem)"""

_CYCLES = """report AS (
    SELECT epoch_us(ts) // 300000000 AS cycle,
           count(*) FILTER (status = 'created') AS recovered_to_queued,
           count(*) FILTER (status = 'completed') AS redispatched,
           count(*) FILTER (status IN ('failed', 'processing')) AS dispatch_failures
    FROM history GROUP BY 1)"""

ORACLES = {
    "active_jobs": with_views("jobs")
    + " SELECT count(*) AS active FROM jobs WHERE status IN ('created', 'queued', 'processing')",
    "submission_dedup": with_views("jobs")
    + """ SELECT id, submitted_by, source_message_id, status FROM jobs
          QUALIFY source_message_id IS NULL OR row_number() OVER (
              PARTITION BY submitted_by, source_message_id ORDER BY updated_at, id) = 1""",
    "intake_verdict": with_views("jobs")
    + f""", {_INTAKE} SELECT id, verdict, CASE WHEN verdict = 'duplicate'
              THEN coalesce(existing_id, first_id) END AS duplicate_of FROM judged""",
    "rejected_submissions": with_views("jobs")
    + f""", {_INTAKE} SELECT id, CASE WHEN verdict = 'accept' THEN 'next' ELSE 'intake' END AS stage,
              CASE WHEN verdict <> 'accept' THEN verdict END AS error_class,
              CASE WHEN verdict <> 'accept' THEN verdict || ':intake' END AS error FROM judged""",
    "transition_audit": with_views("history")
    + """, steps AS (SELECT *, lag(status) OVER (PARTITION BY job_id ORDER BY ts, event_id)
                     AS previous_status FROM history)
    SELECT job_id, event_id, previous_status, status,
           CASE WHEN previous_status IS NULL THEN 'initial'
                WHEN previous_status = status THEN 'unchanged'
                WHEN (previous_status, status) IN (('created', 'queued'), ('queued', 'processing'),
                     ('processing', 'queued'), ('processing', 'completed'),
                     ('processing', 'failed')) THEN 'legal'
                WHEN previous_status = 'queued' AND status = 'created' THEN 'rollback'
                ELSE 'illegal' END AS transition
    FROM steps""",
    "attempt_numbers": with_views("history")
    + """ SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id)
              AS attempt FROM history WHERE status = 'processing'""",
    "fencing_audit": with_views("history")
    + """, rows_ AS (
        SELECT *, count(*) FILTER (status = 'processing') OVER w AS claims,
               CAST(floor(value / 10) AS BIGINT) % 2 AS owner,
               CASE WHEN status = 'processing' THEN event_id END AS claim
        FROM history WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
    seen AS (
        SELECT *, last_value(claim IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY ts, event_id)
                  AS claim_id FROM rows_),
    checked AS (
        SELECT c.job_id, c.event_id, c.ts, c.claim_id,
               CASE WHEN c.claim_id IS NULL THEN 'no_claim'
                    WHEN o.owner <> c.owner THEN 'wrong_owner'
                    WHEN o.claims <> c.claims - CASE WHEN c.event_id % 7 = 0 THEN 1 ELSE 0 END
                         THEN 'wrong_version'
                    WHEN o.ts + INTERVAL 18 HOUR <= c.ts THEN 'lease_expired' END AS reason
        FROM seen c LEFT JOIN rows_ o ON o.event_id = c.claim_id
        WHERE c.status IN ('completed', 'failed'))
    SELECT job_id, event_id, claim_id, CASE WHEN reason IS NOT NULL THEN reason
           WHEN row_number() OVER (PARTITION BY job_id, claim_id, reason IS NULL
                                   ORDER BY ts, event_id) > 1 THEN 'already_closed'
           ELSE 'valid' END AS verdict
    FROM checked""",
    "recovery_report": with_views("history") + f", {_CYCLES} SELECT * FROM report",
    "failure_streaks": with_views("history")
    + f""", {_CYCLES}, islands AS (
        SELECT *, sum(CAST(redispatched > 0 AS INTEGER)) OVER (ORDER BY cycle) AS island,
               dispatch_failures > 0 AND redispatched = 0 AS failing FROM report),
    runs AS (SELECT *, count(*) FILTER (failing) OVER (PARTITION BY island ORDER BY cycle)
                    AS streak FROM islands)
    SELECT cycle, streak, failing AND streak >= 5 AS alarm FROM runs""",
    "stale_queued": with_views("jobs")
    + """ SELECT id, epoch_us(updated_at) AS updated_at FROM jobs
          WHERE status = 'queued'
            AND updated_at <= TIMESTAMP '1998-06-01' - INTERVAL 10 SECOND
          ORDER BY jobs.updated_at, id LIMIT 50""",
    "recovered_jobs": with_views("jobs")
    + """, e AS (SELECT *, status = 'processing' AND lease_expires_at <= TIMESTAMP '1998-06-01'
                 AS x FROM jobs)
    SELECT id, CASE WHEN x AND attempt >= 2 THEN 'failed' WHEN x THEN 'queued' ELSE status END
               AS status,
           CASE WHEN NOT x THEN owner_id END AS owner_id,
           CASE WHEN x THEN version + 1 ELSE version END AS version,
           CASE WHEN NOT x THEN epoch_us(lease_expires_at) END AS lease_expires_at,
           epoch_us(CASE WHEN x THEN TIMESTAMP '1998-06-01' ELSE updated_at END) AS updated_at
    FROM e""",
    "recovered_steps": with_views("jobs")
    + f""", {_STEPS}, marked AS (
        SELECT *, status = 'running' AND started_at <= TIMESTAMP '1998-01-01' AND job_id IN (
            SELECT id FROM jobs WHERE status = 'processing' AND attempt < 2
                AND lease_expires_at <= TIMESTAMP '1998-06-01') AS x FROM steps)
    SELECT job_id, name, CASE WHEN x THEN 'failed' ELSE status END AS status,
           CASE WHEN x THEN epoch_us(TIMESTAMP '1998-06-01') ELSE completed_us END AS completed_at,
           CASE WHEN x THEN retry_count + 1 ELSE retry_count END AS retry_count,
           CASE WHEN x THEN 'worker lease expired; job requeued' ELSE error END AS error
    FROM marked""",
    "step_durations": f"""WITH {_STEPS}, timed AS (
        SELECT name, status, retry_count, CASE WHEN completed_us IS NOT NULL THEN
               CAST(greatest(0, floor((completed_us - epoch_us(started_at)) / CAST(1000 AS DOUBLE)))
               AS BIGINT) END AS ms FROM steps)
    SELECT name, count(*) AS steps, count(*) FILTER (status = 'failed') AS failed,
           CAST(sum(retry_count) AS BIGINT) AS retries, round(avg(ms), 6) AS mean_ms,
           round(quantile_cont(CAST(ms AS DOUBLE), 0.5), 6) AS p50_ms,
           round(quantile_cont(CAST(ms AS DOUBLE), 0.95), 6) AS p95_ms
    FROM timed GROUP BY name""",
    "job_view": with_views("jobs")
    + """ SELECT id, status,
           CASE WHEN id % 3 = 0 THEN '{"style":"' || o_orderpriority || '"}' ELSE '{}' END
               AS design_spec,
           CASE WHEN id % 4 = 0 THEN '{"fps":' || (o_custkey % 30 + 1) || '}' ELSE '{}' END
               AS processing_settings
          FROM jobs JOIN orders ON o_orderkey = id""",
    "orphan_audit": with_views("jobs", "artifacts")
    + """ SELECT job_id, count(*) AS orphans FROM artifacts
          WHERE job_id NOT IN (SELECT id FROM jobs WHERE id % 50 <> 0) GROUP BY job_id""",
    "orphan_revisions": with_views("revisions")
    + """ SELECT c.project_id, c.revision_id, c.parent_id FROM revisions c
    WHERE c.parent_id IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM revisions p WHERE p.revision_id % 3 <> 2 AND p.project_id = c.project_id AND p.revision_id = c.parent_id)""",
    "registered_artifacts": with_views("artifacts")
    + """, old AS (
        SELECT job_id, type, storage_path, sha256, size_bytes, mime_type FROM artifacts
        WHERE source_id % 4 = 0
        QUALIFY row_number() OVER (PARTITION BY job_id, type, storage_path
            ORDER BY expires_at DESC, mime_type DESC, sha256 DESC, size_bytes DESC) = 1),
    new AS (
        SELECT *, row_number() OVER (PARTITION BY job_id, type, storage_path
            ORDER BY expires_at, part_id, source_id, size_bytes) AS rn
        FROM artifacts WHERE source_id % 4 <> 0),
    firsts AS (SELECT * FROM new WHERE rn = 1),
    won AS (
        SELECT n.*, f.sha256 AS f_sha, f.size_bytes AS f_size, f.mime_type AS f_mime,
               o.sha256 AS o_sha, o.size_bytes AS o_size, o.mime_type AS o_mime
        FROM new n JOIN firsts f USING (job_id, type, storage_path)
        LEFT JOIN old o USING (job_id, type, storage_path))
    SELECT job_id, type, storage_path, sha256, 'insert' AS outcome FROM won
    WHERE rn = 1 AND o_sha IS NULL
    UNION ALL
    SELECT job_id, type, storage_path, sha256, 'conflict' FROM won
    WHERE (sha256, size_bytes, mime_type) <> CASE WHEN o_sha IS NULL THEN (f_sha, f_size, f_mime)
          ELSE (o_sha, o_size, o_mime) END""",
    "artifact_conflicts": with_views("artifacts")
    + """ SELECT job_id, type, storage_path, count(*) AS rows,
               count(DISTINCT (sha256, size_bytes, mime_type)) AS versions
          FROM artifacts GROUP BY ALL HAVING count(DISTINCT (sha256, size_bytes, mime_type)) > 1""",
    "expired_artifacts": with_views("artifacts")
    + """ SELECT job_id, type, storage_path, epoch_us(expires_at) AS expires_at FROM artifacts
          WHERE expires_at <= TIMESTAMP '2000-01-01' ORDER BY artifacts.expires_at""",
    "retained_artifacts": with_views("artifacts")
    + """, lasting AS (SELECT *, CASE WHEN part_id % 23 <> 0 THEN expires_at END AS until FROM artifacts)
    SELECT job_id, type, storage_path, epoch_us(until) AS expires_at FROM lasting
    WHERE until IS NULL OR until > TIMESTAMP '1998-01-01'""",
    "newest_artifacts": with_views("artifacts")
    + """ SELECT job_id, type, storage_path, mime_type, size_bytes, sha256,
               epoch_us(expires_at) AS created_at FROM artifacts WHERE type = 'R'
          QUALIFY row_number() OVER (PARTITION BY job_id, type, storage_path
              ORDER BY artifacts.expires_at DESC, mime_type DESC, sha256 DESC, size_bytes DESC) = 1""",
    "content_duplicates": """SELECT sha256(text) AS sha256, count(*) AS copies,
               min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "artifact_hygiene": with_views("artifacts")
    + """, named AS (
        SELECT job_id, mime_type, CASE size_bytes % 5 WHEN 0 THEN storage_path
               WHEN 1 THEN substr(storage_path, 5) WHEN 2 THEN 'notes.unknown'
               WHEN 3 THEN 'Cover.PNG' ELSE '..' END AS name FROM artifacts),
    typed AS (
        SELECT *, CASE WHEN name LIKE '%.gif' THEN 'image/gif'
                       WHEN name LIKE '%.PNG' THEN 'image/png' END AS expected_mime FROM named)
    SELECT *, CASE WHEN name LIKE '%/%' OR name = '..' THEN 'unsafe_name'
                   WHEN expected_mime <> mime_type THEN 'mime_mismatch' END AS reason FROM typed""",
    "first_intents": with_views("deliveries")
    + """ SELECT job_id, artifact_id, channel, arg_min(event_id, (ts, event_id)) AS event_id
          FROM deliveries WHERE state = 'intent' GROUP BY ALL""",
    "delivery_decision": with_views("deliveries")
    + """, latest AS (
        SELECT job_id, artifact_id, channel, state, attempt FROM deliveries
        QUALIFY row_number() OVER (PARTITION BY job_id, artifact_id, channel
                                   ORDER BY ts DESC, event_id DESC) = 1)
    SELECT l_suppkey AS job_id, l_partkey % 100 AS artifact_id, state, attempt,
           CASE WHEN state IS NULL THEN 'send' WHEN state = 'sent' THEN 'skip_sent'
                WHEN state = 'terminal' THEN 'give_up'
                WHEN state = 'failed' AND attempt < 2 THEN 'retry'
                WHEN state = 'failed' THEN 'give_up' ELSE 'hold' END AS decision
    FROM lineitem LEFT JOIN latest ON job_id = l_suppkey AND artifact_id = l_partkey % 100""",
    "delivery_violations": with_views("deliveries")
    + """, checked AS (
        SELECT event_id, state, concat_ws(',',
            CASE WHEN state = 'sent' AND coalesce(external_ref, '') = '' THEN 'sent_needs_ref' END,
            CASE WHEN state IN ('failed', 'unknown', 'terminal') AND coalesce(error, '') = ''
                 THEN 'error_needed' END,
            CASE WHEN state <> 'sent' AND external_ref IS NOT NULL THEN 'ref_not_allowed' END)
            AS violations FROM deliveries)
    SELECT * FROM checked WHERE violations <> ''""",
    "ai_run_audit": """WITH models AS (
        SELECT 'm' || s_suppkey AS name, s_suppkey % 6 <> 0 AS enabled,
               ['upscale', 'segment', 'caption'][1:s_suppkey % 3 + 1] AS caps,
               s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS verified,
               s_acctbal > 0 AS commercial FROM supplier),
    runs AS (
        SELECT l_orderkey AS run_id,
               CASE WHEN l_linenumber <> 7 THEN 'm' || (l_suppkey + l_partkey % 9) END AS model_id,
               ['upscale', 'segment', 'caption'][CAST(l_quantity AS BIGINT) % 4 + 1] AS capability
        FROM lineitem)
    SELECT run_id, model_id, capability, CASE WHEN model_id IS NULL THEN 'no_model'
           WHEN name IS NULL THEN 'unknown_model' WHEN NOT enabled THEN 'disabled'
           WHEN capability IS NOT NULL AND NOT list_contains(caps, capability)
               THEN 'missing_capability'
           WHEN NOT verified THEN 'unverified_weights' WHEN NOT commercial THEN 'licence' END
           AS reason
    FROM runs LEFT JOIN models ON name = model_id""",
}
