"""Job tables: intake, transitions, leases, recovery and steps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.numeric import first_reason, required
from loomframe.operators.ordered import (
    attach,
    earliest_rows,
    exact_quantiles,
    last_known,
    numbered,
    previous,
    running_sums,
    time_block,
)
from loomframe.session import cut_lineage

ACTIVE = ("created", "queued", "processing")
# The allowed status changes; the other statuses have no exits.
TRANSITIONS = {
    "created": ("queued", "cancelled"),
    "queued": ("processing", "cancelled"),
    "processing": ("queued", "completed", "failed", "cancelled"),
}
#: Queue places up to which the accepted submissions are sent to every task.
FEW_PLACES = 100_000
LEASE_EXPIRED = "worker lease expired; job requeued"


def instant(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp")


# --- intake ------------------------------------------------------------------------------


def count_active(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*ACTIVE)).agg(F.count("*").alias("active"))


def dedup_submissions(
    subs: DataFrame, order: Sequence[str] = ("updated_at", "id")
) -> DataFrame:
    """First submission per (user, message); rows without a message id all stay."""
    keyed = subs.filter(F.col("source_message_id").isNotNull())
    loose = subs.filter(F.col("source_message_id").isNull())
    return earliest_rows(keyed, ["submitted_by", "source_message_id"], order).unionByName(loose)


def intake_verdict(
    subs: DataFrame,
    jobs: DataFrame,
    allowed: DataFrame | None,
    max_bytes: int,
    depth: int,
) -> DataFrame:
    """Verdict per submission as if they were received one after the other.

    A submission takes a queue place when it is accepted, and later copies of it are
    duplicates. The accepted ones are the first candidates, as many as the queue has room
    for, so no row waits for another. The rows are judged once and written; what is
    accepted is no more than ``depth`` rows.
    """
    key = ["submitted_by", "source_message_id"]
    known = (
        jobs.filter(F.col("source_message_id").isNotNull())
        .groupBy(*key)
        .agg(F.min("id").alias("existing_id"))
    )
    rows = subs.join(known, key, "left")
    if allowed is None:
        rows = rows.withColumn("_allowed", F.lit(True))
    else:
        users = allowed.select("submitted_by").distinct().withColumn("_allowed", F.lit(True))
        rows = attach(rows, users, ["submitted_by"], F.col("id"))
    rows = rows.withColumn(
        "_reason",
        first_reason(
            not_allowed=F.col("_allowed").isNull(),
            too_large=required(F.col("file_size_bytes") > max_bytes),
            duplicate=F.col("existing_id").isNotNull(),
        ),
    )
    rows = cut_lineage(rows)
    open_rows = rows.filter(F.col("_reason").isNull()).select("id", *key, "updated_at")
    room = max(0, depth - count_active(jobs).first()[0])
    firsts = dedup_submissions(open_rows).orderBy("updated_at", "id").limit(room)
    accepted = cut_lineage(firsts.select("id", *key))
    if depth <= FEW_PLACES:
        accepted = F.broadcast(accepted)
    winners = accepted.select("id", F.lit(True).alias("_accepted"))
    taken = accepted.filter(F.col("source_message_id").isNotNull()).select(
        *key, F.col("id").alias("_first_id")
    )
    judged = rows.join(winners, "id", "left").join(taken, key, "left")
    late = F.col("_accepted").isNull() & F.col("_first_id").isNotNull()
    verdict = (
        F.when(F.col("_reason").isNotNull(), F.col("_reason"))
        .when(F.col("_accepted"), "accept")
        .when(late, "duplicate")
        .otherwise("queue_full")
    )
    existing = F.when(
        verdict == "duplicate", F.coalesce("existing_id", "_first_id")
    )
    return judged.select(
        *subs.columns, verdict.alias("verdict"), existing.alias("duplicate_of")
    )


# --- transitions and leases ----------------------------------------------------------------


def transition_class(before: Column, after: Column) -> Column:
    legal = F.lit(False)
    for source, targets in TRANSITIONS.items():
        legal = legal | ((before == source) & after.isin(*targets))
    return (
        F.when(before.isNull(), "initial")
        .when(before == after, "unchanged")
        .when(legal, "legal")
        .when((before == "queued") & (after == "created"), "rollback")
        .otherwise("illegal")
    )


def transition_audit(
    history: DataFrame, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    steps = previous(
        history, ["job_id"], order, time_block("ts"), {"previous_status": "status"}
    )
    return steps.withColumn(
        "transition", transition_class(F.col("previous_status"), F.col("status"))
    )


def number_attempts(
    claims: DataFrame, order: Sequence[str] = ("ts", "event_id")
) -> DataFrame:
    return numbered(claims, ["job_id"], order, time_block("ts"), "attempt")


def fencing_audit(claims: DataFrame, commits: DataFrame) -> DataFrame:
    """Does each finish record belong to the open claim of its job?

    ``claims``: job_id, ts, event_id, owner, version, lease_expires_at.
    ``commits``: job_id, ts, event_id, owner, version. Claims of the same instant come
    first by ``event_id``.
    """
    claim = F.struct(
        F.col("owner").alias("owner"),
        F.col("version").alias("version"),
        F.col("lease_expires_at").alias("lease"),
        F.col("event_id").alias("claim_id"),
    )
    log = claims.select("job_id", "ts", "event_id", claim.alias("_claim")).unionByName(
        commits.select("job_id", "ts", "event_id", F.struct("owner", "version").alias("_commit")),
        allowMissingColumns=True,
    )
    seen = last_known(
        log, ["job_id"], ["ts", "event_id"], time_block("ts"), {"_open": F.col("_claim")}
    ).filter(F.col("_commit").isNotNull())
    checked = seen.withColumn(
        "_reason",
        first_reason(
            no_claim=F.col("_open").isNull(),
            wrong_owner=F.col("_open.owner") != F.col("_commit.owner"),
            wrong_version=F.col("_open.version") != F.col("_commit.version"),
            lease_expired=F.coalesce(F.col("_open.lease") <= F.col("ts"), F.lit(True)),
        ),
    ).withColumn("claim_id", F.col("_open.claim_id"))
    winners = (
        checked.filter(F.col("_reason").isNull())
        .groupBy("job_id", "claim_id")
        .agg(F.min(F.struct("ts", "event_id")).alias("_winner"))
    )
    closed = F.col("_reason").isNull() & (F.struct("ts", "event_id") != F.col("_winner"))
    return checked.join(winners, ["job_id", "claim_id"], "left").select(
        "job_id",
        "event_id",
        "ts",
        "claim_id",
        F.when(closed, "already_closed")
        .otherwise(F.coalesce(F.col("_reason"), F.lit("valid")))
        .alias("verdict"),
    )


def stale_queued(
    jobs: DataFrame, now: datetime | str, grace_seconds: int = 10, limit: int = 50
) -> DataFrame:
    """Oldest queued jobs that nobody picked up; ties by id."""
    cutoff = instant(now) - F.make_dt_interval(secs=F.lit(grace_seconds))
    return (
        jobs.filter((F.col("status") == "queued") & (F.col("updated_at") <= cutoff))
        .orderBy("updated_at", "id")
        .limit(max(0, limit))
        .select("id", "updated_at")
    )


def recover_expired(
    jobs: DataFrame,
    steps: DataFrame,
    now: datetime | str,
    cutoff: datetime | str,
    max_attempts: int,
) -> tuple[DataFrame, DataFrame]:
    """Jobs and steps after the recovery of expired leases."""
    expired = (F.col("status") == "processing") & F.coalesce(
        F.col("lease_expires_at") <= instant(now), F.lit(False)
    )
    flagged = jobs.withColumn("_expired", expired).withColumn(
        "_requeued", expired & (F.col("attempt") < max_attempts)
    )
    hit = F.col("_expired")
    updated = flagged.withColumns(
        {
            "status": F.when(F.col("_requeued"), "queued")
            .when(hit, "failed")
            .otherwise(F.col("status")),
            "owner_id": F.when(~hit, F.col("owner_id")),
            "lease_expires_at": F.when(~hit, F.col("lease_expires_at")),
            "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version")),
            "updated_at": F.when(hit, instant(now)).otherwise(F.col("updated_at")),
        }
    ).drop("_expired", "_requeued")
    requeued = flagged.filter("_requeued").select(
        F.col("id").alias("job_id"), F.lit(True).alias("_requeued")
    )
    stop = (
        F.coalesce(F.col("_requeued"), F.lit(False))
        & (F.col("status") == "running")
        & F.coalesce(F.col("started_at") <= instant(cutoff), F.lit(False))
    )
    marked = attach(
        steps, requeued, ["job_id"], F.struct("name", "started_at")
    ).withColumn("_stop", stop)
    hit = F.col("_stop")
    stopped = marked.withColumns(
        {
            "status": F.when(hit, "failed").otherwise(F.col("status")),
            "completed_at": F.when(hit, instant(now)).otherwise(F.col("completed_at")),
            "retry_count": F.when(hit, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "error": F.when(hit, LEASE_EXPIRED).otherwise(F.col("error")),
        }
    ).drop("_stop", "_requeued")
    return updated, stopped


def recovery_report(attempts: DataFrame, keys: Sequence[str] = ("cycle",)) -> DataFrame:
    """Counts per recovery cycle from rows with an ``outcome``."""
    count = lambda value: F.count_if(F.col("outcome") == value)
    return attempts.groupBy(*keys).agg(
        count("recovered").alias("recovered_to_queued"),
        count("redispatched").alias("redispatched"),
        count("dispatch_failed").alias("dispatch_failures"),
    )


def failure_streaks(
    report: DataFrame, keys: Sequence[str], order: str, block: Column, threshold: int = 5
) -> DataFrame:
    """Run length of failing cycles; a redispatch resets it, an idle cycle keeps it."""
    failing = (F.col("dispatch_failures") > 0) & (F.col("redispatched") == 0)
    reset = F.col("redispatched") > 0
    counted = running_sums(
        report, keys, [order], block, {"_failed": failing.cast("bigint")}
    )
    based = last_known(
        counted, keys, [order], block, {"_base": F.when(reset, F.col("_failed"))}
    )
    streak = F.col("_failed") - F.coalesce(F.col("_base"), F.lit(0))
    return based.select(
        *report.columns, streak.alias("streak"), (failing & (streak >= threshold)).alias("alarm")
    )


# --- steps, views, audits ------------------------------------------------------------------


def step_durations(steps: DataFrame) -> DataFrame:
    """Milliseconds per finished step, never negative."""
    gap = F.unix_micros("completed_at") - F.unix_micros("started_at")
    whole = F.greatest(F.lit(0), F.floor(gap / F.lit(1000.0))).cast("bigint")
    millis = F.when(gap.isNotNull(), whole)
    return steps.withColumn("duration_ms", millis)


def step_summary(steps: DataFrame, bucket_ms: float = 1000.0) -> DataFrame:
    """Counts, retries and exact duration quantiles per stage."""
    timed = step_durations(steps)
    summary = timed.groupBy("name").agg(
        F.count("*").alias("steps"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("retry_count").cast("bigint").alias("retries"),
        F.avg("duration_ms").alias("mean_ms"),
    )
    quantiles = exact_quantiles(
        timed, ["name"], "duration_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, bucket_ms
    )
    return summary.join(quantiles, "name", "left")


def job_view(jobs: DataFrame, specs: DataFrame, settings: DataFrame) -> DataFrame:
    """Jobs with their documents; ``{}`` stands for the defaults when there is none."""
    design = specs.select(F.col("job_id").alias("id"), F.col("document").alias("design_spec"))
    output = settings.select(
        F.col("job_id").alias("id"), F.col("document").alias("processing_settings")
    )
    joined = jobs.join(design, "id", "left").join(output, "id", "left")
    return joined.withColumns(
        {n: F.coalesce(n, F.lit("{}")) for n in ("design_spec", "processing_settings")}
    )


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Child rows whose parent is missing; a null key is no reference."""
    parents = parent.select(F.col(parent_key).alias(key)).distinct()
    return child.filter(F.col(key).isNotNull()).join(parents, key, "left_anti")


def ai_run_audit(runs: DataFrame, models: DataFrame) -> DataFrame:
    """First problem of each model run: unknown, disabled, incapable or unverified."""
    facts = models.select(
        F.col("name").alias("model_id"),
        "enabled",
        "capabilities",
        "weight_sha256",
        "commercial_allowed",
        "verified_at",
        F.lit(True).alias("_known"),
    )
    joined = attach(runs, facts, ["model_id"], F.col("run_id"))
    reason = first_reason(
        no_model=F.col("model_id").isNull(),
        unknown_model=F.col("_known").isNull(),
        disabled=~F.col("enabled"),
        missing_capability=F.col("capability").isNotNull()
        & ~F.array_contains("capabilities", F.col("capability")),
        unverified_weights=F.col("weight_sha256").isNull() | F.col("verified_at").isNull(),
        licence=~F.coalesce(F.col("commercial_allowed"), F.lit(False)),
    )
    return joined.select(*runs.columns, reason.alias("reason"))
