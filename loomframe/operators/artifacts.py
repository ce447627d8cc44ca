"""Artifact registry: registration, conflicts, retention, hygiene, deliveries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.numeric import first_reason, violations
from loomframe.operators.jobs import instant
from loomframe.operators.ordered import attach, earliest_rows, latest_rows

IDENTITY = ["job_id", "type", "storage_path"]
CONTENT = ["sha256", "size_bytes", "mime_type"]
DELIVERY = ["job_id", "artifact_id", "channel"]
#: Slots in which incoming identities are counted, and rows of a slot from which it is spread.
SLOTS = 1 << 20
CROWDED = 100_000
# Media types by file extension.
MIME_TYPES = {
    "gif": "image/gif",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "webp": "image/webp",
    "mp4": "video/mp4",
    "webm": "video/webm",
    "mov": "video/quicktime",
    "json": "application/json",
    "txt": "text/plain",
}


def _slot() -> Column:
    return F.pmod(F.xxhash64(*IDENTITY), F.lit(SLOTS)).cast("int")


def judge_artifacts(
    existing: DataFrame,
    incoming: DataFrame,
    order: Sequence[str],
    cells: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Incoming rows with the ``outcome`` insert or conflict and the ``registered_sha256``.

    The rows are shuffled once, whole, and each identity is read in order behind its
    registered row. Only slots of identities that hold more than ``CROWDED`` rows, which
    are counted beforehand, are combined on the map side and spread. ``cells`` names
    expressions of the identity by which the result is dealt out.
    """
    cells = cells or {}
    counts = incoming.groupBy(_slot().alias("slot")).count()
    # At most one slot per CROWDED rows.
    crowded = [r.slot for r in counts.filter(F.col("count") > CROWDED).collect()]
    if not crowded:
        return _in_order(existing, incoming, order, cells)
    apart = _slot().isin(crowded)
    ordered = _in_order(existing.filter(~apart), incoming.filter(~apart), order, cells)
    spread = _combined(existing.filter(apart), incoming.filter(apart), order).withColumns(cells)
    both = ordered.unionByName(spread)
    return both.repartition(*cells) if cells else both


def _registered(existing: DataFrame) -> DataFrame:
    content = F.struct(*CONTENT).alias("_old")
    latest = latest_rows(existing.select(*IDENTITY, "created_at", content), IDENTITY, ["created_at"])
    return latest.drop("created_at")


def _in_order(
    existing: DataFrame, incoming: DataFrame, order: Sequence[str], cells: Mapping[str, Column]
) -> DataFrame:
    content = F.struct(*CONTENT)
    # An identity with a null equals no other, neither a registered nor a disputed one.
    whole = F.lit(True)
    for c in IDENTITY:
        whole = whole & F.col(c).isNotNull()
    rows = incoming.unionByName(_registered(existing).filter(whole), allowMissingColumns=True)
    if cells:
        rows = rows.withColumns(cells).repartition(*cells)
    rest = [c for c in incoming.columns if c not in IDENTITY and c not in order]
    window = Window.partitionBy(*cells, *IDENTITY).orderBy(F.col("_old").isNull(), *order, *rest)
    until = window.rowsBetween(Window.unboundedPreceding, 0)
    judged = rows.withColumns(
        {
            "_first": F.lag(F.lit(True)).over(window).isNull(),
            "_wins": F.first(F.coalesce("_old", content)).over(until),
        }
    ).filter(F.col("_old").isNull())
    outcome = F.when(F.col("_first"), "insert").when(
        whole & ~content.eqNullSafe(F.col("_wins")), "conflict"
    )
    return judged.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull()).select(
        *incoming.columns, *cells, "outcome", F.col("_wins.sha256").alias("registered_sha256")
    )


def _combined(existing: DataFrame, incoming: DataFrame, order: Sequence[str]) -> DataFrame:
    """The same for identities with many rows each."""
    content = F.struct(*CONTENT)
    # One row per identity: the first incoming row, and whether all contents are equal.
    rest = [c for c in incoming.columns if c not in IDENTITY and c not in order]
    arrived = incoming.groupBy(*IDENTITY).agg(
        F.min(F.struct(*order, *rest)).alias("_first"),
        F.min(content).alias("_low"),
        F.max(content).alias("_high"),
    )
    owners = arrived.join(_registered(existing), IDENTITY, "left")
    inserts = owners.filter(F.col("_old").isNull()).select(*IDENTITY, "_first.*")
    winner = F.coalesce("_old", F.struct(*[F.col(f"_first.{c}").alias(c) for c in CONTENT]))
    # Only identities with differing contents have rows to look at again.
    disputed = owners.select(*IDENTITY, winner.alias("_wins"), "_low", "_high").filter(
        ~(F.col("_low").eqNullSafe(F.col("_wins")) & F.col("_high").eqNullSafe(F.col("_wins")))
    )
    compared = attach(
        incoming, disputed.select(*IDENTITY, "_wins"), IDENTITY, F.struct(*order), how="inner"
    )
    conflicts = compared.filter(~content.eqNullSafe(F.col("_wins"))).select(
        *incoming.columns,
        F.lit("conflict").alias("outcome"),
        F.col("_wins.sha256").alias("registered_sha256"),
    )
    return inserts.select(
        *incoming.columns, F.lit("insert").alias("outcome"), F.col("sha256").alias("registered_sha256")
    ).unionByName(conflicts)


def register_artifacts(
    existing: DataFrame, incoming: DataFrame, order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """New identities to append, and incoming rows that contradict their identity.

    The registered row of an identity wins over all incoming ones; among incoming rows
    the first by ``order`` wins. Equal content is a repeat and appears in neither.
    """
    judged = judge_artifacts(existing, incoming, order)
    inserts = judged.filter(F.col("outcome") == "insert").select(*incoming.columns)
    conflicts = judged.filter(F.col("outcome") == "conflict").drop("outcome")
    return inserts, conflicts


def artifact_conflicts(artifacts: DataFrame) -> DataFrame:
    """Identities that were registered with more than one content."""
    versions = artifacts.groupBy(*IDENTITY, *CONTENT).agg(F.count("*").alias("_n"))
    return (
        versions.groupBy(*IDENTITY)
        .agg(F.sum("_n").alias("rows"), F.count("*").alias("versions"))
        .filter(F.col("versions") > 1)
    )


def expired_artifacts(artifacts: DataFrame, now: datetime | str) -> DataFrame:
    """Deletion plan, oldest first."""
    return artifacts.filter(F.col("expires_at") <= instant(now)).orderBy("expires_at")


def retained_artifacts(artifacts: DataFrame, now: datetime | str) -> DataFrame:
    return artifacts.filter(
        F.col("expires_at").isNull() | (F.col("expires_at") > instant(now))
    )


def job_artifacts(
    artifacts: DataFrame, artifact_type: str | None = None, order: str = "created_at"
) -> DataFrame:
    """Newest row per identity, optionally of one type."""
    if artifact_type is not None:
        artifacts = artifacts.filter(F.col("type") == artifact_type)
    rest = [c for c in artifacts.columns if c not in (*IDENTITY, order)]
    return latest_rows(artifacts, IDENTITY, [order, *sorted(rest)])


def content_duplicates(df: DataFrame, content: Column, key: str) -> DataFrame:
    """Contents that occur more than once, by SHA-256."""
    return (
        df.groupBy(F.sha2(content, 256).alias("sha256"))
        .agg(F.count("*").alias("copies"), F.min(key).alias("first_key"))
        .filter(F.col("copies") > 1)
    )


def artifact_hygiene(artifacts: DataFrame) -> DataFrame:
    """Names that are paths, and media types that contradict the extension."""
    name = F.col("name")
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    table = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    extension = F.lower(F.regexp_extract(base, r"[^.]\.([A-Za-z0-9]+)$", 1))
    expected = F.when(extension != "", F.try_element_at(table, extension))
    unsafe = (name != base) | name.isin("", ".", "..")
    return artifacts.withColumns(
        {
            "expected_mime": expected,
            "reason": first_reason(
                unsafe_name=unsafe,
                mime_mismatch=F.coalesce(expected != F.col("mime_type"), F.lit(False)),
            ),
        }
    )


# --- deliveries ------------------------------------------------------------------------------


def first_intents(deliveries: DataFrame, order: Sequence[str]) -> DataFrame:
    return earliest_rows(
        deliveries.filter(F.col("state") == "intent"), DELIVERY, order
    )


def delivery_decision(
    requests: DataFrame, deliveries: DataFrame, order: Sequence[str], max_attempts: int = 3
) -> DataFrame:
    """What to do with each delivery request, from the latest record of its identity."""
    latest = latest_rows(
        deliveries.select(*DELIVERY, *order, "state", "attempt"), DELIVERY, order
    ).select(*DELIVERY, "state", "attempt")
    state = F.col("state")
    decision = (
        F.when(state.isNull(), "send")
        .when(state == "sent", "skip_sent")
        .when(state == "terminal", "give_up")
        .when((state == "failed") & (F.col("attempt") < max_attempts), "retry")
        .when(state == "failed", "give_up")
        .otherwise("hold")
    )
    return requests.join(latest, DELIVERY, "left").select(
        *requests.columns, "state", "attempt", decision.alias("decision")
    )


def delivery_violations(deliveries: DataFrame) -> DataFrame:
    """Names of the broken record rules; rows that break none are left out."""
    state = F.col("state")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    broken = violations(
        channel=blank("channel"),
        attempt=F.col("attempt") < 1,
        sent_needs_ref=(state == "sent") & blank("external_ref"),
        error_needed=state.isin("failed", "unknown", "terminal") & blank("error"),
        ref_not_allowed=(state != "sent") & F.col("external_ref").isNotNull(),
    )
    return deliveries.withColumn("violations", broken).filter(F.size("violations") > 0)
