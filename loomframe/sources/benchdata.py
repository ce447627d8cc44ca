"""Media-operations views over the generated benchmark tables.

The benchmark folder has no jobs or frames, so each view derives one from a given
table; every view grows with its table. ``SQL`` holds the same rules for the
cross-check engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators.ordered import attach, id_block, numbered, time_block


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Packed 4x4 RGBA frames: one clip per embedding label."""
    rows = table(spark, folder, "embeddings").select(
        F.col("label").cast("bigint").alias("clip_id"),
        "vec_id",
        F.transform(
            "embedding",
            lambda v: F.floor(
                F.least(
                    F.greatest((v.cast("double") + 0.6) / 1.2, F.lit(0.0)), F.lit(1.0)
                )
                * 255
            ).cast("int"),
        ).alias("rgba"),
    )
    numbered_rows = numbered(rows, ["clip_id"], ["vec_id"], id_block("vec_id"), "frame_no")
    return numbered_rows.select(
        "clip_id",
        (F.col("frame_no") - 1).alias("frame_idx"),
        F.lit(4).alias("width"),
        F.lit(4).alias("height"),
        (F.lit(20) + 10 * (F.col("vec_id") % 4)).cast("int").alias("duration_ms"),
        "rgba",
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    status = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "created")
        .when(F.col("o_orderstatus") == "O", "queued")
        .when(F.col("o_orderstatus") == "P", "processing")
        .otherwise("completed")
    )
    attempt = (F.col("o_orderkey") % 4).cast("int")
    when = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        attempt.alias("version"),
        attempt.alias("attempt"),
        (F.col("o_custkey") % 5).alias("owner_id"),
        (when + F.expr("INTERVAL 10 MINUTES")).alias("lease_expires_at"),
        F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("file_size_bytes"),
        F.col("o_custkey").alias("submitted_by"),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderkey") % 97).alias(
            "source_message_id"
        ),
        when.alias("updated_at"),
    )


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    content = F.concat_ws(
        "|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    )
    return li.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_returnflag").alias("type"),
        F.concat(F.lit("out/"), F.col("l_linenumber").cast("string"), F.lit(".gif")).alias(
            "storage_path"
        ),
        F.when(F.col("l_linestatus") == "O", "image/gif").otherwise("image/png").alias("mime_type"),
        F.floor("l_extendedprice").cast("bigint").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"),
        F.col("l_shipdate").cast("timestamp").alias("expires_at"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("source_id"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    status = (
        F.when(F.col("event_type") == "signup", "created")
        .when(F.col("event_type") == "view", "queued")
        .when(F.col("event_type") == "click", "processing")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("failed")
    )
    return e.select(
        F.col("user_id").alias("job_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"),
        "value",
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    state = (
        F.when(kind == "signup", "intent")
        .when(kind == "view", "sent")
        .when(kind == "click", "failed")
        .when(kind == "purchase", "unknown")
        .otherwise("terminal")
    )
    rows = e.select(
        F.col("user_id").alias("job_id"),
        F.get_json_object("props", "$.k").cast("bigint").alias("artifact_id"),
        F.lit("chat").alias("channel"),
        state.alias("state"),
        F.when((kind == "view") | ((kind == "error") & (F.col("value") > 100)), F.col("event_id"))
        .cast("string")
        .alias("external_ref"),
        F.when(~kind.isin("view", "signup"), F.lit("e")).alias("error"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return numbered(
        rows, ["job_id", "artifact_id"], ["ts", "event_id"], time_block("ts"), "attempt"
    )


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    parent = F.when(
        F.col("turn") > 0, F.greatest(F.lit(0), F.col("turn") - 1 - F.col("turn") % 2)
    )
    return c.select(
        F.col("conv_id").alias("project_id"),
        F.col("turn").alias("revision_id"),
        parent.cast("bigint").alias("parent_id"),
        F.col("text").alias("state"),
        F.col("role").alias("command_metadata"),
    )


def track_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Per-user series: position, seconds since the first event, value."""
    e = table(spark, folder, "events").select(
        F.col("user_id").alias("track_id"),
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
    )
    starts = e.groupBy("track_id").agg(F.min("ts").alias("start"))
    rows = numbered(e, ["track_id"], ["ts", "event_id"], time_block("ts"), "rn")
    return attach(rows, starts, ["track_id"], F.col("event_id")).select(
        "track_id",
        "rn",
        ((F.unix_micros("ts") - F.unix_micros("start")) / F.lit(1_000_000.0)).alias("t"),
        F.col("value").alias("v"),
    )


def track_keys(spark: SparkSession, folder: str) -> DataFrame:
    return track_rows(spark, folder).filter(F.col("rn") % 5 == 1).select("track_id", "t", "v")


def track_samples(spark: SparkSession, folder: str) -> DataFrame:
    return track_rows(spark, folder).filter(F.col("rn") % 5 != 1).select("track_id", "rn", "t")


# The same views for the cross-check engine, one common table expression each.
SQL: dict[str, str] = {
    "frames": """frames AS (
        SELECT CAST(label AS BIGINT) AS clip_id,
               row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx,
               4 AS width, 4 AS height,
               CAST(20 + 10 * (vec_id % 4) AS INTEGER) AS duration_ms,
               list_transform(embedding, lambda v: CAST(floor(least(greatest(
                   (CAST(v AS DOUBLE) + CAST(0.6 AS DOUBLE)) / CAST(1.2 AS DOUBLE),
                   CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) * 255) AS INTEGER)) AS rgba
        FROM embeddings)""",
    "pixels8": """pixels8 AS (
        SELECT clip_id, frame_idx, p // 4 AS y, p % 4 AS x,
               rgba[4 * p + 1] AS r, rgba[4 * p + 2] AS g,
               rgba[4 * p + 3] AS b, rgba[4 * p + 4] AS a
        FROM (SELECT *, unnest(range(16)) AS p FROM frames))""",
    "pixels": """pixels AS (
        SELECT clip_id, frame_idx, y, x, CAST(r AS DOUBLE) / 255 AS r,
               CAST(g AS DOUBLE) / 255 AS g, CAST(b AS DOUBLE) / 255 AS b,
               CAST(a AS DOUBLE) / 255 AS a
        FROM pixels8)""",
    "jobs": """jobs AS (
        SELECT o_orderkey AS id,
               CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'created'
                    WHEN o_orderstatus = 'O' THEN 'queued'
                    WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'completed' END AS status,
               CAST(o_orderkey % 4 AS INTEGER) AS version,
               CAST(o_orderkey % 4 AS INTEGER) AS attempt,
               o_custkey % 5 AS owner_id,
               o_orderdate + INTERVAL 10 MINUTE AS lease_expires_at,
               CAST(floor(o_totalprice * 100) AS BIGINT) AS file_size_bytes,
               o_custkey AS submitted_by,
               CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey % 97 END AS source_message_id,
               o_orderdate AS updated_at
        FROM orders)""",
    "artifacts": """artifacts AS (
        SELECT l_orderkey AS job_id, l_returnflag AS type,
               'out/' || CAST(l_linenumber AS VARCHAR) || '.gif' AS storage_path,
               CASE WHEN l_linestatus = 'O' THEN 'image/gif' ELSE 'image/png' END AS mime_type,
               CAST(floor(l_extendedprice) AS BIGINT) AS size_bytes,
               sha256(CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)) AS sha256,
               l_shipdate AS expires_at, l_partkey AS part_id, l_suppkey AS source_id
        FROM lineitem)""",
    "history": """history AS (
        SELECT user_id AS job_id, event_id, ts,
               CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'queued'
                    WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
                    ELSE 'failed' END AS status,
               value
        FROM events)""",
    "deliveries": """deliveries AS (
        SELECT user_id AS job_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS artifact_id,
               'chat' AS channel,
               CASE event_type WHEN 'signup' THEN 'intent' WHEN 'view' THEN 'sent'
                    WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'unknown'
                    ELSE 'terminal' END AS state,
               CASE WHEN event_type = 'view' OR (event_type = 'error' AND value > 100)
                    THEN CAST(event_id AS VARCHAR) END AS external_ref,
               CASE WHEN event_type NOT IN ('view', 'signup') THEN 'e' END AS error,
               event_id, ts,
               row_number() OVER (PARTITION BY user_id,
                   CAST(json_extract_string(props, '$.k') AS BIGINT)
                   ORDER BY ts, event_id) AS attempt
        FROM events)""",
    "revisions": """revisions AS (
        SELECT conv_id AS project_id, turn AS revision_id,
               CASE WHEN turn > 0 THEN greatest(0, turn - 1 - turn % 2) END AS parent_id,
               text AS state, role AS command_metadata
        FROM conversations)""",
    "track_rows": """track_rows AS (
        SELECT user_id AS track_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
               CAST(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)) AS DOUBLE)
                   / 1000000 AS t,
               value AS v
        FROM events)""",
    "track_keys": """track_keys AS (
        SELECT track_id, t, v FROM track_rows WHERE rn % 5 = 1)""",
    "track_samples": """track_samples AS (
        SELECT track_id, rn, t FROM track_rows WHERE rn % 5 <> 1)""",
    "segments": """segments AS (
        SELECT track_id, t AS t0, v AS v0,
               lead(t) OVER (PARTITION BY track_id ORDER BY t) AS t1,
               lead(v) OVER (PARTITION BY track_id ORDER BY t) AS v1
        FROM track_keys)""",
}

_NEEDS = {
    "pixels8": ["frames"],
    "pixels": ["pixels8"],
    "track_keys": ["track_rows"],
    "track_samples": ["track_rows"],
    "segments": ["track_keys"],
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views and what they need, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(SQL[name] for name in ordered)
