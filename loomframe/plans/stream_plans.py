"""Registered streaming queries: a table is read as a stream to its end.

Results are written to a table and read back, so they never gather in the driver. The
cross-check SQL states what a complete run must have produced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.operators import artifacts as art
from loomframe.plans.common import micros, six
from loomframe.sources import benchdata as data
from loomframe.sources.documents import write_reports
from loomframe.sources.tables import SCHEMAS, read_ops
from loomframe.sources.benchdata import with_views
from loomframe.streaming import events as ev
from loomframe.streaming import machines, sinks

EVENT_COLUMNS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING"
)
ITEM_COLUMNS = (
    "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_extendedprice DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"
)


def _stream(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{table}.parquet")
        .parquet(folder)
    )


def _events(spark: SparkSession, folder: str) -> DataFrame:
    rows = _stream(spark, folder, "events", EVENT_COLUMNS)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    target = sinks.work_folder(spark)
    sinks.run_to_table(stream, target)
    return spark.read.parquet(f"{target}/rows")


def _stages(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, folder).select(
        F.when(kind.isin("signup", "view", "click"), "stage_started")
        .when(kind == "purchase", "stage_completed")
        .otherwise("stage_failed")
        .alias("event"),
        F.concat(F.lit("s"), (F.get_json_object("props", "$.k").cast("bigint") % 3).cast("string")).alias(
            "stage"
        ),
        F.col("user_id").cast("string").alias("job_id"),
        "ts",
    )


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    session = sinks.state_session(spark)
    rows = _events(session, folder).select(
        "event_id",
        "ts",
        F.col("user_id").alias("submitted_by"),
        F.when(F.col("event_type") != "error", F.floor("value").cast("bigint")).alias(
            "source_message_id"
        ),
    )
    kept = _finished(spark, ev.stream_dedup(rows, "40 days"))
    # Which copy stays depends on arrival; the keys that stay do not.
    return kept.groupBy("submitted_by", "source_message_id").agg(F.count("*").alias("kept"))


def _with_rest(spark: SparkSession, stream: DataFrame, rules) -> DataFrame:
    """All a finished stream gave, and what its end left in the state."""
    target = sinks.work_folder(spark)
    sinks.run_to_table(stream, target)
    rest = machines.drain(sinks.state_session(spark), f"{target}/checkpoint", rules)
    return spark.read.schema(stream.schema).parquet(f"{target}/rows").unionByName(rest)


def stream_stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    """Ended stages, and starts whose end can no longer come with a null outcome."""
    session = sinks.state_session(spark)
    paired = ev.stream_stage_durations(_stages(session, folder), "1 hour", "12 hours")
    return micros(_finished(spark, paired), "started_at")


def stream_stage_unfinished(spark: SparkSession, folder: str) -> DataFrame:
    """The other half of the durations: starts whose end can no longer come."""
    session = sinks.state_session(spark)
    paired = ev.stream_stage_durations(_stages(session, folder), "1 hour", "12 hours")
    lost = _finished(spark, paired).filter(F.col("outcome").isNull())
    return micros(lost, "started_at").select("job_id", "stage", "started_at")


def stream_stage_rates(spark: SparkSession, folder: str) -> DataFrame:
    session = sinks.state_session(spark)
    rates = ev.stream_stage_rates(_stages(session, folder), "2 hours", "6 hours", "3 hours")
    return six(micros(_finished(spark, rates), "window_start", "window_end"), "failure_rate")


def stream_jobs(spark: SparkSession, folder: str) -> DataFrame:
    session = sinks.state_session(spark)
    kind = F.col("event_type")
    rows = _events(session, folder).select(
        F.col("user_id").alias("job_id"),
        "event_id",
        "ts",
        F.when(kind == "signup", "created")
        .when(kind == "view", "queued")
        .when(kind == "click", "processing")
        .when((kind == "purchase") & (F.col("event_id") % 5 == 0), "completed")
        .otherwise("queued")
        .alias("status"),
    )
    followed = machines.stream_jobs(rows, "1 hour", 36_000, 3)
    return _with_rest(spark, followed, machines.JobRules(36_000, 3))


def stream_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    session = sinks.state_session(spark)
    kind = F.col("event_type")
    rows = _events(session, folder).select(
        F.col("user_id").alias("job_id"),
        (F.get_json_object("props", "$.k").cast("bigint") % 8).alias("artifact_id"),
        "event_id",
        "ts",
        F.when(kind.isin("signup", "view"), "intent")
        .when((kind == "purchase") & (F.col("value") > 40), "sent")
        .when((kind == "error") & (F.col("value") > 60), "terminal")
        .when((kind == "error") & (F.col("value") > 50), "unknown")
        .otherwise("failed")
        .alias("state"),
    )
    followed = machines.stream_deliveries(rows, 3, "1 hour")
    return _with_rest(spark, followed, machines.DeliveryRules(3))


def stream_register(spark: SparkSession, folder: str) -> DataFrame:
    session = sinks.state_session(spark)
    li = _stream(session, folder, "lineitem", ITEM_COLUMNS)
    content = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    rows = li.select(
        F.col("l_orderkey").alias("job_id"),
        F.col("l_returnflag").alias("type"),
        F.concat(F.lit("out/"), F.col("l_linenumber").cast("string"), F.lit(".gif")).alias(
            "storage_path"
        ),
        F.when(F.col("l_linestatus") == "O", "image/gif").otherwise("image/png").alias("mime_type"),
        F.floor("l_extendedprice").cast("bigint").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("source_id"),
    )
    target = sinks.work_folder(spark)
    order = ["created_at", "part_id", "source_id", "size_bytes"]
    sinks.stream_register(rows, f"{target}/registry", f"{target}/checkpoint", order)
    inserts = spark.read.parquet(f"{target}/registry/inserts")
    conflicts = spark.read.parquet(f"{target}/registry/conflicts")
    return inserts.select(*art.IDENTITY, "sha256", F.lit("insert").alias("outcome")).unionByName(
        conflicts.select(*art.IDENTITY, "sha256", F.lit("conflict").alias("outcome"))
    )


def stream_event_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines, some of them broken, and read as a stream."""
    session = sinks.state_session(spark)
    target = sinks.work_folder(spark)
    e = data.table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "view", "stage_started").when(
        F.col("event_type") == "click", "stage_failed"
    )
    line = F.to_json(
        F.struct(
            F.coalesce(kind, F.col("event_type")).alias("event"),
            F.lit("render").alias("stage"),
            F.col("user_id").cast("string").alias("job_id"),
            F.col("event_id").alias("duration_ms"),
        )
    )
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(line, F.lit("{"))).otherwise(line)
    e.select(broken.alias("value")).write.text(f"{target}/in")
    rows = ev.stream_stage_events(session, f"{target}/in")
    sinks.run_to_table(rows, target)
    return spark.read.parquet(f"{target}/rows").select(
        "event", "stage", "job_id", "duration_ms", "reason", "line"
    )


def job_table_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The job table written once with its fixed schema and scanned again."""
    target = sinks.work_folder(spark)
    o = data.table(spark, folder, "orders")
    when = F.col("o_orderdate").cast("timestamp")
    text = F.col("o_orderkey").cast("string")
    columns = {
        "id": text,
        "status": F.when(F.col("o_orderstatus") == "F", "completed").otherwise("queued"),
        "version": F.lit(0),
        "attempt": F.lit(0),
        "telegram_file_id": text,
        "file_size_bytes": F.floor("o_totalprice").cast("int"),
        "submitted_by": F.col("o_custkey"),
        "mode": F.lit("crop_only"),
        "created_at": when,
        "updated_at": when,
    }
    names = [field.split()[0] for field in SCHEMAS["processing_jobs"].split(", ")]
    kinds = {field.split()[0]: field.split()[1] for field in SCHEMAS["processing_jobs"].split(", ")}
    o.select(
        *[columns.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names]
    ).write.parquet(f"{target}/jobs")
    jobs = read_ops(spark, f"{target}/jobs", "processing_jobs")
    return micros(
        jobs.select(
            "id", "status", "file_size_bytes", "submitted_by", "owner_id", "updated_at"
        ),
        "updated_at",
    )


# Columns of the other operational tables as SQL over orders that both engines read alike;
# columns that are not named stay null.
_TEXT_KEY = "CAST(o_orderkey AS STRING)"
OPS_ROWS: dict[str, dict[str, str]] = {
    "delivery_log": {
        "id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "artifact_id": "concat('a', CAST(o_orderkey % 9 AS STRING))",
        "channel": "'chat'", "state": "CASE WHEN o_orderstatus = 'F' THEN 'sent' ELSE 'intent' END",
        "attempt": "o_orderkey % 3 + 1", "external_ref": "CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END",
        "created_at": "o_orderdate", "updated_at": "o_orderdate",
    },
    "artifacts": {
        "artifact_id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "type": "'gif'",
        "storage_path": f"concat('out/', {_TEXT_KEY}, '.gif')", "mime_type": "'image/gif'",
        "size_bytes": "floor(o_totalprice)", "sha256": f"sha256({_TEXT_KEY})", "created_at": "o_orderdate",
        "expires_at": "CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END", "metadata": "'{}'",
    },
    "job_steps": {
        "id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "name": "o_orderpriority",
        "status": "CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END", "started_at": "o_orderdate",
        "duration_ms": "CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 1000 END", "retry_count": "o_orderkey % 2",
        "error": "CASE WHEN o_orderkey % 5 = 0 THEN 'E' END",
    },
    "design_specs": {
        "id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "schema_version": "o_orderkey % 3 + 1",
        "document": f"concat('{{\"n\":', {_TEXT_KEY}, '}}')",
    },
    "processing_settings": {
        "id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "schema_version": "1",
        "document": "concat('{\"fps\":', CAST(o_orderkey % 30 AS STRING), '}')",
    },
    "ai_executions": {
        "id": _TEXT_KEY, "job_id": "CAST(o_custkey AS STRING)", "provider": "'local'",
        "model_id": "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END",
        "duration_ms": "CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 5000 END", "status": "'completed'", "metadata": "'{}'",
    },
}


def _ops_columns(name: str) -> list[tuple[str, str, str]]:
    """Name, type and rule of each column of an operational table."""
    fields = [field.split()[:2] for field in SCHEMAS[name].split(", ")]
    return [(column, kind, OPS_ROWS[name].get(column, "NULL")) for column, kind in fields]


def _ops_scan(name: str):
    """Query that writes one operational table with its fixed schema and scans all of it again."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        target = sinks.work_folder(spark)
        columns = _ops_columns(name)
        own = lambda rule: rule.replace(f"sha256({_TEXT_KEY})", f"sha2({_TEXT_KEY}, 256)")
        rules = [f"CAST({own(rule)} AS {kind}) AS {column}" for column, kind, rule in columns]
        data.table(spark, folder, "orders").selectExpr(*rules).write.parquet(f"{target}/{name}")
        times = [column for column, kind, _ in columns if kind == "TIMESTAMP"]
        return micros(read_ops(spark, f"{target}/{name}", name), *times)

    return query


def _ops_sql(name: str) -> str:
    shown = [
        f"epoch_us(CAST({rule} AS TIMESTAMP)) AS {column}" if kind == "TIMESTAMP"
        else f"CAST({rule} AS {kind}) AS {column}"
        for column, kind, rule in _ops_columns(name)
    ]
    return f"SELECT {', '.join(shown)} FROM orders"


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Reports of all orders written as JSON lines and read back as text."""
    target = sinks.work_folder(spark)
    li = data.table(spark, folder, "lineitem")
    reports = li.groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.count("*").alias("frame_count"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("returned"),
    )
    write_reports(reports, f"{target}/reports")
    return spark.read.text(f"{target}/reports")


QUERIES = {
    "stream_event_lines": stream_event_lines,
    "job_table_scan": job_table_scan,
    **{f"{name}_scan": _ops_scan(name) for name in OPS_ROWS},
    "report_lines": report_lines,
    "stream_dedup": stream_dedup,
    "stream_stage_durations": stream_stage_durations,
    "stream_stage_unfinished": stream_stage_unfinished,
    "stream_stage_rates": stream_stage_rates,
    "stream_jobs": stream_jobs,
    "stream_deliveries": stream_deliveries,
    "stream_register": stream_register,
}

_STAGES = """stages AS (
    SELECT CASE WHEN event_type IN ('signup', 'view', 'click') THEN 'stage_started'
                WHEN event_type = 'purchase' THEN 'stage_completed' ELSE 'stage_failed' END AS event,
           's' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS stage,
           CAST(user_id AS VARCHAR) AS job_id, ts FROM events)"""

ORACLES = {
    **{f"{name}_scan": _ops_sql(name) for name in OPS_ROWS},
    "stream_event_lines": """WITH l AS (
        SELECT event_id, CASE event_type WHEN 'view' THEN 'stage_started'
               WHEN 'click' THEN 'stage_failed' ELSE event_type END AS event, user_id FROM events),
    t AS (SELECT *, '{"event":"' || event || '","stage":"render","job_id":"' || user_id
                 || '","duration_ms":' || event_id || '}'
                 || CASE WHEN event_id % 10 = 0 THEN '{' ELSE '' END AS line,
                 CASE WHEN event_id % 10 = 0 THEN 'malformed'
                      WHEN event NOT LIKE 'stage%' THEN 'unknown_event' END AS reason FROM l)
    SELECT event, 'render' AS stage, CAST(user_id AS VARCHAR) AS job_id, event_id AS duration_ms,
           reason, CASE WHEN reason IS NOT NULL THEN line END AS line FROM t""",
    "job_table_scan": """SELECT CAST(o_orderkey AS VARCHAR) AS id,
               CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'queued' END AS status,
               CAST(floor(o_totalprice) AS INTEGER) AS file_size_bytes, o_custkey AS submitted_by,
               CAST(NULL AS VARCHAR) AS owner_id, epoch_us(o_orderdate) AS updated_at
        FROM orders""",
    "report_lines": """SELECT '{"frame_count":' || count(*) || ',"job_id":' || l_orderkey
               || ',"returned":' || coalesce(CAST(max(l_linenumber) FILTER (l_returnflag = 'R')
               AS VARCHAR), 'null') || '}' AS value
        FROM lineitem GROUP BY l_orderkey""",
    "stream_dedup": """WITH k AS (
        SELECT user_id AS submitted_by, CASE WHEN event_type <> 'error'
               THEN CAST(floor(value) AS BIGINT) END AS source_message_id FROM events)
    SELECT submitted_by, source_message_id,
           CASE WHEN source_message_id IS NULL THEN count(*) ELSE 1 END AS kept
    FROM k GROUP BY submitted_by, source_message_id""",
    "stream_stage_durations": f"""WITH {_STAGES}, seen AS (
        SELECT least(max(ts) FILTER (event = 'stage_started'),
                     max(ts) FILTER (event <> 'stage_started')) AS ts FROM stages)
    SELECT s.job_id, s.stage, epoch_us(s.ts) AS started_at, e.event AS outcome,
           (epoch_us(e.ts) - epoch_us(s.ts)) // 1000 AS duration_ms
    FROM stages s LEFT JOIN stages e ON e.job_id = s.job_id AND e.stage = s.stage
        AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOUR AND e.event <> 'stage_started'
    WHERE s.event = 'stage_started' AND (e.event IS NOT NULL
        OR epoch_us(s.ts) <= (SELECT (epoch_us(ts) // 1000 - 46800001) * 1000 FROM seen))""",
    "stream_stage_unfinished": f"""WITH {_STAGES}, seen AS (
        SELECT least(max(ts) FILTER (event = 'stage_started'),
                     max(ts) FILTER (event <> 'stage_started')) AS ts FROM stages)
    SELECT s.job_id, s.stage, epoch_us(s.ts) AS started_at FROM stages s
    WHERE s.event = 'stage_started'
        AND epoch_us(s.ts) <= (SELECT (epoch_us(ts) // 1000 - 46800001) * 1000 FROM seen)
        AND NOT EXISTS (SELECT 1 FROM stages e WHERE e.job_id = s.job_id AND e.stage = s.stage
            AND e.event <> 'stage_started' AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 12 HOUR)""",
    "stream_stage_rates": f"""WITH {_STAGES}, w AS (
        SELECT stage, event, unnest([epoch_us(ts) // 10800000000 * 10800000000,
               epoch_us(ts) // 10800000000 * 10800000000 - 10800000000]) AS window_start
        FROM stages WHERE event <> 'stage_started')
    SELECT window_start, window_start + 21600000000 AS window_end, stage, count(*) AS ended,
           count(*) FILTER (event = 'stage_failed') AS failed,
           round(CAST(count(*) FILTER (event = 'stage_failed') AS DOUBLE) / count(*), 6) + 0.0
               AS failure_rate
    FROM w GROUP BY window_start, stage
    HAVING window_start + 21600000000 <= (SELECT epoch_us(max(ts)) - 7200000000 FROM stages
                                          WHERE event <> 'stage_started')""",
    "stream_jobs": """WITH RECURSIVE rows_ AS (
        SELECT user_id AS job_id, event_id, epoch_us(ts) AS us,
               CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'view' THEN 'queued'
                    WHEN event_type = 'click' THEN 'processing'
                    WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'completed'
                    ELSE 'queued' END AS status,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    fold AS (
        SELECT job_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS us,
               CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS start,
               CAST(NULL AS VARCHAR) AS after, CAST(NULL AS VARCHAR) AS verdict,
               0 AS attempt, CAST(NULL AS BIGINT) AS lease,
               CAST(NULL AS BIGINT) AS expired_at, 0 AS expired_attempt
        FROM (SELECT DISTINCT job_id FROM rows_)
        UNION ALL
        SELECT job_id, rn, us, event_id, start,
               CASE WHEN verdict IN ('initial', 'legal', 'rollback') THEN status ELSE start END,
               verdict,
               CASE WHEN verdict IN ('initial', 'legal') AND status = 'processing'
                    THEN attempt + 1 ELSE attempt END,
               CASE WHEN verdict IN ('initial', 'legal', 'rollback') THEN
                    CASE WHEN status = 'processing' THEN us + 36000000000 END ELSE lease END,
               expired_at, attempt
        FROM (SELECT *, CASE WHEN start IS NULL THEN 'initial' WHEN start = status THEN 'unchanged'
                     WHEN (start, status) IN (('created', 'queued'), ('queued', 'processing'),
                          ('processing', 'queued'), ('processing', 'completed')) THEN 'legal'
                     WHEN start = 'queued' AND status = 'created' THEN 'rollback'
                     ELSE 'illegal' END AS verdict
              FROM (SELECT r.job_id, r.rn, r.us, r.event_id, r.status, f.attempt,
                           CASE WHEN f.lease <= r.us THEN
                                CASE WHEN f.attempt >= 3 THEN 'failed' ELSE 'queued' END
                                ELSE f.after END AS start,
                           CASE WHEN f.lease <= r.us THEN f.lease END AS expired_at,
                           CASE WHEN f.lease <= r.us THEN NULL ELSE f.lease END AS lease
                    FROM fold f JOIN rows_ r ON r.job_id = f.job_id AND r.rn = f.rn + 1))),
    last AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rn DESC) = 1)
    SELECT job_id, us AS ts_us, event_id, start AS before, after, verdict, attempt
    FROM fold WHERE rn > 0
    UNION ALL SELECT job_id, expired_at, NULL, 'processing',
           CASE WHEN expired_attempt >= 3 THEN 'failed' ELSE 'queued' END, 'lease_expired',
           expired_attempt FROM fold WHERE expired_at IS NOT NULL
    UNION ALL SELECT job_id, lease, NULL, 'processing',
           CASE WHEN attempt >= 3 THEN 'failed' ELSE 'queued' END, 'lease_expired', attempt
    FROM last WHERE lease // 1000 + 1 <= (SELECT (epoch_us(max(ts)) // 1000) - 3600000 FROM events)""",
    "stream_deliveries": """WITH RECURSIVE rows_ AS (
        SELECT *, row_number() OVER (PARTITION BY job_id, artifact_id ORDER BY ts, event_id) AS rn
        FROM (SELECT user_id AS job_id,
                     CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 AS artifact_id, event_id,
                     ts, CASE WHEN event_type IN ('signup', 'view') THEN 'intent'
                              WHEN event_type = 'purchase' AND value > 40 THEN 'sent'
                              WHEN event_type = 'error' AND value > 60 THEN 'terminal'
                              WHEN event_type = 'error' AND value > 50 THEN 'unknown'
                              ELSE 'failed' END AS state FROM events)),
    fold AS (
        SELECT job_id, artifact_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id,
               CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after,
               CAST(NULL AS VARCHAR) AS verdict, 0 AS attempt
        FROM (SELECT DISTINCT job_id, artifact_id FROM rows_)
        UNION ALL
        SELECT job_id, artifact_id, rn, event_id, s,
               CASE verdict WHEN 'send' THEN 'intent' WHEN 'retry' THEN 'intent'
                    WHEN 'hold' THEN 'unknown' WHEN 'sent' THEN 'sent' WHEN 'failed' THEN 'failed'
                    WHEN 'unknown' THEN 'unknown' WHEN 'terminal' THEN 'terminal' ELSE s END,
               verdict, CASE verdict WHEN 'send' THEN 1 WHEN 'retry' THEN attempt + 1
                    ELSE attempt END
        FROM (SELECT r.job_id, r.artifact_id, r.rn, r.event_id, f.after AS s, f.attempt,
                     CASE WHEN f.after IS NULL THEN
                               CASE WHEN r.state = 'intent' THEN 'send' ELSE 'no_intent' END
                          WHEN r.state = 'intent' THEN CASE
                               WHEN f.after = 'failed' AND f.attempt < 3 THEN 'retry'
                               WHEN f.after IN ('failed', 'terminal') THEN 'give_up'
                               WHEN f.after = 'sent' THEN 'skip_sent' ELSE 'hold' END
                          WHEN f.after = 'intent' AND r.state IN ('sent', 'failed', 'unknown')
                               THEN r.state
                          WHEN f.after = 'failed' AND r.state = 'terminal' THEN 'terminal'
                          ELSE 'illegal' END AS verdict
              FROM fold f JOIN rows_ r ON r.job_id = f.job_id AND r.artifact_id = f.artifact_id
                  AND r.rn = f.rn + 1))
    SELECT job_id, artifact_id, event_id, before, after, verdict, attempt FROM fold WHERE rn > 0""",
    "stream_register": with_views("artifacts")
    + """, ranked AS (
        SELECT *, row_number() OVER w AS rn, first_value(sha256) OVER w AS f_sha,
               first_value(size_bytes) OVER w AS f_size, first_value(mime_type) OVER w AS f_mime
        FROM artifacts WINDOW w AS (PARTITION BY job_id, type, storage_path
                                    ORDER BY expires_at, part_id, source_id, size_bytes))
    SELECT job_id, type, storage_path, sha256, 'insert' AS outcome FROM ranked WHERE rn = 1
    UNION ALL SELECT job_id, type, storage_path, sha256, 'conflict' FROM ranked
    WHERE (sha256, size_bytes, mime_type) <> (f_sha, f_size, f_mime)""",
}
