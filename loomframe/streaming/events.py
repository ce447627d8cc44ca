"""Stage-event streams: source, duplicates, durations and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomframe.functions.documents import is_json_object

# Fields of a stage event line.
EVENT_SCHEMA = (
    "event STRING, stage STRING, job_id STRING, duration_ms BIGINT, error STRING, ts TIMESTAMP"
)
EVENTS = ("stage_started", "stage_completed", "stage_failed")


def parse_stage_events(lines: DataFrame) -> DataFrame:
    """JSON lines in ``value`` to typed rows; unusable lines keep their text and a reason."""
    parsed = lines.select("value", F.from_json("value", EVENT_SCHEMA).alias("_e"))
    e = F.col("_e")
    known = F.coalesce(e["event"].isin(*EVENTS), F.lit(False))
    reason = F.when(~is_json_object(F.col("value")), "malformed").when(~known, "unknown_event")
    return parsed.select("_e.*", reason.alias("reason"), F.when(reason.isNotNull(), F.col("value")).alias("line"))


def stream_stage_events(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Stream of stage events from a folder of JSON-lines files."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parse_stage_events(lines)


def stream_dedup(
    events: DataFrame,
    delay: str,
    keys: Sequence[str] = ("submitted_by", "source_message_id"),
    time_column: str = "ts",
) -> DataFrame:
    """First event per key within the delay; rows with a null key part all stay.

    State is dropped when the watermark has passed.
    """
    timed = events.withWatermark(time_column, delay)
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    keyed = timed.filter(whole).dropDuplicatesWithinWatermark(list(keys))
    return keyed.unionByName(timed.filter(~whole))


def stream_stage_durations(events: DataFrame, delay: str, longest: str) -> DataFrame:
    """Started events paired with the end of the same stage; unfinished ones end null.

    Both sides are bounded by watermarks and by the longest allowed duration.
    """
    key = ["job_id", "stage"]
    started = (
        events.filter(F.col("event") == "stage_started")
        .select(*key, F.col("ts").alias("started_at"))
        .withWatermark("started_at", delay)
    )
    ended = (
        events.filter(F.col("event").isin("stage_completed", "stage_failed"))
        .select(
            F.col("job_id").alias("_job"),
            F.col("stage").alias("_stage"),
            F.col("event").alias("outcome"),
            F.col("ts").alias("ended_at"),
        )
        .withWatermark("ended_at", delay)
    )
    near = (F.col("ended_at") >= F.col("started_at")) & (
        F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {longest}")
    )
    same = (F.col("job_id") == F.col("_job")) & (F.col("stage") == F.col("_stage"))
    paired = started.join(ended, same & near, "left_outer")
    micros = F.unix_micros("ended_at") - F.unix_micros("started_at")
    return paired.select(
        *key, "started_at", "outcome", F.floor(micros / F.lit(1000)).alias("duration_ms")
    )


def stream_stage_rates(
    events: DataFrame, delay: str, size: str, slide: str | None = None
) -> DataFrame:
    """Ended stages and failure rate per window and stage."""
    ended = events.filter(F.col("event") != "stage_started").withWatermark("ts", delay)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = ended.groupBy(window.alias("w"), "stage").agg(
        F.count("*").alias("ended"),
        F.count_if(F.col("event") == "stage_failed").alias("failed"),
    )
    return counted.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "stage",
        "ended",
        "failed",
        (F.col("failed") / F.col("ended")).alias("failure_rate"),
    )


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark, from the progress reports of a query."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )
