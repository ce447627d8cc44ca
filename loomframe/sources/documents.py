"""JSON document scans and report sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions.documents import canonical_text, is_json_object, json_bounds, json_violation
from loomframe.functions.numeric import first_reason

# Top-level fields and the repeated part of each document kind.
KINDS = {
    "workflow": (("contract_version", "id", "operations"), "operations"),
    "revisions": (
        ("current_revision_id", "revisions", "root_revision_id", "schema_version"),
        "revisions",
    ),
    "spec": ((), None),
    "settings": ((), None),
}
#: Facts of the whole document, by the name of their column.
WHOLE = {
    "workflow": {"workflow_id": "id"},
    "revisions": {
        "current_revision_id": "current_revision_id",
        "root_revision_id": "root_revision_id",
    },
}
# Fields of a clip report that are columns of the same kind.
REPORT_FIELDS = (
    "schema_version", "width", "height", "frame_count", "duration_ms", "effective_fps", "file_size_bytes", "loop_count",
    "frame_motion", "motion_mean", "motion_max", "motion_p25", "motion_p50", "motion_p75", "motion_p90", "motion_p95",
    "motion_p99", "first_last_difference", "corner_color_is_heuristic", "frame_palette_colors", "max_palette_colors",
    "duration_min_ms", "duration_max_ms", "timing_is_uniform",
)
VERSION_FIELD = {"workflow": "contract_version", "revisions": "schema_version"}
ITEM_SCHEMA = {
    "workflow": (
        "capability_id STRING, capability_version INT, metadata STRING, payload STRING"
    ),
    "revisions": (
        "revision_id STRING, parent_id STRING, state STRING, command_metadata STRING"
    ),
}


def read_documents(df: DataFrame, kind: str, document: str = "document") -> DataFrame:
    """One row per operation or revision of each document; bad documents get a reason.

    Single documents (specs, settings) stay one row. Free-form parts stay JSON text. Ids of
    the whole document are repeated on its rows. An item that is no object, or whose number
    is none, has the reason ``item_fields``.
    """
    fields, repeated = KINDS[kind]
    text = F.col(document)
    checked = df.withColumn("_problem", F.coalesce(json_bounds(text), json_violation(text)))
    keys = F.array_sort(F.json_object_keys(text))
    rules = {"not_object": keys.isNull()}
    if repeated is not None:
        version = F.get_json_object(text, f"$.{VERSION_FIELD[kind]}")
        items = F.from_json(F.get_json_object(text, f"$.{repeated}"), "ARRAY<STRING>")
        rules |= {
            "fields": keys != F.array(*[F.lit(k) for k in fields]),
            "version": ~version.eqNullSafe("1"),
            "items": items.isNull(),
        }
    checked = checked.withColumn("reason", F.coalesce("_problem", first_reason(**rules)))
    if repeated is None:
        return checked.drop("_problem")
    good = F.col("reason").isNull()
    exploded = checked.select(
        *df.columns,
        "reason",
        F.posexplode_outer(F.when(good, items)).alias("idx", "_item"),
    )
    item = F.from_json("_item", ITEM_SCHEMA[kind])
    numbers = [f.split()[0] for f in ITEM_SCHEMA[kind].split(", ") if f.endswith(" INT")]
    odd = ~F.coalesce(is_json_object(F.col("_item")), F.lit(False))
    for name in numbers:
        given = F.get_json_object("_item", f"$.{name}")
        odd = odd | (given.isNotNull() & given.try_cast("int").isNull())
    broken = F.when(F.col("_item").isNotNull() & odd, "item_fields")
    whole = [
        F.get_json_object(text, f"$.{field}").alias(name) for name, field in WHOLE[kind].items()
    ]
    return exploded.withColumn("_i", item).select(
        *[c for c in df.columns if c != document],
        "idx",
        "_i.*",
        *whole,
        F.coalesce("reason", broken).alias("reason"),
    )


def read_document_files(spark, path: str, kind: str) -> DataFrame:
    """The same from text files, one document per file; undecodable files get a reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    readable = files.filter(valid).select("path", F.col("content").cast("string").alias("document"))
    rows = read_documents(readable, kind)
    broken = files.filter(~valid).select("path", F.lit("utf8").alias("reason"))
    return rows.unionByName(broken, allowMissingColumns=True)


def report_lines(reports: DataFrame, names: Sequence[str]) -> Column:
    """Given columns of each row as one canonical JSON object."""
    whole = F.struct(*[F.col(f"`{n}`").alias(n) for n in names])
    return canonical_text(whole, reports.select(whole.alias("r")).schema["r"].dataType)


def write_reports(reports: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Reports as lines of canonical JSON, sorted at every level; appends, optionally per
    partition column."""
    line = report_lines(reports, [c for c in reports.columns if c != partition_by]).alias("value")
    if partition_by is None:
        reports.select(line).write.mode("append").text(path)
    else:
        reports.select(line, partition_by).write.mode("append").partitionBy(partition_by).text(
            path
        )


def clip_documents(reports: DataFrame) -> DataFrame:
    """Reports of ``clips.analyze_clips`` with the fields and names of the stored document.

    Clips with a reason have no document.
    """
    renamed = {"duration_ms": "total_ms", "file_size_bytes": "size_bytes"}
    pairs = F.transform("duration_histogram", lambda b: F.array(b["ms"].cast("bigint"), b["n"]))
    return reports.filter(F.col("reason").isNull()).select(
        *[F.col(renamed.get(n, n)).alias(n) for n in REPORT_FIELDS],
        F.array("corner_r", "corner_g", "corner_b").alias("corner_color"),
        pairs.alias("duration_histogram"),
    )
