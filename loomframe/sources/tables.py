"""Operational tables with fixed schemas, and the split into good and rejected rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names and types of the seven tables, as DDL.
SCHEMAS: dict[str, str] = {
    "processing_jobs": (
        "id STRING NOT NULL, status STRING NOT NULL, version INT NOT NULL, attempt INT NOT NULL, "
        "owner_id STRING, lease_expires_at TIMESTAMP, telegram_file_id STRING NOT NULL, "
        "original_filename STRING, content_type STRING, file_size_bytes INT NOT NULL, "
        "submitted_by BIGINT NOT NULL, source_message_id BIGINT, mode STRING NOT NULL, "
        "created_at TIMESTAMP NOT NULL, updated_at TIMESTAMP NOT NULL"
    ),
    "delivery_log": (
        "id STRING NOT NULL, job_id STRING NOT NULL, artifact_id STRING NOT NULL, "
        "channel STRING NOT NULL, state STRING NOT NULL, attempt INT NOT NULL, "
        "external_ref STRING, error STRING, created_at TIMESTAMP NOT NULL, "
        "updated_at TIMESTAMP NOT NULL"
    ),
    "artifacts": (
        "artifact_id STRING NOT NULL, job_id STRING NOT NULL, type STRING NOT NULL, "
        "storage_path STRING NOT NULL, mime_type STRING NOT NULL, size_bytes INT NOT NULL, "
        "sha256 STRING NOT NULL, created_at TIMESTAMP NOT NULL, expires_at TIMESTAMP, "
        "metadata STRING NOT NULL"
    ),
    "job_steps": (
        "id STRING NOT NULL, job_id STRING NOT NULL, name STRING NOT NULL, status STRING NOT NULL, "
        "started_at TIMESTAMP, completed_at TIMESTAMP, duration_ms INT, "
        "retry_count INT NOT NULL, error STRING"
    ),
    "design_specs": (
        "id STRING NOT NULL, job_id STRING NOT NULL, schema_version INT NOT NULL, "
        "document STRING NOT NULL"
    ),
    "processing_settings": (
        "id STRING NOT NULL, job_id STRING NOT NULL, schema_version INT NOT NULL, "
        "document STRING NOT NULL"
    ),
    "ai_executions": (
        "id STRING NOT NULL, job_id STRING NOT NULL, provider STRING NOT NULL, model_id STRING, "
        "duration_ms INT, status STRING NOT NULL, metadata STRING NOT NULL"
    ),
}

ERROR_TAIL = 4000


def read_ops(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Parquet scan of one operational table; the schema is never inferred."""
    return spark.read.schema(SCHEMAS[table]).parquet(path)


def read_ops_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """The same table from a relational store, read in ranges of ``partitionColumn``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, customSchema=SCHEMAS[table].replace(" NOT NULL", ""))
        .options(**options)
        .load()
    )


def split(df: DataFrame, stage: str, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and rejected rows with stage, class and message tail."""
    good = df.filter(F.col(reason).isNull()).drop(reason)
    message = F.col(reason).cast("string")
    bad = df.filter(F.col(reason).isNotNull()).withColumns(
        {
            "stage": F.lit(stage),
            "error_class": F.split(message, ":").getItem(0),
            "error": F.right(message, F.lit(ERROR_TAIL)),
        }
    )
    return good, bad.drop(reason)
