"""Catalogue of GIF files from their headers; nothing is decoded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.numeric import first_reason

SIGNATURES = ("GIF87a", "GIF89a")
HEADER_BYTES = 13


def _little_endian(content: Column, position: int) -> Column:
    digits = F.concat(
        F.hex(F.substring(content, position + 1, 1)), F.hex(F.substring(content, position, 1))
    )
    return F.conv(digits, 16, 10).try_cast("int")


def gif_facts(files: DataFrame) -> DataFrame:
    """Facts of ``path, length, content`` rows; the content itself is dropped."""
    content = F.col("content")
    head = F.substring(content, 1, 6)
    signed = (F.col("length") >= HEADER_BYTES) & head.isin(
        *[F.encode(F.lit(s), "US-ASCII") for s in SIGNATURES]
    )
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"),
        signed.alias("signature_ok"),
        F.when(signed, _little_endian(content, 7)).alias("canvas_width"),
        F.when(signed, _little_endian(content, 9)).alias("canvas_height"),
    )


def scan_gif_files(
    spark: SparkSession, path: str, pattern: str = "*.gif", max_bytes: int | None = None
) -> DataFrame:
    """Scan a folder tree. The size limit is tested before a file's content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    return gif_facts(files)


def header_budget(facts: DataFrame, max_width: int, max_height: int) -> DataFrame:
    """First broken rule of each file, from the header alone."""
    w, h = F.col("canvas_width"), F.col("canvas_height")
    return facts.withColumn(
        "reason",
        first_reason(
            header=~F.col("signature_ok"),
            dimensions=(w <= 0) | (h <= 0),
            canvas_limit=(w > max_width) | (h > max_height),
        ),
    )
