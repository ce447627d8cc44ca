"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.session import share_package


#: Rows of an Arrow batch in the sessions of these queries. Texts are long, and a batch is
#: held by both the engine and the worker.
ARROW_ROWS = 1_000


def prepare(spark: SparkSession) -> None:
    """Give workers this package, and the session Arrow batches of ``ARROW_ROWS`` at most."""
    share_package(spark)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = int(spark.conf.get(setting))
    if given <= 0 or given > ARROW_ROWS:
        spark.conf.set(setting, str(ARROW_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine without that setting gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="loomframe-shared-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and go on from the files: cuts the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bytes of an Arrow batch that are turned into Python objects at once.
SLICE = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few megabytes, one row at least."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    # The next task of this worker may need the room for something else.
    pa.default_memory_pool().release_unused()


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """One small Arrow batch in, one out; ``work`` keeps nothing that later ones depend on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(work, sliced(batches))

    return df.mapInArrow(run, schema)


def by_place(df: DataFrame, kept: Sequence[str], *more: Column) -> DataFrame:
    """The kept columns and more ones, named c0, c1, ... by their place.

    No name of a caller can clash with one that an operator needs; ``toDF`` gives them back.
    """
    columns = [*[F.col(f"`{c}`") for c in kept], *more]
    return df.select(*columns).toDF(*[f"c{i}" for i in range(len(columns))])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits per number (the published splitmix64 finaliser)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
