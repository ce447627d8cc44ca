"""Session building and the checkpoint folder used by iterative operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors.

    The folder comes from ``spark.checkpoint.dir``. Only a local session without
    that setting gets a temporary folder; a cluster session must name a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="loomframe-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def partition_count(spark: SparkSession) -> int:
    """Shuffle partitions as set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_shared: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Send this package to the executors once, for functions that run in Python there.

    Also puts the package's folder on the Python path of workers that start later.
    """
    context = spark.sparkContext
    if context.applicationId in _shared:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="loomframe-package-")) / root.name
    context.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
    # Stateful streams also start a Python worker next to the driver, without those files.
    paths = [str(root.parent), context.environment.get("PYTHONPATH", "")]
    context.environment["PYTHONPATH"] = os.pathsep.join(p for p in paths if p)
    _shared.add(context.applicationId)
