"""Running streams to the end of their input, and the artifact registry sink."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from loomframe.operators import artifacts
from loomframe.session import partition_count
from loomframe.streaming.machines import STATE_STORE


def state_session(spark: SparkSession) -> SparkSession:
    """Sibling session whose streams keep their state in RocksDB."""
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.shuffle.partitions", str(partition_count(spark)))
    sibling.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return sibling


def work_folder(spark: SparkSession) -> str:
    """New folder below ``spark.checkpoint.dir``; a temporary one in local sessions only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="loomframe-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, folder: str) -> StreamingQuery:
    """Write everything that is available now to ``folder/rows`` as parquet."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


#: Buckets of the registry, and folders of a bucket before they are merged.
BUCKETS = 64
PARTS = 6
#: Rows of a bucket in a batch from which they are dealt to several tasks.
BUCKET_ROWS = 500_000


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*artifacts.IDENTITY), F.lit(BUCKETS)).cast("int")


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    system, target = _path(spark, path)
    return [x.getPath().getName() for x in system.listStatus(target)] if system.exists(target) else []


def read_manifest(spark: SparkSession, registry: str, before: int) -> dict[int, list[str]]:
    """Files of each bucket as the latest batch before ``before`` left them."""
    known = [int(n.removesuffix(".json")) for n in _names(spark, f"{registry}/manifests") if n[:-5].isdigit()]
    latest = max((n for n in known if n < before), default=None)
    if latest is None:
        return {}
    rows = spark.read.schema("bucket INT, parts ARRAY<STRING>").json(f"{registry}/manifests/{latest}.json").collect()
    return {r.bucket: r.parts for r in rows}


def _write_manifest(spark: SparkSession, registry: str, batch_id: int, parts: dict[int, list[str]]) -> None:
    """Put the manifest of a batch in place, whole or not at all."""
    system, target = _path(spark, f"{registry}/manifests/{batch_id}.json")
    _, draft = _path(spark, f"{registry}/manifests/.{uuid.uuid4().hex}")
    out = system.create(draft, True)
    try:
        lines = [json.dumps({"bucket": b, "parts": parts[b]}) for b in sorted(parts)]
        out.write(bytearray("\n".join(lines).encode()))
    finally:
        out.close()
    system.delete(target, False)
    system.rename(draft, target)


def register_batch(
    batch: DataFrame, batch_id: int, registry: str, order: Sequence[str]
) -> dict[int, list[str]]:
    """Add the new artifacts of one batch; a repeated batch replaces its own part.

    ``inserts`` and ``conflicts`` hold the outcome of each batch. The inserts of a batch lie
    in ``BUCKETS`` buckets by hash of their identity, and each batch leaves a manifest of the
    folders that make up every bucket. A batch reads the manifest of the batch before it and
    only the files of the buckets it has rows for; a bucket of more than ``PARTS`` folders is
    merged into one next to them. So the files read do not grow with the number of batches.
    Running a batch again starts from the same manifest, writes the same rows to its own
    folders and swaps its own manifest.

    Rows are shuffled once, by bucket and part of a bucket, and both outcomes are written from
    that, so the bytes of a batch grow with its rows only.
    """
    spark = batch.sparkSession
    columns = [*artifacts.IDENTITY, *artifacts.CONTENT, "created_at"]
    schema = ", ".join(f"{c} {t}" for c, t in batch.select(*columns).dtypes)
    manifest = read_manifest(spark, registry, batch_id)
    # At most one row per bucket.
    touched = dict(tuple(r) for r in batch.groupBy(_bucket().alias("bucket")).count().collect())
    files = [part for bucket in touched for part in manifest.get(bucket, [])]
    known = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    cuts = max(1, -(-max(touched.values(), default=0) // BUCKET_ROWS))
    cells = {"bucket": _bucket(), "_cut": F.pmod(F.hash(*artifacts.IDENTITY), F.lit(cuts))}
    target = f"{registry}/inserts/batch_id={batch_id}"
    judged = artifacts.judge_artifacts(known, batch, order, cells).persist(StorageLevel.DISK_ONLY)
    try:
        inserts = judged.filter(F.col("outcome") == "insert").select(*columns, "bucket")
        # Hex digests make up most of a row and shrink by half.
        packed = inserts.write.mode("overwrite").option("compression", "zstd")
        packed.partitionBy("bucket").parquet(target)
        conflicts = judged.filter(F.col("outcome") == "conflict").drop("outcome", *cells)
        conflicts.write.mode("overwrite").parquet(f"{registry}/conflicts/batch_id={batch_id}")
    finally:
        judged.unpersist()

    def buckets(folder: str) -> dict[int, list[str]]:
        """Folder of each bucket that got some rows."""
        made = [n for n in _names(spark, folder) if n.startswith("bucket=")]
        return {int(n.split("=")[1]): [f"{folder}/{n}"] for n in made}

    new = buckets(target)
    if not new:
        # Without any row the folder would have no schema.
        spark.createDataFrame([], schema).write.parquet(f"{target}/bucket=0")
    parts = {b: manifest.get(b, []) + new.get(b, []) for b in {*manifest, *new}}
    full = [b for b in new if len(parts[b]) > PARTS]
    if full:
        held = spark.read.schema(schema).parquet(*[p for b in full for p in parts[b]])
        folder = f"{registry}/index/{batch_id}-{uuid.uuid4().hex}-merged"
        merged = held.withColumn("bucket", _bucket()).repartition("bucket")
        merged.write.partitionBy("bucket").parquet(folder)
        parts |= buckets(folder)
    _write_manifest(spark, registry, batch_id, parts)
    return {b: manifest.get(b, []) for b in touched}


def stream_register(
    events: DataFrame, registry: str, checkpoint: str, order: Sequence[str]
) -> StreamingQuery:
    """Register a stream of artifacts: the first write of an identity wins."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        register_batch(batch, batch_id, registry, order)

    query = (
        events.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
