"""WARC archives with an index, and reads that follow it.

Writing makes gzip archives, one member per record, and first of all an index: archive,
offset, length, URL and digest of each record. Reading selects index rows, sorts them by
place, joins neighbouring byte ranges into one request and cuts the records out of it.

Records with equal payloads are stored once: the one with the smallest page id is a
``response``, the others are ``revisit`` records that name it and have no payload.

Archives and index lie in the shared folder. A task names its archive anew on each
attempt, and only archives of finished attempts are in the index, which is written before
anything is read; so lost executors cost time only.

Edge cases: a null html is an empty payload; payloads below the least size are always
responses; rows that repeat the smallest page id of their payload are responses too; a
null page id is never a target, and such rows are revisits if another row of the payload
has an id; a null url leaves the field out; an empty table gives no records; other
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import shared_folder, stored

LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Ranges closer than the gap are read together, up to the largest request.
GAP, REQUEST = 64 << 10, 8 << 20
#: Archive bytes that one task reads.
TASK_BYTES = 16 << 20
#: Up to this many shared payloads their ids are sent to every task.
FEW_SHARED = 50_000

_INDEX = (
    "page_id bigint, url string, record_type string, digest string, archive string, "
    "offset bigint, length bigint"
)
_RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload binary, "
    "payload_bytes bigint, payload_digest string"
)
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    arrays = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def with_targets(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest`` and ``refers_to`` (null for responses)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    facts = pages.select(
        "page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("_bytes")
    )
    first = (
        facts.filter(F.col("_bytes") >= least)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .filter((F.col("_rows") > 1) & F.col("_first").isNotNull())
        .drop("_rows")
    )
    first = stored(first, "shared-payloads")
    if first.count() <= FEW_SHARED:
        first = F.broadcast(first)
    given = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    joined = given.join(first, given["digest"] == first["_digest"], "left")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page_id", "url", "payload", "digest", other.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid.uuid4()}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # Control characters cannot stand in a field; other characters stay as they are.
        fields.append(("WARC-Target-URI", "".join(quote(c) if c < " " or c in "%\x7f" else c for c in url)))
    if refers_to is not None:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def write(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """Write archives of ``pages`` (page_id, url, html) and return their stored index."""
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, place = None, "", 0
        try:
            for batch in batches:
                rows = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or place >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        path, place = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(path, compression=None)
                    page_id, url, _, digest, refers_to = row
                    member = gzip.compress(record(*row), 3, mtime=0)
                    out.write(member)
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((page_id, url, kind, digest, path.removeprefix(base + "/"), place, len(member)))
                    place += len(member)
                yield _batch(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    index = stored(with_targets(pages, least).mapInArrow(run, _INDEX), "warc-index")
    return index.withColumn("folder", F.lit(folder))


def parse(data: bytes) -> tuple:
    """Fields of an uncompressed record, in the order of the reader's columns."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x.startswith("<urn:page:") else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    if url is not None and "%" in url:
        # Undo exactly what ``record`` did: it escaped nothing but control characters and %.
        parts = url.split("%")
        url = parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])
    return (
        number(fields["WARC-Record-ID"]),
        url,
        kind,
        number(fields.get("WARC-Refers-To", "")),
        payload if kind == "response" else None,
        size,
        digest,
    )


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP, most: int = REQUEST) -> list[list[tuple[str, int, int]]]:
    """Neighbours (archive, offset, length) that are read with one request; sorted input."""
    out: list[list[tuple[str, int, int]]] = []
    for row in rows:
        last = out[-1] if out else None
        if (
            last
            and last[-1][0] == row[0]
            and row[1] - (last[-1][1] + last[-1][2]) <= gap
            and row[1] + row[2] - last[0][1] <= most
        ):
            last.append(row)
        else:
            out.append([row])
    return out


def read(selected: DataFrame, gap: int = GAP, most: int = REQUEST) -> DataFrame:
    """Records of the selected index rows, read in order of their places."""
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = int(total // TASK_BYTES) + 1
    placed = (
        selected.select("folder", "archive", "offset", "length")
        .repartitionByRange(tasks, "archive", "offset")
        .sortWithinPartitions("archive", "offset")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            folders, *columns = (c.to_pylist() for c in batch.columns)
            for group in ranges(list(zip(*columns, strict=True)), gap, most):
                if group[0][0] != name:
                    name = group[0][0]
                    store, base = fs.FileSystem.from_uri(folders[0])
                    file = store.open_input_file(f"{base}/{name}")
                start, (_, offset, length) = group[0][1], group[-1]
                data = file.read_at(offset + length - start, start)
                members = (data[o - start : o - start + n] for _, o, n in group)
                yield _batch([parse(gzip.decompress(m)) for m in members], _RECORD)

    return placed.mapInArrow(run, _RECORD)
