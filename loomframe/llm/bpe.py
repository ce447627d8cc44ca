"""Byte-level BPE encoding and decoding with a segment tree.

Within one piece of text the tree holds, for every live byte position, the rank of the
pair that starts there; its root is the leftmost pair of least rank. A merge takes the
root, joins the pair and renews three leaves: the pair itself, its left neighbour and the
swallowed position. A piece of n bytes so costs O(n log n) however long it is.

Pieces are the matches of the tokenizer's pattern. Natural text repeats pieces, so every
worker remembers the ids of recent ones in a table of bounded size; what the table holds
never changes a result.

Edge cases: a null text is an empty one and has no ids; other columns, repeated rows and
null ids pass through; columns whose names clash with the new ones are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import by_place, map_batches

#: Most pieces a worker remembers unless told otherwise; about 150 bytes each.
REMEMBERED = 500_000
#: Longer pieces are rare and not worth remembering.
LONGEST_REMEMBERED = 64

_SINGLE = [bytes([b]) for b in range(256)]
_NONE = 1 << 62
_PLACE = (1 << 32) - 1


class Encoder:
    """Ids of pieces and bytes of ids for one file of ranks."""

    def __init__(self, path: str, pattern: str, remembered: int = REMEMBERED):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, file)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.memo = _Memo(self, remembered)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        rank = ranks.get
        part = [_SINGLE[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, (n - 2).bit_length())
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            found = rank(piece[i : i + 2])
            if found is not None:
                tree[size + i] = found << 32 | i
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left < right else right

        while tree[1] != _NONE:
            place = tree[1] & _PLACE
            gone = after[place]
            follower = after[gone]
            part[place] = joined = part[place] + part[gone]
            after[place] = follower
            # New leaves: the swallowed pair, the pair that now starts here, the one before.
            c, b = size + gone, size + place
            if gone < n - 1:
                tree[c] = _NONE
            else:
                c = b
            found = None
            if follower < n:
                before[follower] = place
                found = rank(joined + part[follower])
            tree[b] = _NONE if found is None else found << 32 | place
            leader = before[place]
            a = b
            if leader >= 0:
                a = size + leader
                found = rank(part[leader] + joined)
                tree[a] = _NONE if found is None else found << 32 | leader
            # Renew the three paths to the root together; where they meet, once.
            while a > 1:
                a, b, c = a >> 1, b >> 1, c >> 1
                left, right = tree[a + a], tree[a + a + 1]
                tree[a] = left if left < right else right
                if b != a:
                    left, right = tree[b + b], tree[b + b + 1]
                    tree[b] = left if left < right else right
                if c != b:
                    left, right = tree[c + c], tree[c + c + 1]
                    tree[c] = left if left < right else right
        ids, place = [], 0
        while place < n:
            ids.append(ranks[part[place]])
            place = after[place]
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pieces(text)))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for; an unknown id raises ``KeyError``."""
        return b"".join(map(self.tokens.__getitem__, unpacked(ids)))


class _Memo(dict):
    """Packed ids by piece, worked out on first use.

    When it is full it becomes the older half, from which pieces that come again are taken
    over; what did not come again is forgotten with it.
    """

    def __init__(self, encoder: Encoder, remembered: int):
        super().__init__()
        self.encoder, self.half = encoder, remembered // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = pack(self.encoder.merge(piece.encode()))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


def pack(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def unpacked(ids: bytes) -> array:
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path, pattern, remembered)


def encode(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """Add the ids of ``text`` as binary column: little-endian unsigned 32-bit integers."""
    return _added(df, text, {ids: (pa.binary(), "binary")}, lambda x: (encoder(path, pattern).encode(x or ""),))


def decode(
    df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """Add the bytes that packed ``ids`` stand for; null ids give empty bytes."""
    return _added(
        df, ids, {decoded: (pa.binary(), "binary")}, lambda x: (encoder(path, pattern).decode(x or b""),)
    )


def round_trip(
    df: DataFrame,
    path: str,
    pattern: str,
    text: str = "text",
    keep_ids: bool = False,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """Encode ``text``, decode the ids again and add counts and digests of both.

    New columns: ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for,
    ``ids``. Texts and ids of a row stay in one worker; nothing is shuffled.
    """

    def both(value: str | None) -> tuple:
        codec = encoder(path, pattern, remembered)
        ids = codec.encode(value or "")
        decoded = codec.decode(ids)
        row = (
            len(ids) // 4,
            hashlib.sha256(ids).hexdigest(),
            hashlib.sha256(decoded).hexdigest(),
        )
        return (*row, ids) if keep_ids else row

    new = {
        "n_tokens": (pa.int64(), "bigint"),
        "ids_sha256": (pa.string(), "string"),
        "decoded_sha256": (pa.string(), "string"),
    }
    if keep_ids:
        new["ids"] = (pa.binary(), "binary")
    return _added(df, text, new, both)


def _added(df: DataFrame, source: str, new: dict, work) -> DataFrame:
    """Columns worked out from one column, row by row within Arrow batches."""
    kept = [c for c in df.columns if c not in new]
    given = by_place(df, kept, F.col(f"`{source}`"))
    types = [f.dataType.simpleString() for f in given.schema.fields]
    names = [*given.columns[: len(kept)], *(f"n{i}" for i in range(len(new)))]
    schema = ", ".join(
        f"{n} {ddl}" for n, ddl in zip(names, [*types[: len(kept)], *(ddl for _, ddl in new.values())], strict=True)
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [work(x) for x in batch.column(len(kept)).to_pylist()]
        columns = list(zip(*rows, strict=True)) or [[] for _ in new]
        made = [pa.array(c, t) for c, (t, _) in zip(columns, new.values(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names)

    return map_batches(given, run, schema).toDF(*kept, *new)
