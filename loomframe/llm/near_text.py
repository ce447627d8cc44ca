"""Near-duplicate texts by weighted MinHash with darts (DartMinHash) and banding.

A text is the multiset of its five-word shingles; a shingle's weight is how often it
occurs. Above each unit of weight lies a strip on which darts fall as a Poisson process
along the rank axis, drawn from hashes of shingle and unit alone. A text throws the darts
of its strips up to a rank that brings about ``k ln k + 2k`` of them, each dart belongs to
one of k coordinates, and the earliest dart of a coordinate is its signature there. Two
texts agree in a coordinate with the probability of their weighted Jaccard similarity,
whatever their lengths, and the work is linear in length plus darts. Where a coordinate got
no dart, the text throws again twice as far.

Texts that agree in a band of coordinates share a bucket. Each member is compared with the
bucket's hub, the member that shares its buckets with most others: of a family of edited
copies it is the one closest to the original. Then only buckets are left whose members lie
in several classes. In small ones the pairs of different classes are compared; larger ones
are worked on block by block inside tasks, which compare all pairs of different classes and
give a tree of the links instead of pairs. Candidates are settled by their signatures where
these are beyond doubt (``SURE`` standard deviations), else by exact similarity. Classes are
the connected components.

Equal texts are one node from the start, so copies cost no comparisons.

Edge cases: words are runs of letters, marks and numbers by Unicode category, in lower case;
a letter of a script written without spaces (with its marks) is a word of its own; a text of one to four words is one shingle; texts without words,
null ones among them, are never linked; a null id is never a class id, and rows without one
stay only if their class has no id; repeated rows are copies; an empty table gives no
rows; other columns are ignored or, in ``deduplicate``, kept.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import mixed, stored
from loomframe.llm.components import components, roots

SHINGLE = 5
SIMILAR = 0.8
COORDINATES = 128
BAND = 5
#: In buckets of up to this many texts, pairs of different classes become rows.
SMALL_BUCKET = 8
#: Texts of a larger bucket that one task compares with as many others.
BLOCK = 1024
#: Columns of the incidence matrix that are multiplied at once.
COLUMNS = 2048
#: Signatures decide alone if they are this many standard deviations from the threshold.
SURE = 3.5
#: Bytes of text that are worked on at once.
BYTES = 4 << 20
#: Up to this many texts their ids are sent to every task; beyond it they are joined.
FEW = 100_000

_U = np.uint64
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LETTER = mixed(np.arange(256, dtype=_U) + _U(1))
_STEP = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 20


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN + 1, base, _U)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


#: Blocks of scripts that are written without spaces between words.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF),
    (0x1B00, 0x1B7F), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_BREAK, _WORD, _ALONE, _MARK = range(4)


@cache
def _kinds() -> np.ndarray:
    """What each code point is to a word."""
    category = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    kinds = np.full(len(category), _BREAK, np.uint8)
    kinds[(category == ord("L")) | (category == ord("N"))] = _WORD
    for first, last in _UNSPACED:
        block = slice(first, last + 1)
        kinds[block][category[block] == ord("L")] = _ALONE
    kinds[category == ord("M")] = _MARK
    return kinds


def spaced(text: str) -> str:
    """The text with a space for what parts words and before what begins one without it."""
    if text.isascii():
        return text
    out, last = [], _BREAK
    for start in range(0, len(text), _SPAN):
        codes = np.frombuffer(text[start : start + _SPAN].encode("utf-32-le"), "<u4")
        kind = _kinds()[codes]
        # Marks belong to the character before them.
        base = np.where(kind == _MARK, 0, np.arange(1, len(kind) + 1))
        of = np.concatenate([[last], kind])[np.concatenate([[0], np.maximum.accumulate(base)])]
        begins = (kind == _ALONE) | (kind == _WORD) & (of[:-1] == _ALONE)
        made = np.full(len(codes) + int(begins.sum()), ord(" "), "<u4")
        made[np.arange(len(codes)) + np.cumsum(begins)] = np.where(kind == _BREAK, ord(" "), codes)
        out.append(made.tobytes().decode("utf-32-le"))
        last = int(of[-1])
    return "".join(out)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash per run of ASCII letters, digits and other characters, and the number of
    runs of each text; of ``spaced`` texts these are the words."""
    parts = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = _WORD_BYTE[data]
    edge = np.diff(inside.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
    counts = np.diff(np.searchsorted(starts, begins))
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        # As many words as lie within one span; the hash does not depend on the cut.
        first = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, first + _SPAN, "right")))
        if ends[at] - first > _SPAN:
            digest = hashlib.blake2b(data[first : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        local = data[first : ends[to - 1]]
        sums = np.zeros(len(local) + 1, _U)
        np.cumsum(_LETTER[local] * _POWER[: len(local)], out=sums[1:])
        s, e = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mixed((sums[e] - sums[s]) * _INVERSE[s])
        at = to
    return out, counts


def strips(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One hash per shingle and unit of its weight, and the text it belongs to."""
    words, counts = word_hashes([spaced(t) for t in texts])
    begins = np.cumsum(counts) - counts
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begins[of]
    left = begins[of] + counts[of] - place
    padded = np.concatenate([words, np.zeros(SHINGLE, _U)])
    shingle = np.zeros(len(of), _U)
    for i in range(SHINGLE):
        word = np.where(left > i, padded[place + i], _U(0))
        shingle = shingle * _U(_STEP) + word
    shingle = mixed(shingle)
    # Number equal shingles of one text: the unit of weight that each occurrence adds.
    own = mixed(shingle + of.astype(_U) * _U(0xD6E8FEB86659FD93))
    order = np.argsort(own, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = own[order][1:] != own[order][:-1]
    first = np.flatnonzero(new)
    unit = np.empty(len(order), _U)
    unit[order] = np.arange(len(order)) - np.repeat(first, np.diff([*first, len(order)]))
    return mixed(shingle ^ (unit * _U(0xA0761D6478BD642F))), of


def _darts(strip: np.ndarray, number: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the next dart of a strip, and that dart's hash."""
    seed = strip + np.asarray(number, _U) * _U(0x2545F4914F6CDD1D)
    gap = -np.log((mixed(seed) >> _U(11)).astype(float) * 2.0**-53 + 2.0**-54)
    return gap, mixed(seed ^ _U(0x5851F42D4C957F2D))


def _throw(strip: np.ndarray, of: np.ndarray, reach: np.ndarray, best: np.ndarray, k: int) -> None:
    """Note the earliest dart per text and coordinate within each text's reach."""

    def keep(text: np.ndarray, rank: np.ndarray, dart: np.ndarray) -> None:
        # Ranks are positive, so the bits of a float order like the float.
        value = rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32) | dart >> _U(32)
        np.minimum.at(best, text * k + (dart % _U(k)).astype(np.int64), value)

    far = reach[of]
    near = far <= 16
    live, text, rank, limit = strip[near], of[near], np.zeros(near.sum()), far[near]
    number = 0
    while len(live):
        gap, dart = _darts(live, number)
        rank = rank + gap
        hit = rank <= limit
        live, text, rank, limit = live[hit], text[hit], rank[hit], limit[hit]
        keep(text, rank, dart[hit])
        number += 1
    # Short texts throw many darts per strip: all at once, by powers of two of their reach.
    scale = np.where(near, 0, np.ceil(np.log2(np.maximum(far, 1)))).astype(int)
    for power in np.unique(scale[~near]):
        mine = np.flatnonzero(scale == power)
        width = int(2.0**power + 10 * 2.0 ** (power / 2) + 20)
        for part in np.array_split(mine, max(1, len(mine) * width // 2_000_000)):
            gap, dart = _darts(strip[part][:, None], np.arange(width)[None])
            rank = np.cumsum(gap, axis=1)
            row, column = np.nonzero(rank <= far[part][:, None])
            keep(of[part][row], rank[row, column], dart[row, column])


def signatures(texts: list[str], k: int = COORDINATES) -> list[np.ndarray | None]:
    """Signature per text; None for texts without words."""
    strip, of = strips(texts)
    weight = np.bincount(of, minlength=len(texts))
    best = np.full(len(texts) * k, np.iinfo(_U).max, _U)
    with np.errstate(divide="ignore"):
        reach = (k * np.log(k) + 2 * k) / weight
    open_texts = weight > 0
    while open_texts.any():
        mine = open_texts[of]
        _throw(strip[mine], of[mine], reach, best, k)
        open_texts &= (best.reshape(-1, k) == np.iinfo(_U).max).any(1)
        reach = reach * 2
    low = best.astype(np.uint32).view(np.int32).reshape(-1, k)
    return [low[i] if weight[i] else None for i in range(len(texts))]


def _groups(texts: list[str]) -> Iterator[slice]:
    """Neighbouring texts of a few megabytes together; a longer one stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BYTES:
            yield slice(start, i)
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for group in _groups(texts):
            signed = signatures(texts[group])
            columns = [c.slice(group.start, group.stop - group.start) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(signed, pa.list_(pa.int32()))], ["doc_id", "digest", "signature"]
            )


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for group in _groups(texts):
            strip, of = strips(texts[group])
            low = (strip >> _U(32)).astype(np.uint32).view(np.int32)
            sets = np.split(low, np.cumsum(np.bincount(of, minlength=group.stop - group.start))[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(group.start, group.stop - group.start), pa.array([np.unique(s) for s in sets], pa.list_(pa.int32()))],
                ["node", "elements"],
            )


def _digest():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def nodes(docs: DataFrame) -> DataFrame:
    """Different texts with words: ``node``, ``digest``, ``first`` (smallest id) and ``signature``."""
    given = docs.select("doc_id", _digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    types = dict(given.dtypes)
    signed = given.mapInArrow(_sign, f"doc_id {types['doc_id']}, digest binary, signature array<int>")
    one = (
        signed.filter(F.col("signature").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature"))
    )
    return stored(one.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")


def buckets(known: DataFrame, band: int = BAND) -> DataFrame:
    """``bucket``, ``node``, ``members`` and ``hub`` of buckets with several texts."""
    bands = F.array(
        *[
            F.xxhash64(F.lit(i), *[F.col("signature")[j] for j in range(i, i + band)])
            for i in range(0, COORDINATES - band + 1, band)
        ]
    )
    rows = known.select("node", F.explode(bands).alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    placed = stored(rows.join(shared, "bucket"), "buckets")
    company = placed.groupBy("node").agg(F.sum("members").alias("_company"))
    hub = F.max_by("node", F.struct("_company", -F.col("node"))).alias("hub")
    hubs = placed.join(company, "node").groupBy("bucket").agg(hub)
    return stored(placed.join(hubs, "bucket"), "buckets")


def _estimated(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Share of coordinates in which two texts agree."""
    of = lambda name: known.select(F.col("node").alias(name), F.col("signature").alias(f"_{name}"))
    equal = F.aggregate(
        F.zip_with("_a", "_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (equal / COORDINATES).alias("share"))


def _sets(wanted: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """``node`` and ``elements`` (shingles with the unit of weight) of the wanted nodes."""
    facts = stored(wanted.distinct().join(known, "node").select("node", "digest", "first"), "wanted")
    if facts.count() <= FEW:
        facts = F.broadcast(facts)
    texts = docs.select("doc_id", _digest().alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    # One row of each text is enough: that of its smallest id.
    same = (texts["digest"] == facts["digest"]) & texts["doc_id"].eqNullSafe(facts["first"])
    made = texts.join(facts, same).select("node", "text").mapInArrow(_elements, "node bigint, elements array<int>")
    return stored(made.groupBy("node").agg(F.first("elements").alias("elements")), "shingles")


def _exact(pairs: DataFrame, known: DataFrame, docs: DataFrame, similar: float) -> DataFrame:
    """Pairs whose weighted Jaccard similarity reaches the threshold, from the texts."""
    sets = _sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), known, docs)
    of = lambda name: sets.select(F.col("node").alias(name), F.col("elements").alias(f"_{name}"))
    common = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - common
    joined = pairs.join(of("a"), "a").join(of("b"), "b")
    return joined.filter(common >= similar * union).select("a", "b")


def _margin(similar: float) -> float:
    return SURE * (similar * (1 - similar) / COORDINATES) ** 0.5


def verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Candidate pairs that reach the similarity."""
    margin = _margin(similar)
    judged = stored(_estimated(pairs, known).filter(F.col("share") >= similar - margin), "judged")
    clear = judged.filter(F.col("share") > similar + margin).select("a", "b")
    doubtful = judged.filter(F.col("share") <= similar + margin).select("a", "b")
    return stored(clear.unionByName(_exact(doubtful, known, docs, similar)), "links")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of incidences."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    flat = [np.concatenate(side) for side in (left, right)]
    shared = np.intersect1d(*flat)
    of = [np.repeat(np.arange(len(n)), n) for n in sizes]
    out = np.zeros((len(left), len(right)), np.float32)
    place = [np.searchsorted(shared, x) for x in flat]
    for start in range(0, len(shared), COLUMNS):
        sides = []
        for x, at, owner, n in zip(flat, place, of, sizes, strict=True):
            mine = (at >= start) & (at < min(start + COLUMNS, len(shared)))
            mine[mine] = shared[at[mine]] == x[mine]
            matrix = np.zeros((len(n), COLUMNS), np.float32)
            matrix[owner[mine], at[mine] - start] = 1
            sides.append(matrix)
        out += sides[0] @ sides[1].T
    return out


def _compare(similar: float):
    """Links between different classes of two blocks (or within one), as a tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
        pdf = pdf.sort_values("node", kind="stable")
        own, group = pdf["_own"].to_numpy(), pdf["component"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
        if not len(left) or not len(right) or (group == group[0]).all():
            return none
        signs = np.stack(pdf["signature"].to_numpy())
        alike = np.zeros((len(left), len(right)), np.uint8)
        for c in range(signs.shape[1]):
            alike += signs[left, c][:, None] == signs[right, c][None]
        margin = _margin(similar)
        maybe = (alike >= (similar - margin) * COORDINATES) & (group[left][:, None] != group[right][None])
        a, b = np.nonzero(maybe)
        sets = pdf["elements"].to_list()
        x, y = np.unique(a), np.unique(b)
        if not len(a):
            return none
        common = _common([sets[left[k]] for k in x], [sets[right[k]] for k in y])
        size = np.array([len(s) for s in sets])
        both = common[np.searchsorted(x, a), np.searchsorted(y, b)]
        a, b = left[a], right[b]
        hit = both >= similar * (size[a] + size[b] - both)
        root = roots(len(pdf), a[hit], b[hit])
        node = pdf["node"].to_numpy()
        moved = root != np.arange(len(pdf))
        return pd.DataFrame({"a": node[moved], "b": node[root[moved]]})

    return run


def _left_over(
    placed: DataFrame, found: DataFrame, known: DataFrame, docs: DataFrame, similar: float
) -> DataFrame | None:
    """Links between classes that share a bucket, or None if no bucket has several classes."""
    apart = placed.filter("members > 2").join(found.select("node", "component"), "node", "left")
    apart = apart.select("bucket", "node", "members", F.coalesce("component", "node").alias("component"))
    several = apart.groupBy("bucket").agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
    rows = stored(apart.join(several.filter("_low <> _high").select("bucket"), "bucket"), "left-over")
    if rows.isEmpty():
        return None
    small = rows.filter(F.col("members") <= SMALL_BUCKET)
    other = small.select("bucket", F.col("node").alias("b"), F.col("component").alias("_other"))
    pairs = small.withColumnRenamed("node", "a").join(other, "bucket").filter("a < b AND component <> _other")
    links = verified(pairs.select("a", "b").distinct(), known, docs, similar)
    large = rows.filter(F.col("members") > SMALL_BUCKET)
    if large.isEmpty():
        return links
    facts = known.select("node", "signature").join(_sets(large.select("node"), known, docs), "node")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    dealt = large.withColumn("_blocks", blocks).withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )
    grouped = dealt.join(facts, "node").withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    trees = grouped.groupBy("bucket", "_i", "_j").applyInPandas(_compare(similar), "a bigint, b bigint")
    return stored(links.unionByName(trees), "more-links")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``digest`` and ``class_id`` (smallest id of the class) of every text with words."""
    known = nodes(docs)
    placed = buckets(known)
    star = placed.filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    links = verified(star.distinct(), known, docs, similar)
    found = components(links)
    more = _left_over(placed, found, known, docs, similar)
    if more is not None:
        found = components(links.unionByName(more))
    named = known.select("node", "digest", "first").join(found, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("class_id"))
    return stored(named.join(least, "component").select("digest", "first", "class_id"), "classes")


def _wordless(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``digest`` and ``class_id`` of texts without words: exact copies are a class."""
    given = docs.filter(F.col("text").isNotNull()).select("doc_id", _digest().alias("digest"))
    return given.groupBy("digest").agg(F.min("doc_id").alias("class_id")).join(found.select("digest"), "digest", "left_anti")


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``class_id`` and ``kept`` (the document that stands for its class).

    Texts without words are in a class with their exact copies; null texts stand alone.
    """
    found = classes(docs, similar).select("digest", "class_id")
    known = found.unionByName(_wordless(docs, found))
    digest = F.when(F.col("text").isNotNull(), _digest())
    given = docs.select("doc_id", digest.alias("digest")).join(known, "digest", "left")
    own = F.coalesce("class_id", "doc_id")
    return given.select("doc_id", own.alias("class_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicate(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One document of each class, with all its columns; null texts all stay.

    Few digests are dropped or few are kept twice, so texts are not shuffled unless there
    are more dropped texts than can be sent to every task.
    """
    found = classes(docs, similar)
    drop = stored(
        found.filter(~F.col("first").eqNullSafe(F.col("class_id"))).select(F.col("digest").alias("_digest")), "dropped"
    )
    if drop.count() <= FEW:
        drop = F.broadcast(drop)
    # The row is one column, so its names cannot clash with those needed here.
    digest = F.when(F.col("text").isNotNull(), _digest())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(whole.alias("_row"), F.col("doc_id").alias("_id"), digest.alias("_digest"))
    stay = given.join(drop, "_digest", "left_anti")
    # Copies of a kept text: the smallest id stays, and of rows that repeat it one.
    rows = docs.filter(F.col("text").isNotNull()).select(_digest().alias("_digest"), F.col("doc_id").alias("_id"))
    several = rows.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    several = stored(several.filter(F.col("_rows") > 1).select("_digest", "_first"), "copied")
    if several.count() <= FEW:
        several = F.broadcast(several)
    marked = stay.join(several.withColumn("_copied", F.lit(True)), "_digest", "left")
    single = marked.filter(F.col("_copied").isNull())
    copied = marked.filter(F.col("_copied") & F.col("_id").eqNullSafe(F.col("_first"))).dropDuplicates(["_digest"])
    return single.select("_row.*").unionByName(copied.select("_row.*"))
