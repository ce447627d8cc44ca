"""Near-duplicate vectors by collision-counting projections.

Two unit vectors whose cosine reaches the threshold are at most a known distance apart, so
their projections on a random direction differ by a normal number of known spread. Vectors
are dealt to cells by the signs of a few directions, in as many tables as it takes for such
a pair to share a cell with the chosen recall. In a cell every vector is the centre of
windows: rows are sorted by one projection, which leaves a range per vector, and within the
range collisions in the windows of many more projections are counted. Pairs whose count
reaches the calibrated number are verified by their cosine in double precision.

A pair is counted only in the first table that brings it together. A cell gives numbers of
links and a tree of its links instead of pairs, so its output is as long as its input. A
cell far above the usual size is worked on by blocks, each pair of blocks in a task of its
own. Equal vectors are one node from the start and are counted by their number.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths are never linked; a null id is never a component
id, and a vector without one stays only if its component has no id; repeated rows are
copies, each counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, erf, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import stored
from loomframe.llm.components import components, roots

SIMILAR = 0.95
#: Share of pairs at the very threshold that share a cell, and that pass the count.
RECALL = 0.9995
#: Vectors of a cell on average, and above which a cell is cut into blocks of half the size.
CELL, LARGE = 1_024, 4_096
#: Projections whose windows are counted, their half width in spreads, and levels per unit.
PROJECTIONS = 48
WINDOW = 0.8
LEVELS = 28.0
#: Half width of the sorting projection's window, in spreads of a pair at the threshold.
RANGE = 4.0
ROWS = 256


def plan(vectors: int, similar: float = SIMILAR, cell: int = CELL) -> tuple[int, int]:
    """Bits per cell and tables, from the number of vectors."""
    bits = max(0, ceil(log2(max(1, vectors) / cell)))
    together = (1 - acos(similar) / pi) ** bits
    tables = 1 if bits == 0 else ceil(log(1 - RECALL) / log(1 - together))
    return bits, tables


@lru_cache(maxsize=8)
def directions(length: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, count))


@lru_cache(maxsize=8)
def least_count(similar: float) -> int:
    """Collisions that all but a few pairs at the threshold reach."""
    p = erf(WINDOW / 2**0.5)
    missed = 0.0
    for n in range(PROJECTIONS + 1):
        missed += comb(PROJECTIONS, n) * p**n * (1 - p) ** (PROJECTIONS - n)
        if missed > 1 - RECALL:
            return n
    return PROJECTIONS


def sound(vector: str):
    """Vectors that can be compared."""
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    some = F.exists(vector, lambda e: e != 0)
    return F.coalesce(F.col(vector).isNotNull() & ~F.exists(vector, odd) & some, F.lit(False))


def nodes(vectors: DataFrame) -> DataFrame:
    """Different vectors: ``node``, ``v``, ``first`` (smallest id) and ``rows``."""
    one = (
        vectors.filter(sound("v")).groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    )
    return stored(one.select(F.monotonically_increasing_id().alias("node"), "*"), "vectors")


def _units(rows: np.ndarray) -> np.ndarray:
    # The largest component becomes one first, so that squares neither overflow nor vanish.
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(1, keepdims=True))


def with_cells(known: DataFrame, bits: int, tables: int) -> DataFrame:
    """``node``, ``rows``, ``unit`` and ``cells``: the cell in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for length, part in frame.groupby(frame["v"].map(len)):
                unit = _units(np.stack(part["v"].to_numpy()))
                signs = unit @ directions(length, bits * tables, 1) > 0
                codes = signs.reshape(len(part), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                # Vectors of different lengths never meet.
                codes = codes * (1 << 20) + min(length, (1 << 20) - 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part["node"], pa.int64()),
                        pa.array(part["rows"], pa.int64()),
                        pa.array(list(unit), pa.list_(pa.float64())),
                        pa.array(list(codes), pa.list_(pa.int64())),
                    ],
                    ["node", "rows", "unit", "cells"],
                )

    schema = "node bigint, rows bigint, unit array<double>, cells array<bigint>"
    return stored(known.select("node", "rows", "v").mapInArrow(run, schema), "cells")


def _pairs(unit: np.ndarray, others: np.ndarray, same: bool, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs between two sets of unit vectors (or within one)."""
    length = unit.shape[1]
    spread = (2 - 2 * similar) ** 0.5
    lines = directions(length, PROJECTIONS + 1, 2)
    sort_by = lines[:, -1] / np.sqrt((lines[:, -1] ** 2).sum())
    levels = lambda x: np.floor(x @ lines[:, :-1] * LEVELS).astype(np.int64).astype(np.uint8)
    # Flooring moves a difference by less than one level; differences are taken modulo 256.
    half = int(WINDOW * spread * LEVELS) + 1
    need = least_count(similar)
    along = others @ sort_by
    order = np.argsort(along, kind="stable")
    sorted_along, sorted_levels = along[order], np.ascontiguousarray(levels(others)[order].T)
    centre, own_levels = unit @ sort_by, levels(unit)
    reach = min(1.0, RANGE / length**0.5) * spread
    queue = np.argsort(centre, kind="stable")
    found_a, found_b = [], []
    for start in range(0, len(queue), ROWS):
        rows = queue[start : start + ROWS]
        low = np.searchsorted(sorted_along, centre[rows[0]] - reach, "left")
        high = np.searchsorted(sorted_along, centre[rows[-1]] + reach, "right")
        count = np.zeros((len(rows), high - low), np.uint8)
        for p in range(PROJECTIONS):
            apart = sorted_levels[p, low:high][None] - (own_levels[rows, p] - np.uint8(half))[:, None]
            count += apart <= np.uint8(2 * half)
        i, j = np.nonzero(count >= need)
        a, b = rows[i], order[low:high][j]
        if same:
            once = a < b
            a, b = a[once], b[once]
        for part in range(0, len(a), 1 << 18):
            x, y = a[part : part + (1 << 18)], b[part : part + (1 << 18)]
            near = np.einsum("ij,ij->i", unit[x], others[y]) >= similar
            found_a.append(x[near])
            found_b.append(y[near])
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return joined(found_a), joined(found_b)


def _links(similar: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, table = (int(pdf[c].iloc[0]) for c in ("_i", "_j", "table"))
        pdf = pdf.sort_values("node", kind="stable").reset_index(drop=True)
        block = pdf["_own"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")
        unit = np.stack(pdf["unit"].to_numpy())
        a, b = _pairs(unit[left], unit[right], i == j, similar)
        a, b = left[a], right[b]
        if table and len(a):
            cells = np.stack(pdf["cells"].to_numpy())[:, :table]
            fresh = np.concatenate(
                [(cells[x] != cells[y]).all(1) for x, y in zip(_cut(a), _cut(b), strict=True)]
            )
            a, b = a[fresh], b[fresh]
        rows, node = pdf["rows"].to_numpy(), pdf["node"].to_numpy()
        links = np.bincount(a, rows[b], len(pdf)) + np.bincount(b, rows[a], len(pdf))
        root = roots(len(pdf), a, b)
        hit = links > 0
        return pd.DataFrame({"node": node[hit], "links": links[hit].astype(np.int64), "root": node[root[hit]]})

    return run


def _cut(x: np.ndarray) -> list[np.ndarray]:
    return [x[i : i + (1 << 18)] for i in range(0, len(x), 1 << 18)]


def linked(placed: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``node``, ``links`` and ``root`` as each cell sees them."""
    dealt = placed.select("node", "rows", "unit", "cells", F.posexplode("cells").alias("table", "cell"))
    sizes = placed.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").count()
    large = stored(sizes.filter(F.col("count") > LARGE), "large-cells")
    cut = dealt.withColumn("_blocks", F.lit(1))
    if not large.isEmpty():
        blocks = F.ceil(F.col("count") / (LARGE // 2)).cast("int")
        cut = dealt.join(large.select("table", "cell", blocks.alias("_more")), ["table", "cell"], "left")
        cut = cut.withColumn("_blocks", F.coalesce("_more", F.lit(1))).drop("_more")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    spread = cut.withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )
    grouped = spread.withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
    schema = "node bigint, links bigint, root bigint"
    return grouped.groupBy("table", "cell", "_i", "_j").applyInPandas(_links(similar), schema)


def near_vectors(df: DataFrame, vector: str = "embedding", similar: float = SIMILAR, cell: int = CELL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    vectors = df.select("vec_id", F.col(vector).cast("array<double>").alias("v"))
    known = nodes(vectors)
    bits, tables = plan(known.count(), similar, cell)
    found = stored(linked(with_cells(known, bits, tables), similar), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = known.join(links, "node", "left").join(group, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    facts = named.join(least, "component").select(
        F.col("v").alias("_v"),
        (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        "component_id",
    )
    every = vectors.join(facts, F.when(sound("v"), F.col("v")) == F.col("_v"), "left")
    own = F.coalesce("component_id", "vec_id")
    return every.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.col("vec_id").eqNullSafe(own).alias("kept"),
    )
