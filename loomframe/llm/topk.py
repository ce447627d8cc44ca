"""Exact top-k by inner product with ball trees.

Rows are dealt to shards; a shard's rows form a ball tree (split at the median of the
widest direction, down to small leaves, each node with centre and radius). Queries come in
blocks. A block visits the shard's leaves in the order of their inner-product upper bound

    q . x <= q . centre + |q| * radius

and leaves out those whose bound is below the query's current k-th score. The first round
searches one shard per query; its k-th score is shared with the searches of all other
shards, which so start with a score to beat. The best k of all shards are the result: a
bound below the k-th score proves that nothing is missed, so it is exact.

Components are integers, inner products are exact in doubles as long as they stay below
2**53, and bounds get slack for rounding.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor
do rows with a null id; vectors of another length than a query's have no score with it;
empty vectors take no part; equal scores go to the smaller id; rows with one id are rows of
their own, as queries and as candidates, and only the query's own row is left out; fewer than
k candidates give all of them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import stored

#: Rows of a shard and queries of a block, on average.
SHARD_ROWS = 8_192
BLOCK_QUERIES = 1_024
LEAF = 128

_FOUND = "query_id bigint, query_row bigint, vec_id bigint, score bigint"


def quantised(df: DataFrame, vector: str, scale: float = 64.0) -> DataFrame:
    """``vec_id``, ``row`` (a number of its own) and ``v``: floor(scale * x) of each component,
    of the vectors that take part. To be stored before use, which fixes the numbers."""
    x = F.col(vector)
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    sound = df.filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: F.coalesce(odd(e), F.lit(True)))
    )
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("double"))
    return sound.select("vec_id", F.monotonically_increasing_id().alias("row"), whole.alias("v"))


class BallTree:
    """Leaves of a ball tree over the rows of a matrix."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        self.parts: list[np.ndarray] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        stack = [np.arange(len(rows))]
        while stack:
            part = stack.pop()
            own = rows[part]
            centre = own.mean(0)
            if len(part) <= leaf or (own == own[0]).all():
                # Ids ascending, so that equal scores stay in the order wanted.
                part = part[np.argsort(ids[part], kind="stable")]
                self.parts.append(part)
                self.centres.append(centre)
                self.radii.append(float(np.sqrt(((own - centre) ** 2).sum(1).max())))
                continue
            far = own[np.argmax(((own - centre) ** 2).sum(1))]
            side = own @ (own[np.argmax(((own - far) ** 2).sum(1))] - far)
            order = np.argsort(side, kind="stable")
            stack += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        self.ids, self.numbers, self.rows = ids, numbers, rows

    def search(
        self, own: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query numbers, ids and scores of up to k rows per query that reach ``least``.

        ``own`` are the numbers of the queries' own rows.
        Leaves are visited in the order of the largest bound of the block; each query
        takes part while the leaf's bound reaches its own k-th score.
        """
        bounds = queries @ np.array(self.centres).T
        bounds += np.sqrt((queries**2).sum(1))[:, None] * np.array(self.radii)[None]
        bounds += 1e-6 * (1 + np.abs(bounds))
        n = len(queries)
        best = np.full((n, k), -np.inf)
        names = np.full((n, k), np.iinfo(np.int64).max)
        beat = least.astype(float).copy()
        for leaf in np.argsort(-bounds.max(0), kind="stable"):
            active = np.flatnonzero(bounds[:, leaf] >= beat)
            if not len(active):
                continue
            part = self.parts[leaf]
            scores = queries[active] @ self.rows[part].T
            scores[own[active][:, None] == self.numbers[part][None]] = -np.inf
            scores[scores < beat[active][:, None]] = -np.inf
            some = scores.max(1) > -np.inf
            active, scores = active[some], scores[some]
            if not len(active):
                continue
            every = np.concatenate([best[active], scores], 1)
            known = np.concatenate([names[active], np.broadcast_to(self.ids[part], scores.shape)], 1)
            order = np.lexsort((known, -every), axis=1)[:, :k]
            best[active] = np.take_along_axis(every, order, 1)
            names[active] = np.take_along_axis(known, order, 1)
            beat[active] = np.maximum(beat[active], best[active][:, -1])
        at, place = np.nonzero(best > -np.inf)
        yield at, names[at, place], best[at, place]


def _by_length(pdf: pd.DataFrame, vector: str) -> dict[int, pd.DataFrame]:
    return dict(iter(pdf.groupby(pdf[vector].map(len), sort=True)))


def _search(k: int):
    """Search of one query block in one shard, for co-grouped rows."""

    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        vectors = _by_length(rows, "v")
        for length, block in _by_length(queries, "q").items():
            own = vectors.get(length)
            if own is None:
                continue
            stacked = np.stack(own["v"].to_numpy()).astype(float)
            tree = BallTree(own["vec_id"].to_numpy(), own["row"].to_numpy(), stacked)
            for start in range(0, len(block), BLOCK_QUERIES):
                part = block.iloc[start : start + BLOCK_QUERIES]
                q_ids, q_rows = part["query_id"].to_numpy(), part["query_row"].to_numpy()
                found = tree.search(q_rows, np.stack(part["q"].to_numpy()).astype(float), k, part["least"].to_numpy())
                for at, ids, scores in found:
                    made = {"query_id": q_ids[at], "query_row": q_rows[at], "vec_id": ids, "score": scores.astype(np.int64)}
                    out.append(pd.DataFrame(made))
        empty = pd.DataFrame({"query_id": [], "query_row": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.concat(out) if out else empty

    return run


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best per query with their rank; each query has at most k rows per shard."""
    # Negated scores sort descending within a struct.
    ordered = found.groupBy("query_id", "query_row").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("_down"), "vec_id"))), 1, k).alias("_best")
    )
    return ordered.select("query_id", F.posexplode("_best").alias("_at", "_one")).select(
        "query_id",
        (F.col("_at") + 1).cast("int").alias("rank"),
        F.col("_one.vec_id").alias("vec_id"),
        (-F.col("_one._down")).alias("score"),
    )


def search(
    queries: DataFrame, rows: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows per query.

    Both sides have ``vec_id``, ``row`` and ``v`` (whole numbers as doubles) and are read
    from storage, queries with the numbers that they have among the rows. Every query visits every shard, as exactness asks; with the shared scores a
    visit mostly ends at the bounds.
    """
    shards = int(rows.count() // shard_rows) + 1
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    # First round: one shard per query, the shards dealt evenly.
    home = F.pmod(F.xxhash64("query_row", F.lit("home")), F.lit(shards)).cast("int")
    # Blocks of a shard's visitors bound what one task holds.
    blocks = int(queries.count() // BLOCK_QUERIES) + 1
    block = F.pmod(F.xxhash64("query_row", F.lit("block")), F.lit(blocks)).cast("int")
    run = _search(k)

    def visit(visitors: DataFrame, per_shard: int) -> DataFrame:
        """Rows of a shard go to each block of its visitors."""
        placed = visitors.withColumn("block", F.pmod(F.col("block"), F.lit(per_shard)))
        copies = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(per_shard - 1))))
        return (
            placed.groupBy("shard", "block")
            .cogroup(copies.groupBy("shard", "block"))
            .applyInPandas(run, _FOUND)
        )

    # New names: both sides may come from one table.
    asked = queries.select(
        F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), F.col("v").alias("q")
    ).withColumn("block", block)
    unknown = F.lit(float("-inf"))
    first = visit(
        asked.withColumn("shard", home).withColumn("least", unknown),
        max(1, round(blocks / shards)),
    )
    first = stored(first, "topk-first")
    if shards == 1:
        return best(first, k)
    kth = first.groupBy("query_row").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("_kth")
    )
    known = asked.join(kth, "query_row", "left").select(
        "query_id", "query_row", "q", "block", F.coalesce("_kth", unknown).alias("least"), home.alias("_home")
    )
    others = known.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter(
        F.col("shard") != F.col("_home")
    )
    rest = visit(others.drop("_home"), blocks)
    return best(first.unionByName(rest), k)
