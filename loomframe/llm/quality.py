"""Quality of documents by pairwise ranking (Bradley-Terry).

Every document has a score, and of two documents the one with the higher score is preferred
with the logistic probability of the difference. Pairs of a good and a bad labelled document
are the preferences; the weights are learnt by logistic loss on the differences of their
features, so nothing but order is learnt and no bias is needed. Then the scores of all
labelled rows that may be learnt from are ranked, and the quantile at the share of bad ones
among them becomes the threshold. A score from 0 to 1 is the logistic probability that a
document is preferred to one at the threshold, moved so that the threshold itself gets
``THRESHOLD``.

Features describe how a text is written, not what it says: shares of kinds of characters, of
signs, of short, capitalised and repeated words, the shape of lines, and the worst stretch of
lines by the same counts, so that a bad half is seen next to a good one. Each is also cut into
steps at quantiles of the sample.

Only a sample of labelled rows, bounded by parameters, is used to fit the weights; it is drawn
by a digest of the id, so reruns agree. The threshold covers all labelled rows that may be learnt from, by
counts of scores on a fixed grid.

Edge cases: a null or empty text has all shares zero and gets the score of these; without
labelled rows of both kinds all weights are zero and every score is ``THRESHOLD``; rows with a
null label or id teach nothing; a document with several labels counts as bad if one of them
says so; repeated rows get equal scores; extra columns pass through, and columns named like a
new one are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import mixed, sliced, stored
from loomframe.llm.toxicity import held_out

THRESHOLD = 0.7
#: Labelled rows that weights are fitted on, on average over draws.
SAMPLE_ROWS = 8_000
#: Preference pairs drawn from the sample.
PAIRS = 40_000
STEPS = 200
#: Quantiles of the sample at which a feature is cut into steps.
CUTS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98)
#: Scores are ranked on a grid of this many steps between -SPAN and SPAN.
GRID = 1 << 16
SPAN = 64.0
#: Characters of the stretches whose worst one counts.
STRETCH = 400

_SIGNS = "!#$%&*+-/<=>?@^_|~.,;:'\"()[]{}\\`"
_KINDS = ["upper", "digit", "space", "newline", "control", "high"]
_SENTENCE_END = re.compile(r"[.!?]\s")


def _table() -> np.ndarray:
    """Kind of each byte: kinds above first, then one per sign, 0 for what is left."""
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(65, 91)]], kinds[[*range(48, 58)]] = 1, 2
    kinds[[32, 9]], kinds[[10, 13]] = 3, 4
    kinds[[b for b in range(32) if b not in (9, 10, 13)]] = 5
    kinds[128:] = 6
    for i, sign in enumerate(_SIGNS):
        kinds[ord(sign)] = 7 + i
    return kinds


_KIND = _table()
_MANY = 1 + len(_KINDS) + len(_SIGNS)


def _shares(codes: np.ndarray) -> np.ndarray:
    return np.bincount(codes, minlength=_MANY)[1:] / max(1, len(codes))


def features(text: str) -> np.ndarray:
    """Numbers between 0 and about 1 that describe how a text is written."""
    codes = _KIND[np.frombuffer(text.encode(), np.uint8)]
    shares = _shares(codes)
    # Signs and capitals by stretches: the worst one, and how many are much like it.
    signs = (codes >= 7).astype(np.float64)
    capitals = (codes == 1).astype(np.float64)
    starts = np.arange(0, max(1, len(codes)), STRETCH)
    sizes = np.maximum(1, np.diff(np.r_[starts, len(codes)]))
    by = [np.add.reduceat(x, starts) / sizes if len(x) else np.zeros(1) for x in (signs, capitals)]
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    most = max(counts.values(), default=0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in text.split("\n") if x.strip()]
    line_count = max(1, len(lines))
    ends = sum(1 for w in words if not w[-1].isalnum())
    heads = sum(1 for w in words if w[:1].isupper())
    shout = sum(1 for w in words if len(w) > 1 and w.isupper())
    lone = sum(1 for w in words if not any(map(str.isalnum, w)))
    return np.concatenate(
        [
            np.sqrt(shares),
            [
                by[0].max(), by[0].mean(), (by[0] > 0.08).mean(), by[1].max(), (by[1] > 0.3).mean(),
                math.log1p(len(words)) / 10, math.log1p(len(lines)) / 10, len(counts) / n, most / n, again / n,
                1 - pairs / max(1, n - 1) if n > 1 else 0.0, lengths.mean() / 20, lengths.std() / 20,
                math.log1p(int(lengths.max())) / 10, ends / n, heads / n, shout / n, lone / n,
                len(set(lines)) / line_count, sum(x.rstrip()[-1] in ".!?" for x in lines) / line_count,
                math.log1p(len(text) / line_count) / 10, len(_SENTENCE_END.findall(text)) / n,
            ],
        ]
    )


def _by_place(df: DataFrame, kept: list[str], last: str) -> DataFrame:
    """Columns renamed by place, so that no name can clash: the kept ones, then ``last``."""
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{last}`")).toDF(*[f"c{i}" for i in range(len(kept) + 1)])


def _with_new(given: DataFrame, kept: list[str], run, new: list[tuple[str, str]]) -> DataFrame:
    types = [f.dataType.simpleString() for f in given.schema.fields]
    schema = [f"c{i} {types[i]}" for i in range(len(kept))] + [f"n{i} {t}" for i, (_, t) in enumerate(new)]
    return given.mapInArrow(run, ", ".join(schema)).toDF(*kept, *[n for n, _ in new])


def describe(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``features`` of every whole text, an array of numbers; texts are read here only."""
    kept = [c for c in docs.columns if c != "features" and (keep_text or c != text)]
    names = [*(f"c{i}" for i in range(len(kept))), "n0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [features(x or "") for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(made, pa.list_(pa.float64()))], names
            )

    return _with_new(_by_place(docs, kept, text), kept, run, [("features", "array<double>")])


def labelled(described: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``id``, ``good``, ``drawn`` (in the sample) and ``x`` of rows that may be learnt from.

    About ``rows`` labels are drawn: those whose digest falls below the share that leaves
    so many on average.
    """
    known = stored(
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.min((F.col("quality") > 0).cast("int")).alias("good")),
        "quality-labels",
    )
    share = min(1.0, rows / max(1, known.count()))
    unit = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    narrow = described.select(F.col("doc_id").alias("id"), F.col("features").alias("x")).filter(~held_out("id"))
    return stored(narrow.join(known.withColumn("drawn", unit < share), "id"), "quality-features")


class Model:
    """Weights of the features and of their steps; the threshold is put in afterwards."""

    def __init__(self, cuts: np.ndarray, weights: np.ndarray, threshold: float = 0.0):
        self.cuts, self.weights, self.threshold = cuts, weights, threshold

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Features and, per cut, whether a feature lies above it."""
        return np.concatenate([x, (x[:, None, :] > self.cuts).reshape(len(x), -1)], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.wide(x) @ self.weights, -SPAN, SPAN)


def fit(good: np.ndarray, x: np.ndarray, pairs: int = PAIRS, steps: int = STEPS) -> Model:
    """Logistic loss of the feature differences of preference pairs, by gradient steps."""
    width = x.shape[1] if len(x) else len(features(""))
    cuts = np.quantile(x, CUTS, axis=0) if len(x) else np.zeros((len(CUTS), width))
    model = Model(cuts, np.zeros(width * (1 + len(CUTS))))
    above, below = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(above) or not len(below):
        return model
    # Every document is in some pair; which other one it meets is drawn by a hash.
    every = np.arange(max(pairs, len(above), len(below)), dtype=np.uint64)
    a = above[(np.arange(len(every)) % len(above))]
    b = below[(mixed(every) % np.uint64(len(below))).astype(np.int64)]
    b[: len(below)] = below
    wide = model.wide(x)
    weights, slope, square = model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights)
    for step in range(1, steps + 1):
        score = wide @ weights
        miss = 1 / (1 + np.exp(np.clip(score[a] - score[b], -500, 500)))
        pull = np.bincount(a, miss, len(x)) - np.bincount(b, miss, len(x))
        gradient = 1e-3 * weights - (pull @ wide) / len(every)
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.05 * min(1.0, 2 * (1 - step / (steps + 1)))
        weights -= rate * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    return model


def _quantile(scored: DataFrame) -> float:
    """Score that as many labelled rows stay below as are bad, by counts on the grid.

    Between the last row below and the first one above the middle is taken.
    """
    cell = F.least(F.greatest(F.floor((F.col("raw") + SPAN) * (GRID / (2 * SPAN))), F.lit(0)), F.lit(GRID - 1))
    counts = scored.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(1 - F.col("good")).alias("bad"))
    # The grid bounds these rows.
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    ranked = counts.select("cell", F.sum("n").over(upto).alias("upto"), F.sum("bad").over(whole).alias("bad"))
    low, high = ranked.agg(
        F.max(F.when(F.col("upto") <= F.col("bad"), F.col("cell"))),
        F.min(F.when(F.col("upto") > F.col("bad"), F.col("cell"))),
    ).first()
    middle = [c for c in (low, high) if c is not None]
    return (sum(middle) / len(middle) + 0.5) * (2 * SPAN / GRID) - SPAN if middle else 0.0


def train(known: DataFrame) -> Model:
    """Fit on the drawn rows of ``labelled``; the threshold counts all of its rows."""
    drawn = sorted((r[0], r[1], r[2]) for r in known.filter("drawn").select("id", "good", "x").collect())
    model = fit(np.array([g > 0 for _, g, _ in drawn], bool), np.array([x for _, _, x in drawn], float))
    if model.weights.any():

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [model.raw(np.array([x], float))[0] for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], ["good", "raw"])

        model.threshold = _quantile(known.select("good", "x").mapInArrow(rank, "good int, raw double"))
    return model


def judge(x: list[float], model: Model, threshold: float = THRESHOLD) -> float:
    """Score from 0 to 1 by the features of a text."""
    raw = model.raw(np.array([x], float))[0]
    return float(1 / (1 + np.exp(model.threshold - raw - math.log(threshold / (1 - threshold)))))


def score(described: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` (1 from the threshold on) by the column ``features``."""
    kept = [c for c in described.columns if c not in ("score", "predicted", "features")]
    shared = described.sparkSession.sparkContext.broadcast(model)
    names = [*(f"c{i}" for i in range(len(kept))), "n0", "n1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = np.array([judge(x, shared.value, threshold) for x in batch.column(len(kept)).to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(made), pa.array(made >= threshold).cast(pa.int32())], names
            )

    return _with_new(_by_place(described, kept, "features"), kept, run, [("score", "double"), ("predicted", "int")])
