"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from its distinct words
and their first letters, which inflected forms share (a logistic model), and the document's
score is their noisy-or: it is toxic if at least one sentence is. Only document labels are known, so the sentence model is trained through the
noisy-or; afterwards it tells which sentences offend.

Labels are learnt from a sample of the labelled rows whose bound is a parameter; it is
drawn by a digest of the id, so reruns agree. Scores use the text alone.

Edge cases: a null or empty text is one empty sentence and gets the score of the bias;
without any labelled training row every score is that of the starting bias; rows with a
null label or id teach nothing; a document with several labels counts as toxic if one of
them says so; repeated rows get equal scores; extra columns pass through, and columns
named like a new one are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import by_place, sliced, stored

THRESHOLD = 0.3
#: Training rows wanted at most, on average over draws, and characters in them.
SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 40_000_000
#: Least likelihood ratio (G squared) of a word and the labels; by chance one word in about
#: two millions gets there.
LEAST_RATIO = 25.0
#: Lengths of the word beginnings that are features besides the word.
STEMS = (4, 5, 6, 7)
START_BIAS = -6.0
STEPS = 120
#: Words whose weight a worker remembers.
REMEMBERED = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and lower-case words of each sentence."""
    for match in _SENTENCE.finditer(text):
        yield match.start(), match.end(), set(_WORD.findall(match.group().lower()))


def features(word: str) -> list[str]:
    """A word and its beginnings, which inflected forms share; a mark keeps them apart."""
    return [word, *(word[:n] + "*" for n in STEMS if n <= len(word))]


def _share(labels: DataFrame, wanted: int) -> DataFrame:
    """Rows whose digest falls below the share that leaves ``wanted`` rows on average."""
    count = labels.count()
    share = min(1.0, wanted / max(1, count))
    unit = F.pmod(F.xxhash64(F.col("_id"), F.lit("toxicity")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return labels.filter(unit < share)


def training_rows(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS
) -> DataFrame:
    """``toxic`` and ``text`` of a bounded sample of labelled rows that may be learnt from."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").alias("_toxic"))
    )
    # The sample's size is bounded by ``rows``, so its ids can be sent to every task.
    chosen = F.broadcast(_share(known, rows))
    texts = docs.join(chosen, docs["doc_id"] == chosen["_id"]).select(
        "_id", (F.col("_toxic") > 0).cast("int").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")
    )
    sample = stored(texts, "toxicity-sample")
    total = sample.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > chars:
        unit = F.pmod(F.xxhash64("_id", F.lit("length")), F.lit(1 << 32)) / F.lit(float(1 << 32))
        sample = sample.filter(unit < chars / total)
    return sample.drop("_id")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each feature, by label."""
    for batch in sliced(batches):
        counts: dict[str, list[int]] = {}
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            known = set().union(*(w for _, _, w in sentences(text)))
            for feature in {f for word in known for f in features(word)}:
                counts.setdefault(feature, [0, 0])[y] += 1
        columns = [list(counts), [c[0] for c in counts.values()], [c[1] for c in counts.values()]]
        types = [pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["feature", "clean", "toxic"]
        )


def telling(rows: DataFrame) -> list[str]:
    """Words and stems whose presence depends on the label, by likelihood ratio."""
    n = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    size = {"clean": n.get(0, 0), "toxic": n.get(1, 0)}
    if not all(size.values()):
        return []
    counts = (
        rows.mapInArrow(_counted, "feature string, clean bigint, toxic bigint")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    share = (F.col("clean") + F.col("toxic")) / sum(size.values())
    ratio = F.lit(0.0)
    for label, total in size.items():
        for seen, chance in ((F.col(label), share), (total - F.col(label), 1 - share)):
            ratio += F.when(seen > 0, 2 * seen * F.log(seen / (total * chance))).otherwise(0.0)
    best = counts.withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    # The sample bounds how many features there are, the ratio how many of them tell.
    return [r[0] for r in best.orderBy(F.desc("ratio"), "feature").select("feature").collect()]


def train(rows: DataFrame, steps: int = STEPS) -> dict[str, float]:
    """Weights of words and stems in the sentence model; the bias is kept under the empty word.

    The driver gets, per document of the sample, the label, the number of sentences
    without any telling word, and the places of telling words in the other ones.
    """
    place = {w: i + 1 for i, w in enumerate(telling(rows))}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain, found = [], []
            for text in batch.column(1).to_pylist():
                every = [words for _, _, words in sentences(text)] or [set()]
                lists = [[place[f] for w in sorted(s) for f in features(w) if f in place] for s in every]
                found.append([x for x in lists if x])
                plain.append(len(lists) - len(found[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(plain, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))],
                ["toxic", "plain", "found"],
            )

    made = rows.select("toxic", "text").mapInArrow(bags, "toxic int, plain bigint, found array<array<int>>")
    known = sorted((r[0], r[1], r[2]) for r in made.collect())
    weights = _fit(known, len(place), steps)
    return {"": float(weights[0]), **{w: float(weights[i]) for w, i in place.items()}}


def _fit(bags: list[tuple[int, int, list[list[int]]]], known: int, steps: int) -> np.ndarray:
    """Gradient steps on the likelihood of the labels under the noisy-or of the sentences."""
    weights = np.zeros(known + 1)
    weights[0] = START_BIAS
    if not bags:
        return weights
    # Place 0 is the bias. A bag's plain sentences are all alike: one sentence, many times.
    words = [s for _, _, found in bags for s in ([0], *([0, *x] for x in found))]
    times = np.array([t for _, plain, found in bags for t in (plain, *[1] * len(found))], float)
    sizes = [1 + len(found) for _, _, found in bags]
    index = np.fromiter((i for s in words for i in s), np.int64)
    starts = np.cumsum([0, *map(len, words)])[:-1]
    of_sentence = np.repeat(np.arange(len(words)), list(map(len, words)))
    first = np.cumsum([0, *sizes])[:-1]
    of_bag = np.repeat(np.arange(len(bags)), sizes)
    toxic = np.array([y for y, _, _ in bags], bool)
    slope, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        z = np.add.reduceat(weights[index], starts)
        clear = times * np.logaddexp(0, z)  # minus the log of the chance that all are clean
        total = np.maximum(np.add.reduceat(clear, first), 1e-12)
        pull = np.where(toxic, -1 / np.expm1(np.minimum(total, 500)), 1.0)
        by_sentence = times * pull[of_bag] / (1 + np.exp(-z))
        gradient = np.bincount(index, by_sentence[of_sentence], len(weights)) / len(bags)
        gradient[1:] += 1e-6 * weights[1:]
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.3 * min(1.0, 2 * (1 - step / (steps + 1)))
        weights -= rate * (slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-7)
    return weights


class Weights(dict):
    """Weight of a word with its stem, worked out on first use; of bounded size."""

    def __init__(self, model: dict[str, float]):
        super().__init__()
        self.model = model
        self.bias = model[""]

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = math.fsum(self.model.get(f, 0.0) for f in features(word))
        return value


def judge(text: str, weights: Weights, threshold: float = THRESHOLD):
    """Score of a text, and the sentences whose own score reaches the threshold."""
    bias, total, found = weights.bias, 0.0, []
    weigh = weights.__getitem__
    for start, end, words in sentences(text):
        z = bias + math.fsum(map(weigh, words))
        total += math.log1p(math.exp(z)) if z < 30 else z
        if z > -2 and (score := 1 / (1 + math.exp(-z))) >= threshold:
            found.append((start, end, score))
    if not total:
        total = math.log1p(math.exp(bias))
    return -math.expm1(-total), found


def score(
    docs: DataFrame, weights: dict[str, float], text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """Add ``score``, ``predicted`` and ``offending`` (start, end and score of sentences)."""
    new = ("score", "predicted", "offending")
    kept = [c for c in docs.columns if c not in new]
    given = by_place(docs, kept, F.col(f"`{text}`"))
    names = [*given.columns[: len(kept)], "n0", "n1", "n2"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Weights(shared.value)
        for batch in sliced(batches):
            judged = [judge(x or "", model, threshold) for x in batch.column(len(kept)).to_pylist()]
            made = [
                pa.array([s for s, _ in judged], pa.float64()),
                pa.array([int(s >= threshold) for s, _ in judged], pa.int32()),
                pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in f] for _, f in judged], spans),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names)

    types = [f.dataType.simpleString() for f in given.schema.fields][: len(kept)]
    types += ["double", "int", "array<struct<start: int, end: int, score: double>>"]
    return given.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))).toDF(*kept, *new)
