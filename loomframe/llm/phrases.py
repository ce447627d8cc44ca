"""Phrase collocations by HAT-trie counting.

Texts are lower-cased (A to Z), cut into pieces and words; every place of a piece starts a
window of up to ``LONGEST`` words, and the occurrences of a phrase are the windows that begin
with it. A task keeps its windows in a trie over word numbers whose lower levels are hash
containers: a container that grows beyond ``BURST`` entries becomes a node with one container
per next word. When the trie holds ``HELD`` entries, its largest subtrees leave whole, as
runs sorted by their words. Runs are partitioned by prefix (the first two words, split
sixteen ways by the third so that a hot pair does not meet in one task), sorted, and merged in one
stream per partition, which adds up every prefix on its way with one counter per level.

Most windows can hold no frequent phrase, and are cut short beforehand: a first pass counts
words and pairs of neighbours by a hash into a number of places (each count stops at the
least frequency), a second one triples whose pairs may be frequent. What falls on a place
that stays below the least frequency is rarer than that for certain, and a window ends before it.
Nothing frequent is lost by that, whatever the size. The places grow with the text up to
``MOST_PLACES``; beyond that they fill and windows are longer. They are sent to every task as
bits, sixteen megabytes per level at most.

Scores compare whole numbers: ``floor(SCALE * count / (left + right))`` of the weakest cut.

Edge cases: a null or empty text has no words; a null language is ``und``; repeated rows
count as often as they stand there; words of any length and with any characters but blanks
and the cutting signs are kept whole; ties are broken as documented in ``ranked``; a table
without frequent phrases gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import mixed, sliced, stored
from loomframe.operators.ordered import attach

LONGEST = 4
#: Occurrences that a phrase must have.
LEAST = 30
#: A phrase is dropped if a longer one around it has this many hundredths of its occurrences.
SHARE = 80
SCALE = 2_000_000
#: Phrases reported per language.
REPORT = 2_000
#: Places of the counts of pairs and of triples: one for so many bytes of text, within bounds.
BYTES_PER_PLACE = 16
LEAST_PLACES = 1 << 16
MOST_PLACES = 1 << 27
#: Text of a task; small splits of a file are read together, so that more is counted in one trie.
TASK_BYTES = 256 << 20
#: Bytes that are worked on at once.
STRETCH = 4 << 20
#: Places that are sent as one row.
SECTION = 1 << 14
#: Entries of a hash container before it bursts, and of a task's trie before subtrees leave.
BURST = 4_096
HELD = 1_000_000
#: Words a task numbers before it starts anew.
KNOWN = 600_000
#: Ways in which the phrases of a hot pair of first words are split, and a language's ranking.
SPLIT = 16

#: Bytes that end a piece become line feeds, tabs become blanks, A-Z become a-z.
_BYTES = bytes(
    10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
class Words(dict):
    """Number of each word, given on first sight; 0 is no word."""

    def __init__(self):
        super().__init__()
        self.names = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append(word)
        return number


class Text:
    """Words of a stretch in one language: their hashes, and where pieces end."""

    def __init__(self, lang: str, stretch: bytes):
        self.bytes = stretch
        codes = np.frombuffer(stretch, np.uint8)
        inside = (codes != 32) & (codes != 10)
        first = inside & ~np.concatenate([[False], inside[:-1]])
        starts, at = np.flatnonzero(first), np.flatnonzero(inside)
        #: Words with equal numbers stand in one piece.
        self.piece = np.cumsum(codes == 10)[starts]
        # A polynomial over the bytes of a word, from its start.
        offset = at - starts[np.cumsum(first)[at] - 1]
        powers = np.full(int(offset.max(initial=0)) + 1, 0x100000001B3, np.uint64)
        powers[0] = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little") | 1
        terms = (codes[at].astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[offset]
        self.hashes = mixed(np.add.reduceat(terms, np.flatnonzero(offset == 0))) if len(at) else np.zeros(0, np.uint64)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hash of the word, the pair and the triple that begins at each word, and whether it is whole."""
        n = len(self.hashes)
        mix, whole = self.hashes, np.ones(n, bool)
        yield mix, whole
        for k in (1, 2):
            whole, behind = np.zeros(n, bool), np.zeros(n, np.uint64)
            whole[: n - k] = self.piece[k:] == self.piece[: n - k]
            behind[: n - k] = self.hashes[k:]
            mix = mixed(mix ^ behind)
            yield mix, whole

    def words(self, kept: np.ndarray) -> Iterator[bytes]:
        """The words marked in ``kept``."""
        return compress(self.bytes.split(), kept.tolist())


class Places:
    """Which places of words, of pairs and of triples are frequent, as bits."""

    def __init__(self, count: int):
        self.count = count
        self.bits: list[bytes] = []

    def at(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.count)).astype(np.int64)

    def frequent(self, level: int, hashes: np.ndarray) -> np.ndarray:
        """Whether hashes fall on frequent places."""
        at = self.at(hashes)
        found = np.frombuffer(self.bits[level], np.uint8)[at >> 3]
        return (found >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    def candidates(self, text: Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes per level, and what there can still be frequent; unknown levels rule out nothing."""
        fits = None
        for level, (hashes, whole) in enumerate(text.levels()):
            # A longer phrase is frequent only if both shorter ones in it are.
            fits = whole if fits is None else whole & fits & np.append(fits[1:], False)
            if level < len(self.bits):
                fits = fits & self.frequent(level, hashes)
            yield hashes, fits


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Texts of each language together, in lower case, cut where a piece ends.

    A stretch is some ``STRETCH`` bytes long, or as long as a piece that is longer.
    """
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts.setdefault(lang, []).append(text)
    for lang, some in texts.items():
        whole, start = b"\n".join(some).translate(_BYTES), 0
        while start < len(whole):
            end = whole.find(b"\n", start + STRETCH)
            end = len(whole) if end < 0 else end
            yield lang, whole[start:end]
            start = end + 1


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _count_places(texts: DataFrame, places: Places, levels: Sequence[int], least: int) -> list[bytes]:
    """Per level a bit per place: whether what falls there occurs ``least`` times together."""
    shared = texts.sparkSession.sparkContext.broadcast(places)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros((len(levels), known.count), np.uint8)
        for batch in sliced(batches):
            for lang, stretch in _stretches(batch):
                for level, (hashes, fits) in enumerate(known.candidates(Text(lang, stretch))):
                    if level in levels:
                        at, n = np.unique(known.at(hashes[fits]), return_counts=True)
                        row = counts[levels.index(level)]
                        row[at] = np.minimum(row[at] + np.minimum(n, least), least)
        flat = counts.reshape(-1)
        for start in range(0, len(flat), SECTION):
            part = flat[start : start + SECTION]
            if part.any():
                made = [zlib.compress(part.tobytes(), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array(made, pa.binary())], ["start", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SECTION, np.uint16)

        def bits() -> pa.RecordBatch:
            made = [np.packbits(total >= least).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array(made, pa.binary())], ["start", "bits"])

        for batch in batches:
            for start, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start != now:
                    if now is not None:
                        yield bits()
                    now, total = start, np.zeros(SECTION, np.uint16)
                total = np.minimum(total + np.frombuffer(zlib.decompress(counts), np.uint8), least)
        if now is not None:
            yield bits()

    counted = texts.mapInArrow(count, "start bigint, counts binary")
    summed = counted.repartition("start").sortWithinPartitions("start").mapInArrow(add, "start bigint, bits binary")
    found = np.zeros(len(levels) * places.count // 8, np.uint8)
    # Bounded by ``MOST_PLACES``, whatever the input.
    for start, bits in summed.collect():
        found[start // 8 : (start + SECTION) // 8] = np.frombuffer(bits, np.uint8)
    return [part.tobytes() for part in found.reshape(len(levels), -1)]


def _sized(docs: DataFrame) -> tuple[DataFrame, int]:
    """Texts in tasks of ``TASK_BYTES``, one for each core at least, and their size in bytes."""
    texts = _texts(docs)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(max(cores, -(-size // TASK_BYTES))), size


def frequent_places(texts: DataFrame, size: int, least: int = LEAST) -> Places:
    """Places of words, pairs and triples that may be frequent, for ``size`` bytes of text."""
    wanted = 1 << max(1, size // BYTES_PER_PLACE).bit_length()
    places = Places(min(MOST_PLACES, max(LEAST_PLACES, wanted)))
    for levels in ([0, 1], [2]):
        places.bits += _count_places(texts, places, levels, least)
    return places


class Container(dict):
    """Rest of a window to its count."""


class Trie:
    """Counts of windows: nodes by word number on top, hash containers below."""

    def __init__(self, burst: int = BURST):
        self.top: dict[int, dict] = {}
        self.sizes: Counter[int] = Counter()
        self.held = 0
        self.burst = burst
        #: Windows of one word end at the root; they need no container.
        self.single: Counter[int] = Counter()

    def entries(self) -> int:
        return self.held + len(self.single)

    def add(self, window: tuple[int, ...], count: int) -> None:
        first = window[0]
        if len(window) == 1:
            self.single[first] += count
            return
        node, rest = self.top.get(first), window[1:]
        if node is None:
            node = self.top[first] = Container()
        above, word = self.top, first
        while not isinstance(node, Container):
            # Word 0 stands for a window that ends at this node.
            above, word, rest = node, rest[0] if rest else 0, rest[1:]
            node = node.get(word)
            if node is None:
                node = above[word] = Container()
        before = len(node)
        node[rest] = node.get(rest, 0) + count
        if len(node) > before:
            self.sizes[first] += 1
            self.held += 1
        if len(node) > self.burst and any(node):
            burst: dict[int, Container] = {}
            for tail, n in node.items():
                burst.setdefault(tail[0] if tail else 0, Container())[tail[1:]] = n
            above[word] = burst

    def subtree(self, first: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """Take a whole subtree out: its windows with their counts."""
        if first in self.single:
            yield (first,), self.single.pop(first)
        if first not in self.top:
            return
        waiting = [((first,), self.top.pop(first))]
        self.held -= self.sizes.pop(first)
        while waiting:
            path, node = waiting.pop()
            if isinstance(node, Container):
                yield from ((path + rest, n) for rest, n in node.items())
            else:
                waiting += [(path + ((word,) if word else ()), below) for word, below in node.items()]

    def largest(self, entries: int) -> list[int]:
        """First words whose subtrees together hold so many entries; lone words come last."""
        chosen, held = [], 0
        for first, n in self.sizes.most_common():
            if held >= entries:
                return chosen
            chosen.append(first)
            held += n + (first in self.single)
        return chosen + [w for w in self.single if w not in self.top]


_RUN = "lang string, w1 string, w2 string, w3 string, w4 string, n bigint"
_ROWS = 20_000


def _windows(numbers: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
    """Windows of two words and more: the third word where the triple may be frequent, the
    fourth where the triple behind it may be too."""
    at = np.flatnonzero(pairs)
    wide = np.append(numbers, [0] * LONGEST)
    third = triples[at]
    fourth = third & np.append(triples, False)[at + 1]
    columns = [wide[at], wide[at + 1], np.where(third, wide[at + 2], 0), np.where(fourth, wide[at + 3], 0)]
    for window, n in Counter(zip(*(c.tolist() for c in columns), strict=True)).items():
        yield tuple(w for w in window if w), n


def _run_batch(lang: str, rows: list[tuple[tuple[bytes, ...], int]]) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(rows), pa.string())]
    for k in range(LONGEST):
        values = [w[k] if k < len(w) else b"" for w, _ in rows]
        columns.append(pa.array(values, pa.binary()).cast(pa.string()))
    columns.append(pa.array([n for _, n in rows], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, ["lang", "w1", "w2", "w3", "w4", "n"])


def runs(texts: DataFrame, places: Places, held: int = HELD, burst: int = BURST) -> DataFrame:
    """Windows of every task with their counts, leaving its trie in sorted runs."""
    shared = texts.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries, totals = Words(), {}, Counter()

        def leave(lang: str, firsts: list[int]) -> Iterator[pa.RecordBatch]:
            """Subtrees as one sorted run, in batches of bounded size."""
            names, rows = words.names, []
            for first in sorted(firsts, key=names.__getitem__):
                found = [(tuple(names[w] for w in window), n) for window, n in tries[lang].subtree(first)]
                rows += sorted(found) if len(found) > 1 else found
                if len(rows) >= _ROWS:
                    yield _run_batch(lang, rows)
                    rows = []
            if rows:
                yield _run_batch(lang, rows)

        for batch in sliced(batches):
            for lang, stretch in _stretches(batch):
                text = Text(lang, stretch)
                (_, known), (_, pairs), (_, triples) = shared.value.candidates(text)
                totals[lang] += len(known)
                numbers = np.zeros(len(known), np.int64)
                numbers[known] = np.fromiter(map(words.__getitem__, text.words(known)), np.int64, int(known.sum()))
                trie = tries.setdefault(lang, Trie(burst))
                trie.single.update(Counter(numbers[known & ~pairs].tolist()))
                for window, n in _windows(numbers, pairs, triples):
                    trie.add(window, n)
            while sum(t.entries() for t in tries.values()) > held:
                lang = max(tries, key=lambda x: tries[x].entries())
                total = tries[lang].entries()
                yield from leave(lang, tries[lang].largest(max(1, total // 2)))
            if len(words) > KNOWN:
                for lang in tries:
                    yield from leave(lang, tries[lang].largest(tries[lang].entries()))
                words, tries = Words(), {}
        for lang in tries:
            yield from leave(lang, tries[lang].largest(tries[lang].entries()))
        # A window without words tells how many there were in all.
        for lang, n in totals.items():
            yield _run_batch(lang, [((), n)])

    return texts.mapInArrow(run, _RUN)


def merged(found: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``n`` of all prefixes of the windows in the runs, and,
    as phrases of no word, the words counted in all.

    A partition holds whole prefixes of three words and more; these are reported if they
    are frequent. Sums of shorter ones may be spread over partitions and are partial.
    """
    split = F.pmod(F.xxhash64("w3"), F.lit(SPLIT))
    sorted_runs = found.repartition("lang", "w1", "w2", split).sortWithinPartitions("lang", "w1", "w2", "w3", "w4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []
        sums: list[int] = []
        out: list[tuple[str, str, int, int]] = []

        def close(depth: int) -> None:
            """Report the levels that the stream has left, deepest first."""
            while len(path) > depth:
                words, n = len(path) - 1, sums.pop()
                if words and (words < 3 or n >= least):
                    out.append((path[0], " ".join(path[1:]), words, n))
                path.pop()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "phrase", "words", "n"]
            )

        for batch in sliced(batches):
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            # The same window of several runs stands together.
            for window, same in groupby(rows, key=lambda r: r[:5]):
                n, here = sum(r[5] for r in same), [w for i, w in enumerate(window) if w or i == 0]
                if len(here) == 1:
                    out.append((here[0], "", 0, n))
                    continue
                depth = next((i for i, (a, b) in enumerate(zip(path, here, strict=False)) if a != b), min(len(path), len(here)))
                close(depth)
                for word in here[depth:]:
                    path.append(word)
                    sums.append(0)
                for i in range(len(here)):
                    sums[i] += n
            yield made()
        close(0)
        yield made()

    return sorted_runs.mapInArrow(run, "lang string, phrase string, words int, n bigint")


def counts(docs: DataFrame, least: int = LEAST, held: int = HELD, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (``lang``, ``phrase``, ``words``, ``a``) and words per language (``lang``, ``n``)."""
    texts, size = _sized(docs)
    places = frequent_places(texts, size, least)
    partial = stored(merged(runs(texts, places, held, burst), least), "phrases")
    whole = partial.filter("words > 0").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    total = partial.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return stored(whole, "frequent"), total


def scored(frequent: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates with the weakest cut: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``score``.

    Of cuts with equal scores the one with fewest words in front counts.
    """
    cuts = frequent.filter("words >= 2").withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumns(
        {"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")}
    )
    part = lambda name, n: frequent.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = attach(cuts, part("left", "l"), ["lang", "left"], F.col("phrase"))
    cuts = attach(cuts, part("right", "r"), ["lang", "right"], F.col("phrase"))
    value = F.expr(f"cast(cast(a as decimal(20, 0)) * {SCALE} as decimal(38, 0)) div (cast(l as decimal(20, 0)) + r)")
    weakest = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("cut"))
    inner = frequent.filter("words >= 3").select(
        "lang", "a", F.split("phrase", " ").alias("_w"), F.explode(F.expr("sequence(2, words - 1)")).alias("_k"), "words"
    )
    inner = inner.withColumn("_s", F.explode(F.expr("sequence(1, words - _k + 1)")))
    around = inner.groupBy("lang", F.array_join(F.slice("_w", F.col("_s"), F.col("_k")), " ").alias("phrase")).agg(
        F.max("a").alias("_around")
    )
    kept = weakest.join(around, ["lang", "phrase"], "left").filter(
        F.col("_around").isNull()
        | (F.col("_around").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share)
    )
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score"))


def ranked(candidates: DataFrame, most: int = REPORT) -> DataFrame:
    """The first ones per language by score, then occurrences (both descending), then phrase.

    Each language is ranked in sixteen parts first, so that few rows of each meet.
    """
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("rank") <= most
    )
    parts = best(candidates.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPLIT))), "lang", "_part")
    return best(parts.drop("_part"), "lang")


def collocations(
    docs: DataFrame, least: int = LEAST, share: int = SHARE, most: int = REPORT, held: int = HELD, burst: int = BURST
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the report."""
    frequent, total = counts(docs, least, held, burst)
    best = ranked(scored(frequent, share), most)
    # One row per language on one side, the report on the other.
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
