"""Phrase mining against a plain count, with tries that burst and leave early."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from loomframe.llm import common, phrases

FOLDER = "/root/testdata/sf0.01"
LOWER = {c: c + 32 for c in range(65, 91)}


def _plain(rows, least=30, most=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    frequent = {p: a for p, a in f.items() if len(p) >= 3 and a >= least}
    around = Counter()
    for (lang, *words), a in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, *words[i : i + k])
                around[inner] = max(around[inner], a)
    for (lang, *words), a in frequent.items():
        if 100 * around[(lang, *words)] >= 80 * a:
            continue
        score, _, l, r = min(
            (2_000_000 * a // (f[(lang, *words[:k])] + f[(lang, *words[k:])]), k, f[(lang, *words[:k])], f[(lang, *words[k:])])
            for k in range(1, len(words))
        )
        out.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out.sort()
    ranks, rows = Counter(), []
    for lang, score, a, phrase, l, r in out:
        ranks[lang] += 1
        if ranks[lang] <= most:
            rows.append((lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return rows


def _got(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, phrase string").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, **bounds).collect())


@pytest.fixture(scope="module")
def log():
    draw = random.Random(5)
    words = ["a", "B", "cc", "D\x01", "é", "É", "\U0001f600", "zz\x00", "　x"]
    texts = ["".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", ",\r", " ; "]) for _ in range(draw.randrange(0, 90))) for _ in range(150)]
    return [(draw.choice(["en", "de", None, "und"]), t) for t in texts] + [(None, None), ("fr", ""), ("fr", "...")]


def test_equals_plain_count(spark, log):
    assert _got(spark, log) == _plain(log)
    assert _got(spark, log, most=7) == _plain(log, most=7)


def test_bursting_and_leaving_change_nothing(spark, log, monkeypatch):
    want = _plain(log, least=5)
    assert len(want) > 100
    assert _got(spark, log, least=5, burst=2, held=40) == want


def test_hot_pair_long_words_and_repeats(spark):
    hot = [("en", " ".join(f"the one w{i % 45}" for i in range(400))), ("en", "lone " + "q" * 200_000)]
    rows = hot * 40 + [("en", "Aa aA " * 31)]
    assert _got(spark, rows) == _plain(rows)


@pytest.mark.parametrize("stretch", [1, 50])
def test_stretches_change_nothing(spark, log, monkeypatch, stretch):
    """Long texts are cut between pieces only."""
    monkeypatch.setattr(phrases, "STRETCH", stretch)
    texts = [(lang, text) for lang, text in log if text]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array([t.encode() for _, t in texts])], ["lang", "text"])
    cut = list(phrases._stretches(batch))
    assert len(cut) > 10
    words = [w for _, stretch in cut for w in stretch.split()]
    assert words == b"\n".join(t.encode() for _, t in texts).translate(phrases._BYTES).split()
    pairs = lambda parts: Counter(p for _, s in parts for line in s.split(b"\n") for p in zip(line.split(), line.split()[1:]))
    monkeypatch.setattr(phrases, "STRETCH", 1 << 30)
    assert pairs(cut) == pairs(phrases._stretches(batch))


def test_empty(spark):
    assert _got(spark, [(None, None)]) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(df).collect() == []


def test_trie_gives_back_all_windows():
    draw, trie, plain = random.Random(1), phrases.Trie(burst=3), Counter()
    for _ in range(3000):
        window = tuple(draw.randrange(2, 6) for _ in range(draw.randrange(1, 5)))
        trie.add(window, 2)
        plain[window] += 2
    assert trie.entries() == len(plain) == trie.sizes.total() + len(trie.single)
    assert any(not isinstance(node, phrases.Container) for node in trie.top.values())
    found = Counter()
    for first in trie.largest(10**9):
        found.update(dict(trie.subtree(first)))
    assert found == plain and not trie.entries() and not trie.sizes


def test_cut_windows_hold_all_frequent_phrases(spark):
    """The pair counts only ever cut windows at rare pairs."""
    docs = common.table(spark, FOLDER, "documents").select("lang", "text").limit(200)
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(tuple(r) for r in phrases.collocations(docs).collect()) == _plain(rows)
