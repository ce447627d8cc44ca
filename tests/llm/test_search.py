"""Near duplicates and exact search against brute force."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from loomframe.llm import near_text, near_vectors, topk
from loomframe.llm.components import components


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(50))
    assert got[301] == got[300] == 300 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Texts


def _shingles(text):
    words = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", text.lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def _similar(a, b):
    a, b = _shingles(a), _shingles(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_estimate_weighted_similarity():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    for base in ([draw.choice(words) for _ in range(300)], ["a", "b", "c"] * 40, [draw.choice(words) for _ in range(9)]):
        for share in (0, 0.02, 0.1):
            texts = [" ".join(base), " ".join(draw.choice(words) if draw.random() < share else w for w in base)]
            a, b = near_text.signatures(texts)
            assert (a == b).mean() == pytest.approx(_similar(*texts), abs=0.17)


def test_words_do_not_depend_on_cuts(monkeypatch):
    text = "Ab, cd-ef! ünï 日本 " + "x" * 5000 + " end"
    plain, counts = near_text.word_hashes([text, "", "cd", "..."])
    monkeypatch.setattr(near_text, "_SPAN", 64)
    cut, again = near_text.word_hashes([text, "", "cd", "..."])
    assert counts.tolist() == again.tolist() == [7, 0, 1, 0]
    assert plain[1] == plain[7] and (plain[:5] == cut[:5]).all() and plain[6] == cut[6]


def _family(draw, words, size, count):
    base = [draw.choice(words) for _ in range(size)]
    out = [" ".join(base)]
    for _ in range(count):
        copy = list(base)
        copy[draw.randrange(size)] = draw.choice(words)
        out.append(" ".join(copy))
    return out


def test_classes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_text, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_text, "BLOCK", 8)
    draw = random.Random(7)
    words = [f"w{i}" for i in range(800)]
    texts = _family(draw, words, 120, 30) + _family(draw, words, 40, 5)
    # A chain: neighbours are similar, the ends are not.
    chain = [draw.choice(words) for _ in range(100)]
    for i in range(0, 24, 3):
        chain = list(chain)
        chain[4 * i : 4 * i + 2] = ["new", f"n{i}"]
        texts.append(" ".join(chain))
    texts += [" ".join(draw.choice(words) for _ in range(60)) for _ in range(20)]
    texts += [texts[0], texts[0].upper() + "!", "one two", "One, two.", "", None, None, " \n", "... !!!", "... !!!"]
    rows = [(i + 10, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[0], "x"), (None, "alone here in this text", "x")], "doc_id int, text string, node string")
    got = near_text.near_duplicates(docs).collect()
    assert len(got) == len(rows) + 2
    parent = {i: i for i, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a, _ in rows:
        for j, b, _ in rows:
            alike = a and b and _shingles(a) and _shingles(b) and _similar(a, b) >= 0.8
            # Without words only exact copies are alike.
            if i < j and (alike or (a is not None and a == b)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    class_of = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert class_of == {i: find(i) for i in parent}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    assert sorted((r.class_id is None) for r in got if r.doc_id is None) == [False, True]
    kept = near_text.deduplicate(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in parent if find(i) == i)
    assert near_text.deduplicate(docs).columns == docs.columns


def _unicode_words(text):
    """Words character by character, without the tables of the operator."""
    words, open_word = [], False
    for c in text.lower():
        name, kind = unicodedata.name(c, ""), unicodedata.category(c)[0]
        alone = kind == "L" and name.startswith(("CJK", "HIRAGANA", "KATAKANA", "THAI"))
        if kind == "M" and words and open_word:
            words[-1] += c
        elif kind in "LMN":
            joins = open_word == "run" and not alone
            words[-1:] = [words[-1] + c] if joins else [*words[-1:], c]
            open_word = "alone" if alone else "run"
        else:
            open_word = False
    return words


def _unicode_shingles(text):
    words = _unicode_words(text)
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


SCRIPTS = {
    "chinese": ([chr(0x4E00 + i) for i in range(900)], "", "\u3002"),
    "japanese": ([chr(0x3042 + i) for i in range(60)] + [chr(0x5000 + i) for i in range(300)], "", "\uff0c"),
    "thai": ([chr(0xE01 + i) + m for i in range(40) for m in ("", "\u0e34", "\u0e48")], "", "\u3000"),
    "no-break": ([f"w\u00e9{i}" for i in range(800)], "\u00a0", "\u2014"),
}


def test_words_by_unicode_class(monkeypatch):
    text = "Ab\u3002\u65e5\u672cx\u00e9\uff0c\u0e01\u0e34\u0e02 e\u0301a\u00a0\u201cq\u201d\u2014\u30ab\u30fc12"
    want = _unicode_words(text)
    assert want == ["ab", "日", "本", "xé", "\u0e01\u0e34", "\u0e02", "e\u0301a", "q", "カ", "ー", "12"]
    assert near_text.spaced(text).lower().split() == want
    for span in (1, 2, 3, 5):
        monkeypatch.setattr(near_text, "_SPAN", span)
        assert near_text.spaced(text).lower().split() == want
    assert near_text.spaced("a-b, c") == "a-b, c"


def test_near_copies_without_ascii_separators(spark):
    draw = random.Random(13)
    texts = []
    for letters, between, stop in SCRIPTS.values():
        for _ in range(3):
            base = [draw.choice(letters) for _ in range(200)]
            base[60] = base[120] = stop
            copy = list(base)
            copy[draw.randrange(20, 50)] = draw.choice(letters)
            texts += [between.join(base), between.join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sets = [_unicode_shingles(t) for t in texts]
    want = {}
    for i, a in enumerate(sets):
        alike = [j for j, b in enumerate(sets) if sum((a & b).values()) >= 0.8 * sum((a | b).values())]
        want[i] = min(alike)
    assert all(want[i] == i - i % 2 for i in want)
    assert {r.doc_id: r.class_id for r in near_text.near_duplicates(docs).collect()} == want


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(4, "some words in a row")] * 3 + [(4, "")] * 2, "doc_id int, text string")
    assert sorted((r.doc_id, r.text) for r in near_text.deduplicate(docs).collect()) == [(4, ""), (4, "some words in a row")]
    nulls = spark.createDataFrame([(1, None), (2, None), (3, ""), (4, "...")], "doc_id int, text string")
    assert near_text.deduplicate(nulls).count() == 4
    assert near_text.near_duplicates(docs.limit(0)).count() == 0
    assert near_text.deduplicate(docs.limit(0)).count() == 0


def test_rest_of_large_buckets_is_compared(spark, monkeypatch):
    monkeypatch.setattr(near_text, "BLOCK", 4)
    draw = random.Random(9)
    words = [f"w{i}" for i in range(900)]
    one, two = _family(draw, words, 90, 12), _family(draw, words, 90, 12)
    docs = spark.createDataFrame(list(enumerate(one + two)), "doc_id int, text string")
    known = near_text.nodes(docs)
    # One bucket with all texts, and links that leave every text alone.
    placed = near_text.stored(known.selectExpr("1 AS bucket", "node", "26L AS members", "0L AS hub"), "t")
    found = known.selectExpr("node", "node AS component")
    links = near_text._left_over(placed, found, known, docs, 0.8)
    groups = components(links).groupBy("component").count().collect()
    assert sorted(r["count"] for r in groups) == [13, 13]


# Vectors


def _vector_rows():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base[i] + 0.08 * rng.standard_normal((12, 16)) for i in range(6)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (902, [2 * x for x in rows[4][1]])]
    odd = [(910, None), (911, []), (912, [0.0] * 16), (913, [1.0, None] + [0.0] * 14), (914, [float("nan")] * 16)]
    return rows, [*odd, (915, [float("inf")] * 16), (916, [1.0]), (917, [3.0]), (918, [1e300] * 16), (919, [1e-300] * 16)]


@pytest.mark.parametrize(("cell", "large"), [(1024, 4096), (8, 4096), (1024, 16)])
def test_near_vectors_equal_brute_force(spark, monkeypatch, cell, large):
    monkeypatch.setattr(near_vectors, "LARGE", large)
    rows, odd = _vector_rows()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, node string")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df, cell=cell).collect()}
    m = np.array([v for _, v in rows])
    u = m / np.sqrt((m**2).sum(1, keepdims=True))
    link = u @ u.T >= 0.95 - 1e-12
    np.fill_diagonal(link, False)
    ids = [i for i, _ in rows]
    least = np.array(ids)
    for _ in range(len(ids)):
        least = np.array([min([least[i], *least[link[i]]]) for i in range(len(ids))])
    for i, name in enumerate(ids):
        assert (got[name].n_links, got[name].component_id) == (link[i].sum(), least[i])
    for name, _ in odd[:6]:
        assert got[name].n_links == 0 and got[name].kept
    assert got[917].component_id == 916 and got[919].component_id == 918
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_without_an_id(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(df).collect())
    assert got == [("5", 1, "5", True), ("None", 0, "None", True), ("None", 1, "5", False)]


def test_plan_reaches_the_recall():
    for n in (10, 5_000, 10**6, 10**9):
        bits, tables = near_vectors.plan(n)
        together = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - together) ** tables >= near_vectors.RECALL - 1e-9
        assert n / 2**bits <= near_vectors.CELL


# Search


@pytest.mark.parametrize("shard_rows", [8192, 60])
def test_top_k_is_exact(spark, shard_rows):
    rng = np.random.default_rng(11)
    v = np.round(rng.standard_normal((400, 6)), 1)
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in r], "x") for i, r in enumerate(v)]
    odd = [(800, None, "x"), (820, [None] * 6, "x"), (840, [float("nan")] * 6, "x"), (None, [9.0] * 6, "x"), (20, rows[20][1], "x"), (860, [5.0], "x"), (880, [], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label string")
    whole = topk.stored(topk.quantised(df, "embedding"), "t")
    got = topk.search(whole.filter("vec_id % 20 = 0"), whole, 20, shard_rows).collect()
    q = np.floor(v * 64).astype(int)
    # The repeated row is a query and a candidate of its own.
    q, ids = np.concatenate([q, q[20:21]]), [*range(400), 20]
    want = []
    for i in [*range(0, 400, 20), 400]:
        score = q @ q[i]
        order = sorted((j for j in range(401) if j != i), key=lambda j: (-score[j], ids[j]))[:20]
        want += [(ids[i], rank + 1, ids[j], int(score[j])) for rank, j in enumerate(order)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_top_k_with_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [0.0, -1.0])], "vec_id long, embedding array<float>")
    whole = topk.stored(topk.quantised(df, "embedding"), "t")
    got = sorted(tuple(r) for r in topk.search(whole.filter("vec_id % 20 = 0"), whole).collect())
    assert got == [(0, 1, 20, 20480), (0, 2, 3, -8192), (20, 1, 0, 20480), (20, 2, 3, -8192)]
    assert topk.search(whole.limit(0), whole.limit(0)).count() == 0


def test_deduplicate_keeps_any_column_name(spark):
    rows = [(i, "some words in a row that repeat", "a", "b", "c") for i in range(3)] + [(9, "--", "d", "e", "f"), (8, "--", "g", "h", "i")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _digest string, _first string, _copied string")
    got = near_text.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[0], rows[4]])
