"""The corpus pipeline against plain versions of its stages."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from loomframe.llm import bpe
from tests.llm.test_corpus import _plain
from tests.llm.test_search import _shingles

FOLDER = "/root/testdata/sf0.01"


def _first_of_class(texts: dict[int, str]) -> set[int]:
    """Smallest ids of the classes of similar texts, by comparing all that share a shingle."""
    bags = {i: b for i, t in texts.items() if (b := _shingles(t))}
    holders, parent = defaultdict(list), {i: i for i in texts}
    for i, bag in bags.items():
        for shingle in bag:
            holders[shingle].append(i)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in {(min(a, b), max(a, b)) for ids in holders.values() for a in ids for b in ids if a != b}:
        both = sum((bags[i] & bags[j]).values())
        if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def _masked(text: str) -> str:
    spans = sorted((int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in _plain(text)))
    out, place = "", 0
    for start, end, label in spans:
        if start >= place:
            out += text[place:start] + label
        place = max(place, end)
    return out + text[place:]


def _copies(rows) -> Counter:
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows}
    total: dict[str, int] = defaultdict(int)
    for r in rows:
        total[r.source] += size[r.doc_id]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    left, target, free = 1.5 * sum(total.values()), {}, set(total)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        target |= {s: 2.0 * total[s] if s in over else level * weight[s] for s in over or free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in rows:
        rate = target[r.source] / total[r.source]
        unit = int(hashlib.md5(f"0:{r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        taken[r.doc_id] = int(rate) + (unit < rate - int(rate))
    return +taken


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    known = [r.doc_id for r in kept["toxicity"] if r.doc_id in labels]
    # The small table has some forty toxic rows to learn four languages from.
    assert sum(labels[i] for i in known) <= 0.5 * sum(labels.values())
    assert sum(1 - labels[i] for i in known) >= 0.98 * sum(1 - x for x in labels.values())
    before = {r.doc_id: r.text for r in kept["toxicity"]}
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(_first_of_class(before))
    assert {r.doc_id: r.text for r in kept["personal_data"]} == {
        r.doc_id: _masked(r.text) for r in kept["near_duplicates"]
    }
    assert Counter(r.doc_id for r in kept["mixing"]) == _copies(kept["personal_data"])
    codec = bpe.encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    by_id = {r.doc_id: r.text for r in kept["mixing"]}
    assert len(kept["encoding"]) == len(kept["mixing"])
    for r in kept["encoding"]:
        text = by_id[r.doc_id].encode()
        assert codec.decode(bytes(r.ids)) == text and r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_stages_with_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _copies string"
    rows = [(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "x"), (2, "mail a@b.cc now", None, None, 15, "x")]
    given = spark.createDataFrame(rows + rows[2:], schema)
    for docs in (given, given.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.count() <= 2 * docs.count(), name
    masked = corpus_pipeline.mask_personal_data(spark, given, FOLDER).filter(F.col("doc_id") == 2).first()
    assert masked.text == "mail [EMAIL] now" and masked.n_chars == 16
