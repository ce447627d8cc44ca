"""Encoding and counting against the tokenizers' own libraries."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomframe.llm import bpe, token_counts

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
ENCODER = bpe.Encoder(RANKS, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})
LIBRARY = Tokenizer.from_file(JSON)
COUNTER, TINY = token_counts.Counter(JSON), token_counts.Counter(JSON, chunk=5)
TEXTS = st.text(alphabet="aebrstlvmd''  \n\t12!é-’日\x1c\x85\\|<>", max_size=60) | st.text(max_size=40)


def ids(text: str) -> list[int]:
    packed = ENCODER.encode(text)
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def counted(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_the_library(text):
    assert ids(text) == TIKTOKEN.encode_ordinary(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.booleans())
def test_counting_equals_the_library(text, special):
    text = text + "<|endoftext|>" + text[:3] if special else text
    assert COUNTER.count(text) == TINY.count(text) == counted(text)


def test_long_pieces():
    draw = random.Random(1)
    for text in ("".join(draw.choice("abcdefgh") for _ in range(50_000)), "a" * 30_000, " " * 30_000, "7" * 999):
        assert ids(text) == TIKTOKEN.encode_ordinary(text)
        assert COUNTER.count(text) == TINY.count(text) == counted(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    words = "the cat, the dog and the other cat's dogs; they're 12 in all".split(" ")
    for i in range(len(words)):
        text = " ".join(words[: i + 1])
        packed = bpe.Encoder(RANKS, P.PATTERN, remembered=6).encode(text + " " + text)
        assert packed == ENCODER.encode(text + " " + text)
        assert COUNTER.count(text) == counted(text)


def test_maps_compose_in_any_grouping():
    machine = COUNTER.machine
    text = "It's been\n\n  a while -- hasn't it?   Yes 1234 'really"
    for step in (1, 3, 7):
        chunks = [text[i : i + step] for i in range(0, len(text), step)]
        maps = [token_counts.Map.of(machine, c) for c in chunks]
        scanned = token_counts.scan(machine, maps)
        for i in range(len(chunks)):
            state, count = scanned[i].apply(machine, machine.start)
            whole, straight = machine.run(machine.start, "".join(chunks[: i + 1]))
            assert count + machine.close(state) == straight + machine.close(whole)


@pytest.fixture(scope="module")
def rows():
    texts = [None, "", "plain words", "plain words", "naïve 日本 \U0001f600", "x" * 20_000, "\n\n <|endoftext|>"]
    return [(None if i == 2 else i, t, "clash") for i, t in enumerate(texts)]


def test_round_trip_query(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, P.PATTERN, keep_ids=True).collect()}
    for doc_id, text, _ in rows:
        packed = struct.pack(f"<{len(TIKTOKEN.encode_ordinary(text or ''))}I", *TIKTOKEN.encode_ordinary(text or ""))
        row = got[doc_id]
        assert row.n_tokens == len(packed) // 4
        assert bytes(row.ids) == packed and row.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_encode_and_decode_apart(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string, extra string")
    back = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())


def test_count_query(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string, n_bytes string")
    got = token_counts.count_tokens(df, JSON, limit=2).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.n_bytes == len((row.text or "").encode())
        assert row.n_tokens == counted(row.text or "")
        assert row.over_limit == (row.n_tokens > 2)
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0


def test_one_long_text_within_the_bound(monkeypatch):
    """States are forgotten inside a text too, and the count goes on from the same state."""
    import random

    monkeypatch.setattr(token_counts, "REMEMBERED", 400)
    monkeypatch.setattr(token_counts, "GROUP", 3)
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghijkl'é 12,") for _ in range(draw.randrange(1, 9))) for _ in range(3000)]
    text = " ".join(words)
    counted, most = token_counts.Counter(JSON, chunk=20), 0
    forget, kept = counted.machine.forget, []
    monkeypatch.setattr(counted.machine, "forget", lambda: (kept.append(counted.machine.made), forget()))
    assert counted.count(text) == COUNTER.count(text)
    assert len(kept) > 20 and max(kept) < 20_000
