"""The prefix trie against a plain trie, for whole and for cut parts, blocks and logs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from loomframe.llm import prefix_trie

SCHEMA = "conv_id bigint, turn int, role string, text string, key string, place int"


def _plain(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            given[conv].append((turn is not None, turn or 0, role, digest, text))
    turns = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in given.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(math.fmod(c, 100))
        built[c] = turns.get(family, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(convs) - 1) * (len(path[-1][1]) if path else 0)
    out = []
    for path, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(path))
        above = members[path[:-1]][0] if path else None
        out.append(
            (convs[0], len(path), above, len(convs), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def _got(spark, rows, **bounds):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = prefix_trie.prefix_trie(df, **bounds)
    assert found.columns == [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    ]
    return sorted((tuple(r) for r in found.collect()), key=str)


def _random_log(seed, convs, longest, words):
    draw = random.Random(seed)
    return [
        (c, t, draw.choice(["user", "assistant", None]) if draw.random() < 0.1 else "user", draw.choice(words))
        for c in convs
        for t in range(draw.randrange(1, longest))
    ]


@pytest.mark.parametrize(
    "bounds", [{}, {"block": 2, "part": 3, "fan": 2}, {"block": 3, "part": 1, "fan": 2}]
)
def test_equals_plain_trie(spark, bounds):
    convs = [*range(0, 40), *range(100, 130), 205, 999, -7, -250]
    rows = _random_log(3, convs, 9, ["a", "b", "", None, "\U0001f600b"])
    assert _got(spark, rows, **bounds) == _plain(rows)


def test_few_members_deep_paths(spark):
    """Long shared runs, one conversation being the beginning of another, exact copies."""
    rows = []
    for c, n in ((0, 30), (1, 30), (2, 17), (3, 16), (4, 1), (7, 25)):
        rows += [(c, t, "user", f"same {t}" if t < 20 else f"own {c % 2} {t}") for t in range(n)]
    want = _plain(rows)
    assert _got(spark, rows, block=4, part=2, fan=2) == want
    assert _got(spark, rows) == want


def test_nulls_ties_repeats_and_empty(spark):
    rows = [
        (0, None, None, None), (0, None, "user", "x"), (0, 1, "user", "x"), (0, 1, "user", "x"),
        (0, 1, "system", "y"), (None, 0, "user", "lost"), (1, 0, "user", "z" * 100_000), (101, 0, "user", "alone"),
        (103, 5, "user", ""), (105, 5, "user", ""),
    ]
    assert _got(spark, rows) == _plain(rows)
    assert _got(spark, [(None, 0, "user", "lost")]) == []
    one = [(0, 0, "user", "only")]
    assert _got(spark, one) == _plain(one)


def test_contraction_leaves_only_the_rims():
    """Of a part whose outer edges lie deep, few components are left open."""

    def item(place, left, right):
        return {
            "place": place, "key": None, "depth": 50, "chars": 50, "n": 1, "first": place, "leaves": 1, "saved": 0,
            "children": 0, "ends": place, "left_depth": left, "right_depth": right, "right_chars": right,
            "right_key": f"k{right}",
        }

    inner = [1] * 998
    depths = [9, *inner, 9]
    items = [item(i, depths[i], depths[i + 1]) for i in range(999)]
    left = [x for x in prefix_trie.contract(items) if x["open"]]
    assert [x["n"] for x in left] == [1, 997, 1]
