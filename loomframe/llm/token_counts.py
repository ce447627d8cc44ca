"""Token counts with a compiled finite-state transducer.

The tokenizer is compiled into a deterministic transducer over characters whose transitions
carry the number of tokens that become certain. It has two layers. The outer one follows
the word pattern (letters, digits, other signs, white space, contractions) and knows where
a piece ends. The inner one counts the BPE tokens of the open piece: a token sequence is
the BPE encoding exactly if each adjacent pair of tokens encodes to itself, so it is enough
to know, for each place where a token of the vocabulary could still be under way, the last
token before it and the tokens counted up to it. Both are made state by state on demand,
as the full machine is far larger than the part that texts visit, and forgotten when the
tables reach a bound.

A text is cut into chunks. A chunk's map tells the tokens counted and the state at its end
for each state at its start: wherever white space follows another character the machine is
in a known state, so a map is a head that depends on the start, a count and an end. Maps
are composed pairwise by a prefix scan. No row is shuffled.

Edge cases: a null text is empty and has no tokens; strings of special tokens inside a text
count as that one token, as the tokenizer's library does by default; other columns, null
ids and repeated rows pass through; columns named like a new one are replaced.
"""

from __future__ import annotations

import gc
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import by_place, map_batches

CHUNK = 1 << 14
#: Chunks composed at once.
GROUP = 64
#: Transitions and states a worker remembers before it starts afresh, at the next group of chunks.
REMEMBERED = 1_200_000

_LETTER, _DIGIT, _SIGN, _SPACE = "LNPW"
# Endings of contractions that are pieces of their own after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_CLASS = regex.compile(r"(\p{L})|(\p{N})|(\s)|(.)", regex.DOTALL)


@lru_cache(maxsize=1 << 16)
def _kind(char: str) -> str:
    return (_LETTER, _DIGIT, _SPACE, _SIGN)[_CLASS.match(char).lastindex - 1]


def _byte_letters() -> dict[str, int]:
    """The published byte alphabet: printable Latin-1 stands for itself, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merges of a byte-level BPE file, and the plain encoding of short bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        special = set(self.specials)
        self.token_of = {to_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        # Rank by pair of tokens; for each token made by a merge its rank and its halves.
        self.rank: dict[tuple[int, int], int] = {}
        self.made_at: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(to_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            key, joined = (self.token_of[a], self.token_of[b]), self.token_of[a + b]
            self.rank.setdefault(key, rank)
            if joined not in self.halves:
                self.made_at[joined], self.halves[joined] = rank, key
        # Trie over bytes: children by node * 256 + byte, token by node, nodes with children.
        self.child: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.inner = {0}
        nodes = 1
        for token, number in self.token_of.items():
            node = 0
            for b in token:
                below = self.child.get(node << 8 | b)
                if below is None:
                    below = self.child[node << 8 | b] = nodes
                    nodes += 1
                self.inner.add(node)
                node = below
            self.token_at[node] = number

    def encode(self, data: bytes) -> list[int]:
        """Merge the leftmost pair of least rank again and again; for a token or two."""
        ids = [self.token_of[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            found = [(r, i) for i, p in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(p)) is not None]
            if not found:
                break
            _, i = min(found)
            ids[i : i + 2] = [self.token_of[self.bytes_of[ids[i]] + self.bytes_of[ids[i + 1]]]]
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the bytes of tokens a and b together are encoded as just these two.

        Merges inside of a and b are undone, latest first, down the sides that touch. They
        stay apart unless the touching pair would have been merged before the merges
        undone so far. Of merges of one rank the left one comes first.
        """
        made_at, halves, rank = self.made_at, self.halves, self.rank
        before = len(made_at) + 1
        left, right = made_at.get(a, -1), made_at.get(b, -1)
        while True:
            if rank.get((a, b), before) < before:
                return False
            if left > right:
                before, a = left, halves[a][1]
                left = made_at.get(a, -1)
            elif right >= 0:
                before, b = right + 1, halves[b][0]
                right = made_at.get(b, -1)
            else:
                return True


class _Bpe(dict):
    """Inner state: (trie node, last token before, tokens so far less the least) per open start.

    By byte: the next inner state and the tokens that have become certain.
    """

    __slots__ = ("final", "key", "machine")

    def __init__(self, machine: Transducer, key: tuple):
        super().__init__()
        self.machine, self.key = machine, key
        self.final = key[-1][2]

    def __missing__(self, byte: int) -> tuple[_Bpe, int]:
        machine = self.machine
        child, tokens, inner = machine.merges.child, machine.merges.token_at, machine.merges.inner
        last = count = None
        open_starts = []
        least = 1 << 30
        for node, before, so_far in self.key:
            below = child.get(node << 8 | byte)
            if below is None:
                continue
            if last is None:
                token = tokens.get(below)
                if token is not None and machine.adjacent(before, token):
                    last, count = token, so_far + 1
            if below in inner:
                open_starts.append((below, before, so_far))
                if so_far < least:
                    least = so_far
        if count < least:
            least = count
        open_starts.append((0, last, count))
        key = tuple([(n, t, c - least) for n, t, c in open_starts]) if least else tuple(open_starts)
        self[byte] = out = machine.inner_state(key), least
        return out


class State(dict):
    """Outer state; by character: the next state and the tokens that have become certain."""

    __slots__ = ("bpe", "machine", "mode", "pending")

    def __init__(self, machine: Transducer, mode: str, bpe: _Bpe, pending: str):
        super().__init__()
        self.machine, self.mode, self.bpe, self.pending = machine, mode, bpe, pending

    def __missing__(self, char: str) -> tuple[State, int]:
        self[char] = out = self.machine.step(self, char)
        self.machine.made += 1
        return out


class Transducer:
    """States of both layers, made when first reached.

    Modes: empty between pieces, L, N and P inside a run of letters, digits or signs, W in
    white space whose last character may belong to the next piece, and Q after an
    apostrophe that may begin a contraction.
    """

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.forget()

    def forget(self) -> None:
        self.made = 0
        self._inner: dict[tuple, _Bpe] = {}
        self._outer: dict[tuple, State] = {}
        self._first: dict[int, bool] = {}
        self.empty = self.inner_state(((0, None, 0),))
        self.start = self.state("", self.empty, "")

    def anew(self, state: State) -> State:
        """Forget all states; the given one is made again from what it stands for."""
        mode, key, pending = state.mode, state.bpe.key, state.pending
        self.forget()
        return self.state(mode, self.inner_state(key), pending)

    def inner_state(self, key: tuple) -> _Bpe:
        found = self._inner.get(key)
        if found is None:
            found = self._inner[key] = _Bpe(self, key)
            self.made += 1
        return found

    def state(self, mode: str, bpe: _Bpe, pending: str) -> State:
        # Inner states are unique while they are remembered, so they stand for their keys.
        key = mode, id(bpe), pending
        found = self._outer.get(key)
        if found is None:
            found = self._outer[key] = State(self, mode, bpe, pending)
            self.made += 1
        return found

    def adjacent(self, a: int | None, b: int) -> bool:
        """Whether token b can follow token a (or begin a piece)."""
        if a is not None:
            return self.merges.stay_apart(a, b)
        found = self._first.get(b)
        if found is None:
            found = self._first[b] = self.merges.encode(self.merges.bytes_of[b]) == [b]
        return found

    def feed(self, bpe: _Bpe, text: str) -> tuple[_Bpe, int]:
        count = 0
        for byte in text.encode():
            bpe, more = bpe[byte]
            count += more
        return bpe, count

    def close(self, state: State) -> int:
        """Tokens still uncounted if the text ends in this state."""
        if state.mode == "W":
            bpe, count = self.feed(state.bpe, state.pending)
            return count + bpe.final
        if state.mode == "Q":
            return sum(self._whole(x) for x in (state.pending[:1], state.pending[1:]) if x)
        return state.bpe.final

    def _whole(self, piece: str) -> int:
        bpe, count = self.feed(self.empty, piece)
        return count + bpe.final

    def _open(self, char: str, prefix: str = "") -> tuple[State, int]:
        """Begin a piece with ``char``, after a space that belongs to it."""
        kind = _kind(char)
        if kind == _SPACE:
            return self.state("W", self.empty, char), 0
        if char == "'" and not prefix:
            return self.state("Q", self.empty, "'"), 0
        bpe, count = self.feed(self.empty, prefix + char)
        return self.state(kind, bpe, ""), count

    def step(self, state: State, char: str) -> tuple[State, int]:
        mode, kind = state.mode, _kind(char)
        if mode == kind and mode != _SPACE:
            bpe, count = state.bpe, 0
            for byte in char.encode():
                bpe, more = bpe[byte]
                count += more
            return self.state(mode, bpe, ""), count
        if mode == "W":
            if kind == _SPACE:
                bpe, count = self.feed(state.bpe, state.pending)
                return self.state("W", bpe, char), count
            # The run ends before its last character, which a space gives to the next piece.
            count = state.bpe.final
            if state.pending == " ":
                after, more = self._open(char, " ")
            else:
                after, more = self._open(char)
                count += self._whole(state.pending)
            return after, count + more
        if mode == "Q":
            seen = state.pending[1:] + char
            if seen in _ENDINGS:
                return self.start, self._whole("'" + seen)
            if any(e.startswith(seen) for e in _ENDINGS):
                return self.state("Q", self.empty, "'" + seen), 0
            # No contraction: the apostrophe begins a run of signs, and letters follow it.
            if len(state.pending) == 1 and kind == _SIGN:
                bpe, count = self.feed(self.empty, "'" + char)
                return self.state(_SIGN, bpe, ""), count
            count = self._whole("'")
            after = self.start
            for c in seen:
                after, more = after[c]
                count += more
            return after, count
        after, more = self._open(char)
        return after, state.bpe.final + more

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for char in text:
            state, more = state[char]
            count += more
        return state, count

    def known(self, space: str) -> State:
        """The state after any character that is no white space and then ``space``."""
        return self.state("W", self.empty, space)


_SURE = regex.compile(r"\S(\s)")


class Map:
    """What a chunk does to any state at its start.

    ``head`` is read from the start state; if ``end`` is set, it leads to the known state
    from which ``count`` more tokens lead to ``end``; else the head is the whole chunk.
    """

    __slots__ = ("count", "end", "head")

    def __init__(self, head: str, count: int, end: State | None):
        self.head, self.count, self.end = head, count, end

    @classmethod
    def of(cls, machine: Transducer, chunk: str) -> Map:
        sure = _SURE.search(chunk)
        if sure is None:
            return cls(chunk, 0, None)
        end, count = machine.run(machine.known(sure[1]), chunk[sure.end() :])
        return cls(chunk[: sure.end()], count, end)

    def apply(self, machine: Transducer, state: State) -> tuple[State, int]:
        after, count = machine.run(state, self.head)
        return (after, count) if self.end is None else (self.end, count + self.count)

    def then(self, machine: Transducer, other: Map) -> Map:
        """This map and then the other one, as one map."""
        if self.end is None:
            return Map(self.head + other.head, other.count, other.end)
        end, count = other.apply(machine, self.end)
        return Map(self.head, self.count + count, end)


def scan(machine: Transducer, maps: list[Map]) -> list[Map]:
    """Inclusive prefix compositions: pairs first, then the pairs' scan, then the odd ones."""
    if len(maps) < 2:
        return maps
    pairs = [maps[i].then(machine, maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
    inner = scan(machine, pairs)
    out = [maps[0]]
    for i in range(1, len(maps)):
        out.append(inner[i // 2] if i % 2 else inner[i // 2 - 1].then(machine, maps[i]))
    return out


class Counter:
    """Counts tokens of whole texts."""

    def __init__(self, path: str, chunk: int = CHUNK):
        self.machine, self.chunk = Transducer(path), chunk

    def section(self, text: str) -> int:
        machine = self.machine
        if len(text) <= self.chunk:
            self.bounded(machine.start)
            state, count = machine.run(machine.start, text)
            return count + machine.close(state)
        state, count = machine.start, 0
        # Chunks are composed in groups, and between groups the memory is looked at.
        for start in range(0, len(text), self.chunk * GROUP):
            state = self.bounded(state)
            ends = range(start, min(len(text), start + self.chunk * GROUP), self.chunk)
            maps = [Map.of(machine, text[i : i + self.chunk]) for i in ends]
            state, more = scan(machine, maps)[-1].apply(machine, state)
            count += more
        return count + machine.close(state)

    def bounded(self, state: State) -> State:
        """The same state, among no more remembered ones than allowed."""
        if self.machine.made <= REMEMBERED:
            return state
        state = self.machine.anew(state)
        gc.collect()
        return state

    def count(self, text: str) -> int:
        sections = [text]
        for special in self.machine.merges.specials:
            sections = [x for s in sections for x in s.split(special)]
        return sum(map(self.section, sections)) + len(sections) - 1


@lru_cache(maxsize=4)
def counter(path: str, chunk: int = CHUNK) -> Counter:
    """One counter per worker and vocabulary."""
    return Counter(path, chunk)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", limit: int = 1024, chunk: int = CHUNK
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more tokens than ``limit``)."""
    new = ("n_bytes", "n_tokens", "over_limit")
    kept = [c for c in df.columns if c not in new]
    given = by_place(df, kept, F.col(f"`{text}`"))
    names = [*given.columns[: len(kept)], "n0", "n1", "n2"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(len(kept)).to_pylist()]
        # States refer to each other and live long; looking for dead ones among them over
        # and over takes longer than the counting. They are collected when forgotten.
        gc.disable()
        try:
            counts = [counter(path, chunk).count(t) for t in texts]
        finally:
            gc.enable()
        made = [
            pa.array([len(t.encode()) for t in texts], pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([n > limit for n in counts], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names)

    types = [*[f.dataType.simpleString() for f in given.schema.fields][: len(kept)], "bigint", "bigint", "boolean"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return map_batches(given, run, schema).toDF(*kept, *new)
