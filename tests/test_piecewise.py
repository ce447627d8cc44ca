"""Effects of undo logs against plain replay."""

from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from loomframe.operators import edits
from loomframe.operators.piecewise import SAME, ZERO, Effect, Steps

OPS = ("execute", "undo", "redo")


def replay(ops, at, top):
    for op in ops:
        if op == "execute":
            at = top = at + 1
        elif op == "undo":
            at -= at > 0
        else:
            at += at < top
    return at, top


def effect(ops):
    made = Effect()
    for op in ops:
        made = made.run(op, 1)
    return made


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(OPS), max_size=40), st.integers(0, 40), st.data())
def test_effects_and_their_composition(ops, cut, data):
    cut = min(cut, len(ops))
    whole, parts = effect(ops), effect(ops[:cut]).then(effect(ops[cut:]))
    again = Effect.of(*parts.row())
    for top in (0, 1, 2, 3, 7, 12, 60):
        at = data.draw(st.integers(0, top))
        assert whole(at, top) == parts(at, top) == again(at, top) == replay(ops, at, top)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(OPS), st.integers(1, 9)), max_size=12), st.lists(st.tuples(st.sampled_from(OPS), st.integers(1, 9)), max_size=12))
def test_runs_equal_single_steps(first, second):
    def build(runs):
        made = Effect()
        for op, n in runs:
            made = made.run(op, n)
        return made

    ops = [op for op, n in [*first, *second] for _ in range(n)]
    both = build(first).then(build(second))
    for at, top in ((0, 0), (0, 5), (3, 3), (4, 30), (50, 50)):
        assert both(at, top) == replay(ops, at, top)


def test_steps_functions():
    f = Steps([(0, -3, 1)]).greater(ZERO)
    assert [f(x) for x in range(6)] == [0, 0, 0, 0, 1, 2]
    g = SAME.plus(2).smaller(Steps([(0, 4, 0)]))
    assert [g(x) for x in range(5)] == [2, 3, 4, 4, 4]
    assert [f.after(g)(x) for x in range(5)] == [f(g(x)) for x in range(5)]


def test_a_million_undos_stay_one_piece():
    """The effect of a long run has as many pieces as it has bends, not as many as undos."""
    made = Effect().run("execute", 1)
    for _ in range(1000):
        made = made.then(Effect().run("undo", 1000))
    assert len(made.depth.pieces) <= 2
    assert made(5, 5) == (0, 6) and made(2_000_000, 2_000_000) == (1_000_001, 2_000_001)


def test_one_long_log_over_many_chunks(spark):
    draw = random.Random(8)
    ops = [draw.choices(OPS, (5, 4, 3))[0] for _ in range(6_000)] + ["undo"] * 4_000 + ["redo"] * 3_000 + ["execute", "undo"] * 500
    rows = [("p", i, op, f"r{i}") for i, op in enumerate(ops)] + [("q", 5_000_000 + i, op, f"s{i}") for i, op in enumerate(OPS)]
    log = spark.createDataFrame(rows, "project_id string, seq long, op string, revision_id string")
    got = {(r.project_id, r.seq): (r.depth, r.valid, r.current_id) for r in edits.fold_history(log, chunk=16).collect()}
    for project in "pq":
        stack, at = [], 0
        for name, seq, op, revision in rows:
            if name != project:
                continue
            valid = True
            if op == "execute":
                stack, at = [*stack[:at], revision], at + 1
            elif op == "undo":
                valid, at = at > 0, max(0, at - 1)
            else:
                valid = at < len(stack)
                at += valid
            assert got[project, seq] == (at, valid, stack[at - 1] if at else None)
