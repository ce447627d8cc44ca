"""Edit logs against plain loops, with chunks of a few rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from loomframe.operators import edits, graphs


@pytest.mark.parametrize("chunk", [1, 3, 50])
def test_history_in_chunks(spark, chunk):
    rng = random.Random(11)
    rows, want = [], {}
    for project in range(3):
        undo, redo, current = [], [], None
        for seq in range(1, 121):
            op = rng.choices(["execute", "undo", "redo"], [3, 4, 3])[0]
            rev = f"{project}-{seq}" if op == "execute" else None
            rows.append((project, seq, op, rev))
            valid = True
            if op == "execute":
                undo.append(current)
                current, redo = rev, []
            elif op == "undo" and undo:
                redo.append(current)
                current = undo.pop()
            elif op == "redo" and redo:
                undo.append(current)
                current = redo.pop()
            else:
                valid = False
            want[project, seq] = (valid, len(undo), current)
    log = spark.createDataFrame(rows, "project_id INT, seq BIGINT, op STRING, revision_id STRING")
    done = edits.fold_history(log, chunk).collect()
    assert {(r.project_id, r.seq): (r.valid, r.depth, r.current_id) for r in done} == want


LAYER_LOG = (
    "project_id INT, seq BIGINT, command STRING, layer_id STRING, new_layer_id STRING, "
    "source_id STRING, opacity DOUBLE, visible BOOLEAN, blend_mode STRING, mask STRING, "
    "from_pos INT, to_pos INT, layers ARRAY<STRUCT<layer_id: STRING, source_id: STRING, "
    "opacity: DOUBLE, visible: BOOLEAN, blend_mode: STRING, mask: STRING>>"
)


def command(seq, name, **args):
    row = dict.fromkeys(
        "layer_id new_layer_id source_id opacity visible blend_mode mask from_pos to_pos layers".split()
    )
    return {"project_id": 1, "seq": seq, "command": name, **row, **args}


def test_layer_commands(spark):
    new = dict(source_id="s", opacity=1.0, visible=True, blend_mode="normal")
    mask_a, mask_b = '{"mask_id":"m","source_asset_id":"q","opacity":1}', '{"mask_id":"z"}'
    whole = [("x", "s", 1.0, True, "screen", None), ("y", "s", 0.5, False, "normal", None)]
    twice = [whole[0], whole[0]]
    log = [
        (command(1, "add", layer_id="a", **new), None, "a"),
        (command(2, "add", layer_id="a", **new), "duplicate_layer", "a"),
        (command(3, "add", layer_id="b", **{**new, "opacity": 1.5}), "invalid_layer", "a"),
        (command(4, "add", layer_id="b", **new), None, "a,b"),
        (command(5, "duplicate", layer_id="a", new_layer_id="c"), None, "a,c,b"),
        (command(6, "reorder", from_pos=0, to_pos=2), None, "c,b,a"),
        (command(7, "reorder", from_pos=0, to_pos=3), "index", "c,b,a"),
        (command(8, "remove", layer_id="q"), "unknown_layer", "c,b,a"),
        (command(9, "remove", layer_id="b"), None, "c,a"),
        (command(10, "opacity", layer_id="c", opacity=0.25), None, "c,a"),
        (command(11, "update_mask", layer_id="c", mask=mask_a), "no_mask", "c,a"),
        (command(12, "set_mask", layer_id="c", mask=mask_a), None, "c,a"),
        (command(13, "update_mask", layer_id="c", mask=mask_b), "mask_identity", "c,a"),
        (command(14, "blend", layer_id="c", blend_mode="add"), "invalid_value", "c,a"),
        (command(15, "visibility", layer_id="a", visible=False), None, "c,a"),
        (command(16, "replace", layers=twice), "invalid_stack", "c,a"),
        (command(17, "replace", layers=whole), None, "x,y"),
        (command(18, "remove", layer_id="c"), "unknown_layer", "x,y"),
        (command(19, "duplicate", layer_id="y", new_layer_id="y2"), None, "x,y,y2"),
    ]
    rows = spark.createDataFrame([c for c, _, _ in log], LAYER_LOG)
    done = edits.fold_layers(rows).orderBy("seq").collect()
    assert [(r.error, ",".join(v.layer_id for v in r.stack)) for r in done] == [
        (error, stack) for _, error, stack in log
    ]
    assert [r.revision for r in done][-1] == sum(e is None for _, e, _ in log)
    by_id = {v.layer_id: v for v in done[14].stack}
    assert by_id["c"].opacity == 0.25 and by_id["c"].mask == mask_a and not by_id["a"].visible
    assert by_id["c"].source_id == "s"


def test_random_layer_logs(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for project in range(4):
        stack = []
        for seq in range(1, 80):
            kind = rng.choice(["add", "remove", "reorder", "duplicate", "replace"])
            name, other = rng.choice("abcde"), rng.choice("vwxyz")
            source, target = rng.randrange(5), rng.randrange(5)
            fresh = [("a", "s", 1.0, True, "normal", None), (name, "s", 1.0, True, "normal", None)]
            rows.append(
                {
                    **command(
                        seq, kind, layer_id=name, new_layer_id=other, source_id="s", opacity=1.0,
                        visible=True, blend_mode="normal", from_pos=source, to_pos=target, layers=fresh,
                    ),
                    "project_id": project,
                }
            )
            if kind == "add" and name not in stack:
                stack = [*stack, name]
            elif kind == "remove":
                stack = [v for v in stack if v != name]
            elif kind == "reorder" and max(source, target) < len(stack):
                rest = stack[:source] + stack[source + 1 :]
                stack = [*rest[:target], stack[source], *rest[target:]]
            elif kind == "duplicate" and name in stack and other not in stack:
                at = stack.index(name) + 1
                stack = [*stack[:at], other, *stack[at:]]
            elif kind == "replace" and name != "a":
                stack = ["a", name]
            want[project, seq] = stack
    done = edits.fold_layers(spark.createDataFrame(rows, LAYER_LOG)).collect()
    assert {(r.project_id, r.seq): [v.layer_id for v in r.stack] for r in done} == want


def test_transforms_refuse_sums_out_of_bounds(spark):
    schema = (
        "project_id INT, seq BIGINT, command STRING, crop ARRAY<INT>, scale DOUBLE, "
        "degrees DOUBLE, dx DOUBLE, dy DOUBLE"
    )
    rows = [
        (1, 1, "rotate", None, None, 300.0, None, None),
        (1, 2, "rotate", None, None, 100.0, None, None),
        (1, 3, "rotate", None, None, -350.0, None, None),
        (1, 4, "crop", [0, 0, 321, 1], None, None, None, None),
        (1, 5, "scale", None, 2.0, None, None, None),
        (2, 1, "translate", None, None, None, 300.0, 10.0),
        (2, 2, "translate", None, None, None, 20.0, 5.0),
    ]
    done = edits.fold_transforms(spark.createDataFrame(rows, schema))
    got = {(r.project_id, r.seq): r for r in done.collect()}
    assert got[1, 2].error == "rotation_range" and got[1, 2].rotation == 300.0
    assert got[1, 3].error is None and got[1, 3].rotation == -50.0
    assert got[1, 4].error == "invalid_arguments" and got[1, 4].crop == [0, 0, 320, 320]
    assert got[1, 5].scale == 2.0
    assert (got[2, 2].x, got[2, 2].y, got[2, 2].error) == (320.0, 15.0, None)


def test_replay_stops_at_the_first_failure(spark):
    rows = [(1, i, i in (2, 3)) for i in range(5)] + [(2, i, False) for i in range(3)]
    ops = spark.createDataFrame(rows, "workflow_id INT, idx BIGINT, failed BOOLEAN")
    got = {r.workflow_id: (r.failed_at, r.committed) for r in edits.replay_summary(ops).collect()}
    assert got == {1: (2, 2), 2: (None, 3)}


def chain(spark, n, project=1):
    return [(project, i, None if i == 0 else i - 1) for i in range(n)]


REVS = "project_id INT, revision_id INT, parent_id INT"


def test_deep_chain_and_cycle(spark):
    rows = chain(spark, 300) + [(2, 1, 2), (2, 2, 1), (2, 3, 1), (3, 1, 9)]
    revs = spark.createDataFrame(rows, REVS)
    got = {(r.project_id, r.revision_id): (r.depth, r.ending) for r in graphs.depths(revs).collect()}
    assert got[1, 299] == (299, "root") and got[2, 3] == (None, "cycle")
    assert got[3, 1] == (0, "orphan")
    pairs = spark.createDataFrame(
        [(1, 250, 3), (1, 3, 250), (1, 7, 7), (2, 1, 2)],
        "project_id INT, revision_id INT, ancestor_id INT",
    )
    found = graphs.is_ancestor(revs, pairs).collect()
    assert sorted((r.project_id, r.revision_id, r.is_ancestor) for r in found) == [
        (1, 3, False), (1, 7, True), (1, 250, True), (2, 1, False),
    ]


def test_ancestry_of_a_chain(spark):
    revs = spark.createDataFrame(chain(spark, 40), REVS)
    rows = graphs.ancestry(revs).collect()
    assert len(rows) == 40 * 41 // 2
    assert all(r.distance == r.revision_id - r.ancestor_id for r in rows)


def test_dag_rules(spark):
    nodes = spark.createDataFrame(
        [(1, "a", 0, False), (1, "b", 1, False), (2, "a", 0, False), (2, "b", 1, True), (2, "c", 2, False)],
        "graph_id INT, name STRING, position INT, masked BOOLEAN",
    )
    edges = spark.createDataFrame(
        [(1, "a", "b"), (1, "b", "a"), (2, "b", "a"), (2, "c", "zz")],
        "graph_id INT, name STRING, dependency STRING",
    )
    levels, broken = graphs.dag_audit(nodes, edges)
    got = {(r.graph_id, r.name): r.level for r in levels.collect()}
    assert got == {(1, "a"): None, (1, "b"): None, (2, "a"): 0, (2, "b"): 1, (2, "c"): None}
    rules = sorted((r.graph_id, r.rule, r.n) for r in broken.collect())
    assert rules == [
        (1, "terminal_count", 0), (1, "unordered", 2), (2, "missing_dependency", 1),
        (2, "terminal_count", 2), (2, "unordered", 1),
    ]


@pytest.mark.parametrize(
    "nodes",
    [
        [("a", ("b",)), ("b", ("a",)), ("c", ("a",))],
        [("a", ()), ("b", ())],
        [("a", ("a",))],
        [("a", ("q",))],
    ],
)
def test_run_dag_refuses_broken_graphs(spark, nodes):
    df = spark.range(1)
    with pytest.raises(ValueError):
        graphs.run_dag(df, [(n, lambda *d: d[0], needs) for n, needs in nodes])


def test_stack_limit(spark):
    from loomframe.operators import pixels

    with pytest.raises(ValueError):
        pixels.effect_stack(spark.range(1), [lambda d: d] * 33)
    assert pixels.effect_stack(spark.range(3), [lambda d: d.filter(F.col("id") > 0)] * 2).count() == 2


def test_sums_that_touch_a_bound_are_folded(spark):
    draw = random.Random(1)
    while True:
        # The last two rows lie in another block than the first.
        a, b = draw.uniform(100, 200), draw.uniform(50, 100)
        c = 360.0 - (a + b)
        c += draw.randint(0, 4) * 1.5e-14
        if a + (b + c) <= 360.0 < (a + b) + c:
            break
    schema = (
        "project_id INT, seq BIGINT, command STRING, crop ARRAY<INT>, scale DOUBLE, "
        "degrees DOUBLE, dx DOUBLE, dy DOUBLE"
    )
    turns = [(1, 1, a), (1, 100_000, b), (1, 100_001, c)]
    rows = [(p, i, "rotate", None, None, d, None, None) for p, i, d in turns]
    done = edits.fold_transforms(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [r.error for r in done] == [None, None, "rotation_range"]
