"""Unknown facts, mistyped parts, odd frames and long chains."""

from __future__ import annotations

import pytest

from loomframe.operators import blending, clips, documents, geometry, graphs, quality, tracks
from loomframe.sources.documents import read_documents


def test_unknown_facts_fail_the_gates(spark):
    row = spark.sql(
        """SELECT CAST(NULL AS BOOLEAN) AS exists, CAST(NULL AS BIGINT) AS size_bytes,
           CAST(NULL AS STRING) AS probe_error, CAST(NULL AS BOOLEAN) AS has_video,
           320 AS width, 320 AS height, '30/1' AS rate, 6.0D AS duration_s, 5 AS frames"""
    )
    got = quality.quality_gate(row).first()
    assert (got.valid, got.checks) == (False, ["missing"])
    there = row.selectExpr("true AS exists", "* EXCEPT (exists)")
    assert quality.quality_gate(there).first().checks == ["size"]
    limits = spark.sql("SELECT CAST(NULL AS INT) AS width, 10 AS height, 1.0D AS duration_s")
    assert quality.limit_verdict(limits).first().verdict == "resolution"
    probe = spark.sql(
        """SELECT 1 AS artifact_id, true AS signature_ok, 5L AS size_bytes, 320 AS width, 320 AS height,
           CAST(NULL AS INT) AS frames, '30/1' AS rate, CAST(NULL AS DOUBLE) AS duration_s"""
    )
    analysis = spark.sql(
        """SELECT 1 AS artifact_id, 320 AS width, 320 AS height, 5L AS frame_count,
           30.0D AS effective_fps, 6000L AS total_ms, 3L AS max_palette_colors"""
    )
    got = quality.validate_artifacts(probe, analysis, quality.OutputSpec()).first()
    assert (got.valid, got.failed) == (False, ["frames", "frame_count", "duration"])
    media = spark.sql("SELECT true AS exists, CAST(NULL AS BIGINT) AS size_bytes, '{}' AS probe")
    assert documents.preflight(media).first().reason == "empty"


@pytest.mark.parametrize(
    "text", ['{"schema_version":2,"text":"hello"}', '{"canvas":[1]}', '{"layers":{}}', '{"layers":[1]}', '{"crop":{"focus":3}}']
)
def test_mistyped_sections_are_reported(spark, text):
    docs = spark.createDataFrame([(text,)], "document string")
    assert "section_type" in documents.spec_violations(docs).first().violations
    got = documents.migrate_specs(docs).first()
    assert (got.reason, got.migrated) == ("section_type", None)


def test_numbers_that_equal_the_canvas_are_accepted(spark):
    docs = spark.createDataFrame([('{"canvas":{"width":320.0,"height":320},"text":null}',)], "document string")
    assert documents.spec_violations(docs).first().violations == []


def test_documents_keep_their_own_ids(spark):
    rows = [
        ('{"contract_version":1,"id":"w1","operations":[{"capability_id":"crop","capability_version":"x"},7]}',),
        ('{"current_revision_id":"b","revisions":[{"revision_id":"a"}],"root_revision_id":"a","schema_version":1}',),
    ]
    docs = spark.createDataFrame(rows, "document string")
    work = read_documents(docs.limit(1), "workflow").collect()
    assert [(r.workflow_id, r.reason) for r in work] == [("w1", "item_fields")] * 2
    revs = read_documents(docs.filter("document LIKE '%root%'"), "revisions").first()
    assert (revs.root_revision_id, revs.current_revision_id, revs.reason) == ("a", "b", None)


def test_odd_frames_get_a_reason(spark):
    rows = [
        (1, 0, 1, 1, 100, [1, 2, 3, 255]),
        (1, 1, 2, 1, 100, [1, 2, 3, 255, 9, 9, 9, 255]),
        (2, 0, 1, 1, 100, [1, 2, 3, 255]),
        (2, 1, 1, 1, 100, None),
        (3, 0, 1, 1, 100, [0, 0, 0, 255]),
        (3, 1, 1, 1, 200, [255, 0, 0, 255]),
    ]
    frames = spark.createDataFrame(
        rows, "clip_id long, frame_idx int, width int, height int, duration_ms int, rgba array<int>"
    )
    motion = {(r.clip_id, r.frame_idx): (r.motion, r.reason) for r in clips.frame_motion(frames).collect()}
    assert motion == {(1, 1): (None, "frame_shape"), (2, 1): (None, "frame_shape"), (3, 1): (85.0, None)}
    sizes = {(r.clip_id, r.frame_idx): r.palette_colors for r in clips.palette_cardinality(frames).collect()}
    assert sizes[2, 1] is None and sizes[1, 1] == 2
    files = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "clip_id long, size_bytes long")
    got = {r.clip_id: r for r in clips.analyze_clips(frames, files).collect()}
    assert got[1].reason == got[2].reason == "frame_shape" and got[1].frame_motion is None
    assert got[3].frame_motion == [85.0] and got[3].frame_palette_colors == [1, 1]
    assert got[3].loop_count is None


def test_frames_without_partner_stay(spark):
    schema = "clip_id long, frame_idx int, width int, height int, rgba array<int>"
    one = spark.createDataFrame([(1, 0, 1, 1, [1, 2, 3, 4]), (1, 1, 2, 1, list(range(8)))], schema)
    two = spark.createDataFrame([(1, 0, 1, 1, [5, 6, 7, 8]), (1, 1, 1, 1, [9, 9, 9, 9]), (2, 0, 1, 1, [1, 1, 1, 1])], schema)
    got = blending.blend_u8(blending.align_frames(one, two), "add").collect()
    reasons = {(r.clip_id, r.frame_idx, r.y, r.x): r.reason for r in got}
    assert reasons == {(1, 0, 0, 0): None, (1, 1, 0, 0): None, (1, 1, 0, 1): "shape", (2, 0, 0, 0): "shape"}
    assert all((r.r is None) == (r.reason is not None) for r in got)


def test_long_chains_and_cycles_together(spark):
    chain = [(1, str(i), str(i - 1) if i else None) for i in range(70)]
    loop = [(1, "x", "z"), (1, "y", "x"), (1, "z", "y"), (1, "tail", "x"), (1, "lost", "nowhere")]
    revs = spark.createDataFrame([*chain, *loop], "project_id long, revision_id string, parent_id string")
    got = {r.revision_id: (r.depth, r.ending) for r in graphs.depths(revs).collect()}
    assert all(got[str(i)] == (i, "root") for i in range(70))
    assert all(got[n] == (None, "cycle") for n in ("x", "y", "z", "tail"))
    assert got["lost"] == (0, "orphan")


def test_amounts_outside_of_their_range_are_refused(spark):
    timed = spark.sql("SELECT 0.0D AS t, 1.0D AS duration_s, 1.0D AS free_x, 1.0D AS free_y")
    with pytest.raises(ValueError):
        tracks.motion_path(timed, "float", 25.0)
    with pytest.raises(ValueError):
        geometry.blur(timed, 33)


def test_frames_that_are_not_filled_become_null(spark):
    schema = "clip_id long, frame_idx int, width int, height int, rgba array<int>"
    rows = [(1, 0, 1, 1, [1, 2, 3, 4]), (1, 1, 2, 1, [1, 2, 3, 4]), (1, 2, 1, 1, None), (1, 3, None, 1, [1, 2, 3, 4])]
    got = geometry.blur(spark.createDataFrame(rows, schema), 3).orderBy("frame_idx").collect()
    assert [r.rgba for r in got] == [[1, 2, 3, 4], None, None, None]


def test_ancestors_of_given_nodes(spark):
    revs = spark.createDataFrame(
        [(1, str(i), str(i - 1) if i else None) for i in range(20)] + [(2, "a", None)],
        "project_id long, revision_id string, parent_id string",
    )
    asked = spark.createDataFrame([(1, "13"), (2, "a"), (2, "none")], "project_id long, revision_id string")
    got = {(r.project_id, r.revision_id, r.ancestor_id): r.distance for r in graphs.ancestry(revs, asked).collect()}
    assert got == {**{(1, "13", str(13 - d)): d for d in range(14)}, (2, "a", "a"): 0}


@pytest.mark.parametrize("odd", [[], [1, 2, 3], [1, 2, 3, 255, 4], None])
def test_broken_frames_do_not_end_the_job(spark, odd):
    schema = "clip_id long, frame_idx int, width int, height int, duration_ms int, rgba array<int>"
    rows = [(1, i, 1, 1, 100, odd) for i in range(2)] + [(2, i, 1, 1, 100, [i, 0, 0, 255]) for i in range(3)]
    frames = spark.createDataFrame(rows, schema)
    files = spark.createDataFrame([(1, 9), (2, 9)], "clip_id long, size_bytes long")
    report = {r.clip_id: r for r in clips.analyze_clips(frames, files).collect()}
    assert report[1].reason == "frame_shape" and report[1].motion_mean is None
    assert report[2].reason is None and report[2].frame_motion == [1 / 3, 1 / 3]
    motion = {(r.clip_id, r.frame_idx): (r.motion, r.reason) for r in clips.frame_motion(frames).collect()}
    assert motion[1, 1] == (None, "frame_shape") and motion[2, 1] == (1 / 3, None)
    ends = {r.clip_id: r.first_last_difference for r in clips.first_last_difference(frames).collect()}
    assert ends == {1: None, 2: 2 / 3}
    sizes = {r.clip_id: r.palette_colors for r in clips.palette_cardinality(frames).collect()}
    assert sizes == {1: None, 2: 1}


@pytest.mark.parametrize("places", [[254, 256, 258], [0, 255, 256], [3, 700, 1024], [255, 600], [10, 511, 512, 2000]])
def test_motion_over_gaps(spark, places):
    schema = "clip_id long, frame_idx int, width int, height int, duration_ms int, rgba array<int>"
    rows = [(1, i, 1, 1, 100, [i % 251, 0, 0, 255]) for i in places]
    got = {r.frame_idx: r.motion for r in clips.frame_motion(spark.createDataFrame(rows, schema)).collect()}
    want = {b: abs(b % 251 - a % 251) / 3 for a, b in zip(places, places[1:])}
    assert got == pytest.approx(want)


def test_unknown_sizes_break_the_decode_budget(spark):
    schema = "clip_id long, frame_idx int, width int, height int, duration_ms int, rgba array<int>"
    frames = spark.createDataFrame([(c, 0, 1, 1, 100, [0, 0, 0, 255]) for c in (1, 2)], schema)
    files = spark.createDataFrame([(1, None), (2, 9)], "clip_id long, size_bytes long")
    got = {r.clip_id: r.reason for r in clips.decode_budget(frames, files).collect()}
    assert got == {1: "empty_input", 2: None}


def test_shared_nodes_are_worked_out_once(spark):
    """The input of a diamond is read once, and so is a node with two dependants."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(100).withColumn("v", spark.range(1).selectExpr("1.0D AS v").first().v + graphs.F.col("id"))
    px = rows.mapInArrow(counted, rows.schema)
    join = lambda a, b: a.join(b.withColumnRenamed("v", "w"), "id").selectExpr("id", "v + w AS v")
    plus = lambda d: d.selectExpr("id", "v + 1 AS v")
    done = graphs.run_dag(
        px,
        [("left", plus, ()), ("right", plus, ()), ("both", join, ("left", "right")), ("a", plus, ("both",)), ("end", join, ("a", "both"))],
    )
    assert sorted(r.v for r in done.collect()) == [4.0 * (i + 2) + 1 for i in range(100)]
    assert seen.value == 100


def _graphs(seed):
    import random

    draw, nodes, edges = random.Random(seed), [], []
    for g in range(25):
        size = draw.randrange(1, 14)
        nodes += [(g, f"n{i:02d}") for i in range(size)]
        for _ in range(draw.randrange(0, 2 * size)):
            a, b = draw.randrange(size), draw.randrange(size + (g % 5 == 0))
            if g % 2 or a > b:
                edges.append((g, f"n{a:02d}", f"n{b:02d}"))
    return nodes, edges


def _reached(nodes, edges):
    """Plain closure: on a cycle is who reaches itself; levels by repeated passes."""
    needs = {}
    for g, a, b in edges:
        needs.setdefault((g, a), set()).add(b)
    known, cycles, levels = set(nodes), {}, {}
    for g, n in nodes:
        seen, todo = set(), [n]
        while todo:
            for b in needs.get((g, todo.pop()), ()):
                if b not in seen and (g, b) in known:
                    seen.add(b)
                    todo.append(b)
        needs["reach", g, n] = seen
    for g, n in nodes:
        both = {b for b in needs["reach", g, n] if n in needs["reach", g, b]}
        cycles[g, n] = min(both) if both else None
    moved = True
    while moved:
        moved = False
        for g, n in nodes:
            want = needs.get((g, n), set())
            if (g, n) not in levels and all((g, b) in levels for b in want):
                levels[g, n] = 1 + max((levels[g, b] for b in want), default=-1)
                moved = True
    return {k: (levels.get(k), cycles[k]) for k in nodes}


@pytest.mark.parametrize("small", [100_000, 12, 0])
def test_levels_and_cycles(spark, small):
    nodes, edges = _graphs(4)
    got = graphs.dag_order(
        spark.createDataFrame(nodes, "graph_id long, name string"),
        spark.createDataFrame(edges + edges[:5], "graph_id long, name string, dependency string"),
        small,
    )
    assert {(r.graph_id, r.name): (r.level, r.cycle) for r in got.collect()} == _reached(nodes, edges)


def test_a_long_chain_has_levels(spark):
    nodes = spark.range(10_000).selectExpr("1L AS graph_id", "id AS name", "id AS position", "false AS masked")
    edges = nodes.filter("name > 0").selectExpr("graph_id", "name", "name - 1 AS dependency")
    levels, _ = graphs.dag_audit(nodes, edges)
    assert levels.filter("level = name").count() == 10_000


def test_too_many_layers_have_a_reason(spark):
    rows = [(0, 0, 0, z, 0.5, 0.5, 0.5, 1.0) for z in range(300)] + [(0, 0, 1, z, 0.25, 0.5, 0.5, 1.0) for z in range(256)]
    layers = spark.createDataFrame(rows, "frame_idx int, y int, x int, z_index int, r double, g double, b double, a double")
    got = {r.x: (r.r, r.reason) for r in blending.composite(layers, report=True).collect()}
    assert got == {0: (None, "layer_limit"), 1: (0.25, None)}


def test_preset_lists_replace_as_a_whole(spark):
    schema = "request_id int, preset string, overrides map<string,map<string,string>>, layers array<map<string,string>>"
    rows = [(1, "neon", None, [{"type": "glow"}, {"type": "rect"}]), (2, "neon", {}, None), (3, "x", None, [{"type": "glow"}])]
    got = documents.resolve_presets(spark.createDataFrame(rows, schema)).collect()
    lists = {r.request_id: r["items"] for r in got if r.section == "layers"}
    assert lists == {1: [{"type": "glow"}, {"type": "rect"}]}
    assert [r.reason for r in got if r.request_id == 3] == ["unknown_preset"]
