"""Document rules, identities, file scans and sinks."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.functions import documents as docs
from loomframe.operators import documents as rules
from loomframe.sources import documents as scans
from loomframe.sources.files import header_budget, scan_gif_files
from loomframe.sources.frames import map_frames


def column(spark, values, name="document"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"no INT, {name} STRING")


def results(df, name):
    return [r[name] for r in df.orderBy("no").collect()]


def test_json_depth(spark):
    texts = ["{}", '{"a":[1,{"b":"]]}}"}]}', '"[[["', "]", '["\\"[", []]', "[" * 129 + "]" * 129, '["\\\\", [']
    df = column(spark, texts).withColumn("d", docs.json_depth(F.col("document")))
    assert results(df, "d") == [1, 3, 0, -1, 2, 129, 2]
    bounds = df.withColumn("b", docs.json_bounds(F.col("document")))
    assert results(bounds, "b") == [None, None, None, "brackets", None, "depth", None]
    small = df.withColumn("b", docs.json_bounds(F.col("document"), max_bytes=10))
    assert results(small, "b")[1] == "bytes"


def test_one_object_and_nothing_else(spark):
    texts = ['{"a":"}{"} ', "{}{", "{} {}", "{}x", "[{}]", '{"a":1', "{}", None, '{"a":[{}]}']
    df = column(spark, texts).withColumn("ok", docs.is_json_object(F.col("document")))
    assert results(df, "ok") == [True, False, False, False, False, False, True, False, True]


def test_canonical_json(spark):
    texts = ['{"b": 1.50, "a": [ "é\\u00e9", true ]}', '{"a":1,"a":1}', "[NaN]", "{", '["\\ud800"]', '{"a":1}']
    df = column(spark, texts).select(
        "no",
        docs.canonical_json("document").alias("c"),
        docs.json_violation("document").alias("v"),
        docs.is_canonical(F.col("document")).alias("is"),
    )
    assert results(df, "c")[0] == '{"a":["éé",true],"b":1.5}'
    assert results(df, "v") == [None, "duplicate_key", "not_finite", "malformed", "surrogate", None]
    assert results(df, "is") == [False, False, False, False, False, True]


def test_json_text_escapes(spark):
    texts = ['a"b\\c', "tab\tline\nbell\x07 \x1f é 😀", "literal \\u000B", "plain"]
    df = column(spark, texts).withColumn("t", docs.json_text(F.col("document")))
    assert results(df, "t") == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_revision_ids_do_not_depend_on_key_order(spark):
    metas = ['{"a": 1, "b": {"y": 2, "x": [1]}}', '{"b": {"x": [1], "y": 2}, "a": 1}']
    state = '{"name":"line\\n\\"q\\""}'
    df = column(spark, metas).withColumn(
        "id",
        docs.revision_id(docs.canonical_json("document"), F.lit(None).cast("string"), F.lit(state)),
    )
    envelope = {"parent_id": None, "state": state, "command_metadata": json.loads(metas[0])}
    text = json.dumps(envelope, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert results(df, "id") == [hashlib.sha256(text.encode()).hexdigest()] * 2


def test_artifact_ids_are_name_based_uuids(spark):
    job = "0f8fad5b-d9cb-469f-a165-70867728950e"
    paths = ["/data/a.gif", 'sp"é\\x.gif']
    df = column(spark, paths).withColumn(
        "id", docs.artifact_id(F.lit(job), F.lit("gif"), F.col("document"))
    )
    space = uuid.UUID(docs.ARTIFACT_NAMESPACE)
    names = [json.dumps([job, "gif", p], ensure_ascii=False, separators=(",", ":")) for p in paths]
    assert results(df, "id") == [str(uuid.uuid5(space, n)) for n in names]


def test_colors_and_ids(spark):
    texts = ["#abc", "#ABCDEF", "#abcd", "abc", "#abc\n", "f" * 64, "F" * 64, "f" * 64 + "\n"]
    df = column(spark, texts).select(
        "no", docs.is_hex_color(F.col("document")).alias("c"), docs.is_revision_id(F.col("document")).alias("r")
    )
    assert results(df, "c") == [True, True, False, False, False, False, False, False]
    assert results(df, "r") == [False] * 5 + [True, False, False]


def test_invalid_utf8(spark):
    df = spark.createDataFrame([(0, b"\xc3\xa9"), (1, b"\xc3"), (2, b"\xed\xa0\x80")], "no INT, b BINARY")
    assert results(df.withColumn("ok", docs.utf8_ok(F.col("b"))), "ok") == [True, False, False]


@pytest.mark.parametrize(
    "document, broken",
    [
        ("{}", []),
        ('{"schema_version":2,"motion":{"style":"pan","amount":24}}', []),
        ('{"schema_version":4}', ["schema_version"]),
        ('{"canvas":{"width":320}}', ["canvas"]),
        ('{"crop":{"focus":{"x":1.5,"y":"a"}}}', ["focus_x", "focus_y"]),
        ('{"layers":[{"type":"accent","thickness":21},{"color":"#12"}]}', ["layer_type", "layer_color", "layer_thickness"]),
        ('{"text":{"content":"%s","size":9,"color":"red"}}' % ("x" * 161), ["text_content", "text_size", "text_color"]),
        ('{"typography":{"style":"3d","material":"wood","depth":17}}', ["typography_material", "typography_depth"]),
        ('{"other":1}', ["unknown_key"]),
        ("[1]", ["malformed"]),
        ("{", ["malformed"]),
    ],
)
def test_spec_rules(spark, document, broken):
    assert results(rules.spec_violations(column(spark, [document])), "violations") == [broken]


def test_migration_fills_defaults(spark):
    texts = ['{"schema_version":1,"frame":{"radius":3}}', '{"schema_version":9}', "nope"]
    df = rules.migrate_specs(column(spark, texts))
    assert results(df, "reason") == [None, "schema_version", "malformed"]
    done = json.loads(results(df, "migrated")[0])
    assert done["schema_version"] == 3 and done["frame"] == {"radius": 3} and done["text"] is None
    assert done["crop"]["focus"] == {"x": 0.5, "y": 0.5}
    assert list(done) == sorted(done)


def test_settings_rules(spark):
    texts = ["{}", '{"fps":0,"max_duration_seconds":6.01,"max_bytes":2400001}', '{"fps":true}', '{"x":1}']
    got = results(rules.settings_violations(column(spark, texts)), "violations")
    assert got == [[], ["fps", "max_duration_seconds", "max_bytes"], ["fps"], ["unknown_key"]]


def test_probe_fallbacks(spark):
    probes = [
        '{"streams":[{"codec_type":"audio"},{"codec_type":"video","width":3,"height":4,"nb_frames":"7","r_frame_rate":"25/1","duration":"2.5"}]}',
        '{"streams":[],"format":{"duration":"1"}}',
        '{"streams":[{"codec_type":"video","nb_read_frames":"0","nb_frames":"5","avg_frame_rate":"","r_frame_rate":"1/0"}],"format":{"duration":"0"}}',
    ]
    df = column(spark, probes).select("no", docs.probe_fields(F.col("document")).alias("f"))
    a, b, c = results(df, "f")
    assert (a.width, a.height, a.frames, a.fps, a.duration_s) == (3, 4, 7, 25.0, 2.5)
    assert not b.has_video and b.frames == 0
    assert (c.frames, c.fps, c.duration_s, c.width) == (5, 0.0, 0.0, 0)


def test_presets(spark):
    requests = spark.createDataFrame(
        [(0, " Royal ", {"frame": {"color": "#000"}, "motion": {"style": "pan"}}), (1, "no", None), (2, "neon", {"sound": {"a": "b"}})],
        "request_id INT, preset STRING, overrides MAP<STRING, MAP<STRING, STRING>>",
    )
    rows = rules.resolve_presets(requests).collect()
    fields = {r.section: r.fields for r in rows if r.request_id == 0}
    assert fields["frame"] == {"style": "royal", "color": "#000", "secondary": "#fff0a6"}
    assert fields["motion"] == {"style": "pan"} and set(fields) == {"background", "frame", "typography", "motion"}
    assert {r.request_id: r.reason for r in rows if r.request_id} == {1: "unknown_preset", 2: "unknown_section"}


def test_capabilities_against_a_table(spark):
    catalogue = spark.createDataFrame(
        [("crop", "available", 2, "a", "b"), ("style", "planned", 1, "a", "b")],
        "capability_id STRING, state STRING, version INT, input_domain STRING, output_domain STRING",
    )
    ops = spark.createDataFrame(
        [("crop", 2, "a", "b"), ("crop", 1, "a", "b"), ("crop", 2, "x", "b"), ("style", 1, "a", "b"), ("q", 1, "a", "b")],
        "capability_id STRING, capability_version INT, input_domain STRING, output_domain STRING",
    )
    got = sorted((r.reason or "") for r in rules.check_against(ops, catalogue).collect())
    assert got == ["", "input_domain", "planned", "unknown_capability", "version"]


def test_revision_documents_become_rows(spark, tmp_path):
    revs = [
        {"revision_id": "b", "parent_id": "a", "state": "{}", "command_metadata": {"k": [1]}},
        {"revision_id": "a", "parent_id": None, "state": "{}", "command_metadata": {}},
    ]
    doc = json.dumps({"schema_version": 1, "root_revision_id": "a", "current_revision_id": "b", "revisions": revs})
    (tmp_path / "good.json").write_text(doc)
    (tmp_path / "bad.json").write_bytes(b"\xff")
    (tmp_path / "old.json").write_text(doc.replace('"schema_version": 1', '"schema_version": 2'))
    rows = scans.read_document_files(spark, str(tmp_path), "revisions").collect()
    good = sorted((r.idx, r.revision_id, r.parent_id, r.command_metadata) for r in rows if r.reason is None)
    assert good == [(0, "b", "a", '{"k":[1]}'), (1, "a", None, "{}")]
    assert sorted(r.reason for r in rows if r.reason) == ["utf8", "version"]


def test_gif_scan(spark, tmp_path):
    head = b"GIF89a" + (320).to_bytes(2, "little") + (7).to_bytes(2, "little") + b"\0\0\0"
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.gif").write_bytes(head + b"rest")
    (tmp_path / "sub" / "short.gif").write_bytes(head[:9])
    (tmp_path / "big.gif").write_bytes(head + b"x" * 1000)
    (tmp_path / "note.txt").write_bytes(head)
    facts = scan_gif_files(spark, str(tmp_path), max_bytes=500)
    got = {r.path.rsplit("/", 1)[1]: r for r in header_budget(facts, 319, 500).collect()}
    assert set(got) == {"a.gif", "short.gif"}
    assert (got["a.gif"].canvas_width, got["a.gif"].canvas_height) == (320, 7)
    assert got["a.gif"].sha256 == hashlib.sha256(head + b"rest").hexdigest()
    assert got["a.gif"].reason == "canvas_limit" and got["short.gif"].reason == "header"


def test_reports_are_sorted_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, None, "x"), (1, 0.5, "y")], "b INT, a DOUBLE, day STRING")
    scans.write_reports(df, str(tmp_path / "r"), "day")
    back = {r.day: r.value for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert back == {"x": '{"a":null,"b":2}', "y": '{"a":0.5,"b":1}'}


def test_map_frames(spark):
    frames = spark.createDataFrame([(1, [1, 2]), (2, [3])], "clip_id INT, rgba ARRAY<INT>")
    doubled = map_frames(frames, lambda p: p.assign(rgba=[np.asarray(v) * 2 for v in p["rgba"]]))
    assert sorted(r.rgba for r in doubled.collect()) == [[2, 4], [6]]


def test_number_texts_equal_the_shortest_form(spark):
    import random
    import struct

    draw = random.Random(5)
    values = [draw.uniform(-1, 1) * 10 ** draw.randint(-9, 15) for _ in range(3000)]
    values += [round(draw.uniform(-1000, 1000), k) for k in range(12) for _ in range(100)]
    values += [struct.unpack("d", struct.pack("Q", draw.getrandbits(64)))[0] for _ in range(2000)]
    values += [0.0, -0.0, 1e16, 1e-4, 1e-5, 5e-324, 9999999999999998.0, 123456789.0, 1e22, *map(float, range(-50, 50))]
    rows = [(v,) for v in values if v == v and abs(v) != float("inf")]
    got = spark.createDataFrame(rows, "x double").select("x", docs.number_text(F.col("x")).alias("s")).collect()
    assert all(float(r.s) == r.x for r in got)
    assert all(r.s == repr(r.x) for r in got if r.x == 0 or 1e-10 <= abs(r.x) < 1e16)
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.s for r in odd.select(docs.number_text(F.col("x")).alias("s")).collect()] == [None] * 3


def test_typed_values_as_canonical_documents(spark):
    schema = (
        "b struct<z: int, a: array<struct<y: double, x: string>>>, a map<string, array<bigint>>, "
        "c boolean, d string, e double, f map<string, struct<q: int, p: string>>, g array<array<double>>"
    )
    rows = [
        ((1, [(1.5, 'q"\\é\n'), (1e-7, None), (None, "")]), {"k2": [1, 2], "k1": [], "é": None}, True, "\x01", 1e20, {"m": (1, "\t")}, [[0.1, 2.0], []]),
        ((None, None), None, None, None, None, None, None),
        ((0, [(0.1, "a")]), {}, False, "", -0.0, {}, []),
    ]
    df = spark.createDataFrame(rows, schema)
    whole = F.struct(*[F.col(c) for c in df.columns])
    kind = df.select(whole.alias("w")).schema["w"].dataType
    got = [r.s for r in df.select(docs.canonical_text(whole, kind).alias("s")).collect()]
    plain = lambda r: json.dumps(r.asDict(recursive=True), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert got == [plain(r) for r in df.collect()]
    spoilt = spark.createDataFrame([([1.0, float("nan")],)], "v array<double>")
    value = spoilt.select(docs.canonical_text(F.col("v"), spoilt.schema["v"].dataType).alias("s")).first().s
    assert value is None


def test_content_ids_along_the_graph(spark):
    import hashlib

    from loomframe.operators import graphs

    def make(parent, state, meta):
        envelope = {"parent_id": parent, "state": json.dumps(state, ensure_ascii=False, sort_keys=True, separators=(",", ":")), "command_metadata": meta}
        text = json.dumps(envelope, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(text.encode()).hexdigest()

    rows, ids = [], []
    for i in range(40):
        parent = ids[(i - 1) // 2] if i else None
        ids.append(make(parent, {"b": i, "a": "é"}, {"n": i}))
        state = json.dumps({"a": "é", "b": i + (i == 4)}, ensure_ascii=i % 2 == 0)
        rows.append((1, ids[i], parent, state, "{broken" if i == 5 else json.dumps({"n": i})))
    rows.append((1, "loop", "loop", "{}", "{}"))
    schema = "project_id int, revision_id string, parent_id string, state string, command_metadata string"
    got = {r.revision_id: r.verdict for r in graphs.hash_audit(spark.createDataFrame(rows, schema)).collect()}
    up = lambda i: [] if i == 0 else [(i - 1) // 2, *up((i - 1) // 2)]
    for i in range(40):
        want = {4: "wrong_id", 5: "malformed"}.get(i, "behind_wrong_id" if {4, 5} & set(up(i)) else "ok")
        assert got[ids[i]] == want, i
    assert got["loop"] == "cycle"
