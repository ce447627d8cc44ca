"""Registered document, file-header and probe queries and their cross-check SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import documents as docs
from loomframe.functions.numeric import parse_rate
from loomframe.operators import clips, pixels
from loomframe.operators import documents as rules
from loomframe.plans.common import six
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views
from loomframe.sources.documents import read_documents as read_docs
from loomframe.sources.files import gif_facts
from loomframe.sources.files import header_budget as budget
from loomframe.sources.frames import map_frames


def _joined(df: DataFrame, column: str = "violations") -> DataFrame:
    return df.withColumn(column, F.concat_ws(",", column))


def _pick(index: Column, *options: str | None) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def utf8_check(spark: SparkSession, folder: str) -> DataFrame:
    text = data.table(spark, folder, "documents")
    cut = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode("text", "UTF-8"), cut)
    return text.select("doc_id", docs.utf8_ok(raw).alias("ok"))


def json_bounds(spark: SparkSession, folder: str) -> DataFrame:
    n = (F.col("event_id") % 140).cast("int")
    wrapped = F.concat(F.repeat(F.lit('["[{"'), 1), F.lit(","), F.repeat(F.lit("["), n), "props")
    closed = F.concat(wrapped, F.repeat(F.lit("]"), n), F.lit("]"))
    closed = F.when(F.col("event_id") % 11 == 0, F.concat(closed, F.lit("]"))).otherwise(closed)
    e = data.table(spark, folder, "events").select("event_id", closed.alias("doc"))
    return e.select(
        "event_id",
        docs.json_depth(F.col("doc")).alias("depth"),
        docs.json_bounds(F.col("doc")).alias("reason"),
    )


def json_violations(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_id") % 6
    doc = F.when(kind == 0, F.col("props")).otherwise(
        _pick(
            kind,
            F.lit(""),
            F.concat(F.lit('{"k": '), "props", F.lit(', "k": 2}')),
            F.concat(F.lit('{"p": '), "props", F.lit(', "k": [1, NaN]}')),
            F.concat(F.lit('{"p": '), "props", F.lit(', "k": ')),
            F.concat(F.lit('{"p": '), "props", F.lit(', "k": "\\ud800"}')),
            F.concat(F.lit("[1, "), "props", F.lit(', {"a": null}]')),
        )
    )
    e = data.table(spark, folder, "events").select("event_id", doc.alias("doc"))
    return e.select("event_id", docs.json_violation("doc").alias("reason"))


def canonical_documents(spark: SparkSession, folder: str) -> DataFrame:
    doc = F.concat(
        F.lit('{"user": '),
        F.col("user_id").cast("string"),
        F.lit(', "é": "ü", "args": '),
        F.col("props"),
        F.lit(', "list": [ true , null ] }'),
    )
    e = data.table(spark, folder, "events").select("event_id", doc.alias("doc"))
    return e.select(
        "event_id",
        docs.canonical_json("doc").alias("canonical"),
        docs.is_canonical(F.col("doc")).alias("was_canonical"),
    )


def revision_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = data.table(spark, folder, "conversations")
    meta = F.concat(F.lit('{"role":"'), "role", F.lit('"}'))
    parent = F.when(F.col("turn") > 0, F.concat("conv_id", F.lit("-"), F.col("turn") - 1))
    return c.select(
        "conv_id", "turn", docs.revision_id(meta, parent, F.col("text")).alias("revision_id")
    )


def artifact_ids(spark: SparkSession, folder: str) -> DataFrame:
    a = data.artifacts(spark, folder)
    return a.select(
        "job_id",
        "type",
        "storage_path",
        docs.artifact_id(F.col("job_id").cast("string"), F.col("type"), F.col("storage_path")).alias(
            "artifact_id"
        ),
    )


def color_and_id_checks(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    color = F.concat(_pick(p % 4, "#", "#", "", "#G"), F.hex(p * 37 % 65536), F.lit(""))
    digest = F.sha2(F.col("p_name"), 256)
    rev = F.when(p % 3 == 0, F.upper(digest)).when(p % 3 == 1, F.concat(digest, F.lit("0")))
    return data.table(spark, folder, "part").select(
        "p_partkey",
        docs.is_hex_color(color).alias("is_color"),
        docs.is_revision_id(F.coalesce(rev, digest)).alias("is_revision"),
    )


def _spec(spark: SparkSession, folder: str) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    doc = F.concat(
        F.lit('{"schema_version":'),
        (p % 5).cast("string"),
        F.lit(',"canvas":{"width":320,"height":'),
        F.when(p % 9 == 0, "240").when(p % 2 == 0, "320.0").otherwise("320"),
        F.lit('},"background":{"color":"'),
        _pick(p % 3, "#111", "#11223", "#a1B2c3"),
        F.lit('"},"frame":{"radius":'),
        (size * 4).cast("string"),
        F.lit(',"shape":"'),
        _pick(p % 4, "circle", "rect", "star", "rounded"),
        F.lit('"},"layers":[{"type":"'),
        _pick(p % 4, "shape", "border", "accent", "glow"),
        F.lit('","opacity":'),
        (p % 13 / 10.0).cast("string"),
        F.lit('}],"typography":{"size":'),
        (size * 3).cast("string"),
        F.lit("}"),
        F.when(p % 10 == 0, ',"extra":1').otherwise(""),
        F.when(p % 19 == 0, ',"text":"hello"').when(p % 23 == 0, ',"crop":{"focus":[1]}').otherwise(""),
        F.when(p % 17 == 0, "").otherwise("}"),
    )
    return data.table(spark, folder, "part").select("p_partkey", doc.alias("document"))


def spec_violations(spark: SparkSession, folder: str) -> DataFrame:
    return _joined(rules.spec_violations(_spec(spark, folder))).select("p_partkey", "violations")


def migrated_specs(spark: SparkSession, folder: str) -> DataFrame:
    done = rules.migrate_specs(_spec(spark, folder))
    return done.select(
        "p_partkey",
        "reason",
        F.get_json_object("migrated", "$.schema_version").alias("version"),
        F.get_json_object("migrated", "$.motion.amount").alias("amount"),
        F.get_json_object("migrated", "$.frame.radius").alias("radius"),
    )


def settings_violations(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_custkey")
    doc = F.concat(
        F.lit('{"fps":'),
        (o % 40).cast("string"),
        F.lit(',"max_duration_seconds":'),
        (o % 14 / 2.0).cast("string"),
        F.lit(',"max_bytes":'),
        F.floor(F.col("o_totalprice") * 10).cast("string"),
        F.lit(',"palette_colors":'),
        (o % 300).cast("string"),
        F.when(o % 6 == 0, ',"mode":"x"').otherwise(""),
        F.lit("}"),
    )
    rows = data.table(spark, folder, "orders").select("o_orderkey", doc.alias("document"))
    return _joined(rules.settings_violations(rows)).select("o_orderkey", "violations")


def state_violations(spark: SparkSession, folder: str) -> DataFrame:
    e = data.table(spark, folder, "events")
    v, u = F.col("value"), F.col("user_id")
    states = e.select(
        "event_id",
        (v * 5 - 100).alias("x"),
        (v * 3).alias("y"),
        (v / 4).alias("scale"),
        (v * 4 - 50).alias("rotation"),
        F.array(
            F.lit(0), (u % 400).cast("int"), v.cast("int"), (u % 300).cast("int")
        ).alias("crop"),
    )
    return _joined(pixels.state_violations(states)).select("event_id", "violations")


def mask_state_violations(spark: SparkSession, folder: str) -> DataFrame:
    e = data.table(spark, folder, "events")
    v = F.col("value")
    states = e.select(
        "event_id",
        F.lit(True).alias("enabled"),
        F.when(F.col("event_id") % 8 != 0, F.lit(False)).alias("inverted"),
        (v / 30).alias("opacity"),
        (v * 100).alias("feather_radius"),
        (v - 1).alias("blur_radius"),
        (v / 100).alias("levels_low"),
        (F.col("user_id") % 10 / 8.0).alias("levels_high"),
        F.when(F.col("event_id") % 2 == 0, v / 20).alias("threshold"),
    )
    return _joined(rules.mask_violations(states)).select("event_id", "violations")


def layer_state_violations(spark: SparkSession, folder: str) -> DataFrame:
    li = data.table(spark, folder, "lineitem")
    layers = li.select(
        "l_orderkey",
        F.col("l_returnflag").alias("layer_id"),
        F.when(F.col("l_linenumber") != 3, F.lit("s")).alias("source_id"),
        (F.col("l_quantity") / 40).alias("opacity"),
        F.when(F.col("l_linestatus") == "O", F.lit(True)).alias("visible"),
        _pick(F.col("l_partkey") % 3, "normal", "screen", "add").alias("blend_mode"),
    )
    return _joined(rules.layer_violations(layers)).select("l_orderkey", "violations")


def presets(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_custkey")
    names = list(rules.PRESETS)
    over = F.create_map(
        _pick(o % 3, "background", "motion", "sound"),
        F.create_map(F.lit("color"), F.concat(F.lit("#"), F.lpad(o.cast("string"), 6, "0"))),
    )
    requests = data.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.coalesce(_pick(o % 10, *[f" {n.upper()} " for n in names]), F.lit("none")).alias(
            "preset"
        ),
        F.when(o % 4 != 0, over).alias("overrides"),
    )
    done = rules.resolve_presets(requests)
    return done.select(
        "request_id",
        "section",
        F.try_element_at("fields", F.lit("color")).alias("color"),
        F.try_element_at("fields", F.lit("style")).alias("style"),
        "reason",
    )


def preset_layers(spark: SparkSession, folder: str) -> DataFrame:
    """Presets with a list of layers as override."""
    o = F.col("o_custkey")
    layer = lambda kind: F.create_map(F.lit("type"), F.lit(kind), F.lit("opacity"), (o % 10 / 10.0).cast("string"))
    requests = data.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        _pick(o % 2, "neon", "royal").alias("preset"),
        F.create_map().cast("map<string,map<string,string>>").alias("overrides"),
        F.when(o % 3 != 0, F.array_repeat(layer("glow"), (o % 3).cast("int"))).alias("layers"),
    )
    done = rules.resolve_presets(requests)
    shown = F.transform("items", lambda i: F.concat(F.try_element_at(i, F.lit("type")), F.lit(":"), F.try_element_at(i, F.lit("opacity"))))
    return done.select("request_id", "section", F.concat_ws(",", shown).alias("items"), "reason")


def spec_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Design documents read as single documents: which ones cannot be used, and why."""
    return read_docs(_spec(spark, folder), "spec").select("p_partkey", "reason")


def settings_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Settings documents, some of them cut off, too deep, with a repeated key or no object."""
    p = F.col("p_partkey")
    text = (
        F.when(p % 11 == 0, F.concat(F.repeat(F.lit("["), F.lit(200)), F.repeat(F.lit("]"), F.lit(200))))
        .when(p % 7 == 0, '{"fps":1,"fps":2}')
        .when(p % 5 == 0, "[1]")
        .when(p % 3 == 0, '{"fps":')
        .otherwise(F.concat(F.lit('{"fps":'), F.col("p_size").cast("string"), F.lit("}")))
    )
    settings = data.table(spark, folder, "part").select("p_partkey", text.alias("document"))
    return read_docs(settings, "settings").select("p_partkey", "document", "reason")


def capability_check(spark: SparkSession, folder: str) -> DataFrame:
    li = data.table(spark, folder, "lineitem")
    ops = li.select(
        "l_orderkey",
        _pick(
            F.col("l_partkey") % 6, "crop", "blend", "upscale", "teleport", "warp", ""
        ).alias("capability_id"),
        (F.col("l_linenumber") % 5).alias("capability_version"),
        F.when(F.col("l_linestatus") == "O", "project.image").otherwise("render.mask").alias(
            "input_domain"
        ),
        F.when(F.col("l_returnflag") != "R", "project.image").alias("output_domain"),
    )
    return rules.check_operations(ops).select("l_orderkey", "capability_id", "reason")


def capability_table_check(spark: SparkSession, folder: str) -> DataFrame:
    """The check against a catalogue table, one capability per supplier."""
    own, part = F.col("s_suppkey"), F.col("l_partkey")
    name = lambda key: F.concat(F.lit("cap"), key.cast("string"))
    image = F.lit("project.image")
    catalogue = data.table(spark, folder, "supplier").select(
        name(own).alias("capability_id"),
        F.when(own % 3 != 0, "available").otherwise("planned").alias("state"),
        (own % 2 + 1).alias("version"),
        image.alias("input_domain"),
        image.alias("output_domain"),
    )
    ops = data.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(part % 11 != 0, name(F.col("l_suppkey"))).otherwise("other").alias("capability_id"),
        (F.col("l_linenumber") % 3).cast("bigint").alias("capability_version"),
        F.when(F.col("l_linestatus") == "O", image).otherwise("render.mask").alias("input_domain"),
        F.when(F.col("l_returnflag") != "R", image).alias("output_domain"),
    )
    return rules.check_against(ops, catalogue).select(
        "l_orderkey", "l_linenumber", "capability_id", "reason"
    )


def _rate_text(spark: SparkSession, folder: str) -> DataFrame:
    li = data.table(spark, folder, "lineitem")
    n, d = F.col("l_quantity").cast("int").cast("string"), (F.col("l_suppkey") % 4).cast("string")
    shape = F.col("l_partkey") % 5
    rate = (
        F.when(shape == 0, n)
        .when(shape == 1, F.concat(n, F.lit("/x")))
        .when(shape == 2, F.concat(n, F.lit("/"), d, F.lit("/2")))
        .otherwise(F.concat(n, F.lit("/"), d))
    )
    return li.select("l_orderkey", "l_linenumber", rate.alias("rate"))


def frame_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rate_text(spark, folder)
    return six(rows.withColumn("fps", parse_rate(F.col("rate"))), "fps")


def media_preflight(spark: SparkSession, folder: str) -> DataFrame:
    o, k = F.col("o_custkey"), F.col("o_orderkey")
    video = F.concat(
        F.lit('{"codec_type":"video","width":'),
        (o % 8 * 100).cast("string"),
        F.lit(',"height":360,"nb_read_frames":"'),
        (k % 6 * 10).cast("string"),
        F.lit('","nb_frames":"'),
        (k % 4).cast("string"),
        F.lit('","avg_frame_rate":"'),
        (o % 5 * 12).cast("string"),
        F.lit('/2","duration":"7.5"}'),
    )
    audio = '{"codec_type":"audio","duration":"9"}'
    streams = F.when(k % 13 == 0, audio).otherwise(F.concat(F.lit(audio + ","), video))
    probe = F.concat(
        F.lit('{"streams":['),
        streams,
        F.lit('],"format":{"duration":"'),
        (k % 5 * 1.5).cast("string"),
        F.lit('"}}'),
    )
    probes = data.table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 43 != 0, k % 19 != 0).alias("exists"),
        F.when(k % 29 != 0, F.floor(F.col("o_totalprice") - 20_000).cast("bigint")).alias(
            "size_bytes"
        ),
        F.when(k % 23 != 0, probe).alias("probe"),
    )
    done = rules.preflight(probes, 400_000).drop("exists", "size_bytes", "probe")
    return six(done, "duration_s", "fps")


def workflow_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One workflow document per conversation, unpacked again into its operations."""
    c = data.table(spark, folder, "conversations")
    operation = F.concat(
        F.lit('{"capability_id":"cap'),
        F.col("turn").cast("string"),
        F.lit('","capability_version":'),
        F.when(F.col("turn") == 3, '"one"').otherwise("1"),
        F.lit(',"metadata":{},"payload":{"role":"'),
        F.col("role"),
        F.lit('"}}'),
    )
    # A workflow is one document by contract, at most 8 MiB.
    packed = c.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", operation.alias("o")))).alias("ops")
    )
    body = F.concat_ws(",", F.transform("ops", lambda v: v["o"]))
    doc = F.concat(
        F.lit('{"contract_version":'),
        F.when(F.col("conv_id") % 7 == 0, "2").otherwise("1"),
        F.lit(',"id":"w'),
        F.col("conv_id").cast("string"),
        F.lit('","operations":['),
        body,
        F.lit("]"),
        F.when(F.col("conv_id") % 5 == 0, ',"more":1').otherwise(""),
        F.when(F.col("conv_id") % 9 == 0, "").otherwise("}"),
    )
    rows = packed.select("conv_id", doc.alias("document"))
    return read_docs(rows, "workflow")


def _gif_rows(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("page_id")
    little = lambda n: F.unhex(
        F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    )
    content = F.concat(
        F.encode(_pick(p % 3, "GIF89a", "GIF87a", "PNG89a"), "US-ASCII"),
        little(p * 7 % 700),
        little(p * 3 % 500),
        F.encode("html", "UTF-8"),
    )
    rows = data.table(spark, folder, "pages").select(F.col("url").alias("path"), content.alias("content"), "page_id")
    return rows.withColumn("length", F.octet_length("content").cast("bigint"))


def gif_headers(spark: SparkSession, folder: str) -> DataFrame:
    return budget(gif_facts(_gif_rows(spark, folder)), 640, 480)


def inverted_frames(spark: SparkSession, folder: str) -> DataFrame:
    """A user kernel on packed frames: all channels but alpha inverted."""

    def invert(batch: pd.DataFrame) -> pd.DataFrame:
        flipped = []
        for rgba in batch["rgba"]:
            px = np.asarray(rgba).reshape(-1, 4).copy()
            px[:, :3] = 255 - px[:, :3]
            flipped.append(px.ravel())
        return batch.assign(rgba=flipped)

    return clips.to_pixels(map_frames(data.frames(spark, folder), invert))


QUERIES = {
    "utf8_check": utf8_check,
    "json_bounds": json_bounds,
    "json_violations": json_violations,
    "canonical_documents": canonical_documents,
    "revision_ids": revision_ids,
    "artifact_ids": artifact_ids,
    "color_and_id_checks": color_and_id_checks,
    "spec_violations": spec_violations,
    "migrated_specs": migrated_specs,
    "settings_violations": settings_violations,
    "state_violations": state_violations,
    "mask_state_violations": mask_state_violations,
    "layer_state_violations": layer_state_violations,
    "presets": presets,
    "preset_layers": preset_layers,
    "spec_documents": spec_documents,
    "settings_documents": settings_documents,
    "capability_check": capability_check,
    "capability_table_check": capability_table_check,
    "frame_rates": frame_rates,
    "media_preflight": media_preflight,
    "workflow_documents": workflow_documents,
    "gif_headers": gif_headers,
    "inverted_frames": inverted_frames,
}


def _names(*pairs: tuple[str, str]) -> str:
    """Comma list of the names whose condition holds."""
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in pairs)
    return f"concat_ws(',', {cases})"


_SPEC = """s AS (
    SELECT p_partkey, p_size, p_partkey % 17 = 0 AS broken FROM part)"""
_PRESET_ROWS = ", ".join(
    f"({i}, '{section}', {repr(values['color']) if 'color' in values else 'NULL'}, "
    f"{repr(values['style']) if 'style' in values else 'NULL'})"
    for i, sections in enumerate(rules.PRESETS.values())
    for section, values in sections.items()
)

ORACLES = {
    "utf8_check": "SELECT doc_id, doc_id % 3 <> 0 AS ok FROM documents",
    "json_bounds": """SELECT event_id,
        CASE WHEN event_id % 11 = 0 THEN -1 ELSE CAST(2 + event_id % 140 AS INTEGER) END AS depth,
        CASE WHEN event_id % 11 = 0 THEN 'brackets'
             WHEN 2 + event_id % 140 > 128 THEN 'depth' END AS reason FROM events""",
    "json_violations": """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'duplicate_key'
        WHEN 2 THEN 'not_finite' WHEN 3 THEN 'malformed' WHEN 4 THEN 'surrogate' END AS reason
        FROM events""",
    "canonical_documents": """SELECT event_id, '{"args":' || replace(props, ' ', '')
        || ',"list":[true,null],"user":' || user_id || ',"é":"ü"}' AS canonical,
        false AS was_canonical FROM events""",
    "revision_ids": """SELECT conv_id, turn, sha256('{"command_metadata":{"role":"' || role
        || '"},"parent_id":' || CASE WHEN turn > 0 THEN '"' || conv_id || '-' || (turn - 1) || '"'
           ELSE 'null' END || ',"state":' || CAST(to_json(text) AS VARCHAR) || '}') AS revision_id
        FROM conversations""",
    "artifact_ids": with_views("artifacts")
    + """, h AS (SELECT job_id, type, storage_path, sha1(
            '\\xa1\\xe2\\xb3\\xc4\\xd5\\xe6\\x78\\x90\\xab\\xcd\\xef\\x12\\x34\\x56\\x78\\x90'::BLOB
            || encode('["' || job_id || '","' || type || '","' || storage_path || '"]')) AS d
          FROM artifacts)
    SELECT job_id, type, storage_path, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5'
           || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef',
           '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS artifact_id FROM h""",
    "color_and_id_checks": """WITH c AS (
        SELECT p_partkey, ['#', '#', '', '#G'][p_partkey % 4 + 1]
               || CASE WHEN p_partkey * 37 % 65536 = 0 THEN '0'
                  ELSE ltrim(hex(p_partkey * 37 % 65536), '0') END AS color FROM part)
    SELECT p_partkey, regexp_full_match(color, '#[0-9a-fA-F]{3}([0-9a-fA-F]{3})?') AS is_color,
           p_partkey % 3 = 2 OR (p_partkey % 3 = 0 AND sha256(p_name) = upper(sha256(p_name)))
               AS is_revision
    FROM c JOIN part USING (p_partkey)""",
    "spec_violations": f"""WITH {_SPEC}
        SELECT p_partkey, CASE WHEN broken THEN 'malformed' ELSE """
    + _names(
        ("unknown_key", "p_partkey % 10 = 0"),
        ("section_type", "p_partkey % 19 = 0 OR p_partkey % 23 = 0"),
        ("schema_version", "p_partkey % 5 IN (0, 4)"),
        ("canvas", "p_partkey % 9 = 0"),
        ("background_color", "p_partkey % 3 = 1"),
        ("frame_shape", "p_partkey % 4 = 2"),
        ("frame_radius", "p_size * 4 > 160"),
        ("layer_type", "p_partkey % 4 = 3"),
        ("layer_opacity", "p_partkey % 13 > 10"),
        ("typography_size", "p_size * 3 NOT BETWEEN 10 AND 120"),
    )
    + " END AS violations FROM s",
    "migrated_specs": f"""WITH {_SPEC}, r AS (
        SELECT *, CASE WHEN broken THEN 'malformed'
                  WHEN p_partkey % 19 = 0 OR p_partkey % 23 = 0 THEN 'section_type'
                  WHEN p_partkey % 5 IN (0, 4)
                  THEN 'schema_version' END AS reason FROM s)
    SELECT p_partkey, reason, CASE WHEN reason IS NULL THEN '3' END AS version,
           CASE WHEN reason IS NULL THEN '8' END AS amount,
           CASE WHEN reason IS NULL THEN CAST(p_size * 4 AS VARCHAR) END AS radius FROM r""",
    "settings_violations": "SELECT o_orderkey, "
    + _names(
        ("unknown_key", "o_custkey % 6 = 0"),
        ("fps", "o_custkey % 40 NOT BETWEEN 1 AND 30"),
        ("max_duration_seconds", "o_custkey % 14 = 0 OR o_custkey % 14 > 12"),
        ("max_bytes", "floor(o_totalprice * 10) NOT BETWEEN 1 AND 2400000"),
        ("palette_colors", "o_custkey % 300 NOT BETWEEN 2 AND 256"),
    )
    + " AS violations FROM orders",
    "state_violations": "SELECT event_id, "
    + _names(
        ("x", "value * 5 - 100 NOT BETWEEN -320 AND 320"),
        ("y", "value * 3 NOT BETWEEN -320 AND 320"),
        ("scale", "value / 4 NOT BETWEEN 0.01 AND 64"),
        ("rotation", "value * 4 - 50 NOT BETWEEN -360 AND 360"),
        ("crop_origin", "user_id % 400 > 320"),
        (
            "crop_fit",
            "trunc(value) < 1 OR user_id % 300 < 1 OR trunc(value) > 320"
            " OR user_id % 400 + user_id % 300 > 320",
        ),
    )
    + " AS violations FROM events",
    "mask_state_violations": "SELECT event_id, "
    + _names(
        ("inverted", "event_id % 8 = 0"),
        ("opacity", "value / 30 > 1"),
        ("feather_radius", "value * 100 > 4096"),
        ("blur_radius", "value < 1"),
        ("levels_low", "value / 100 > 1"),
        ("levels_high", "user_id % 10 > 8"),
        ("levels_order", "value / 100 >= CAST(user_id % 10 AS DOUBLE) / 8"),
        ("threshold", "event_id % 2 = 0 AND value / 20 > 1"),
    )
    + " AS violations FROM events",
    "layer_state_violations": "SELECT l_orderkey, "
    + _names(
        ("source_id", "l_linenumber = 3"),
        ("opacity", "l_quantity > 40"),
        ("visible", "l_linestatus <> 'O'"),
        ("blend_mode", "l_partkey % 3 = 2"),
    )
    + " AS violations FROM lineitem",
    "preset_layers": """WITH sections(p, section) AS (VALUES (0, 'background'), (0, 'frame'), (0, 'typography'),
            (1, 'background'), (1, 'frame'), (1, 'typography')),
    req AS (SELECT o_orderkey AS request_id, o_custkey AS o FROM orders)
    SELECT request_id, section, '' AS items, CAST(NULL AS VARCHAR) AS reason FROM req JOIN sections ON p = o % 2
    UNION ALL SELECT request_id, 'layers', array_to_string([x FOR x IN list_transform(range(o % 3),
            lambda i: 'glow:' || CAST(CAST(o % 10 AS DOUBLE) / 10 AS VARCHAR))], ','), NULL
    FROM req WHERE o % 3 <> 0""",
    "spec_documents": f"""WITH {_SPEC}
        SELECT p_partkey, CASE WHEN broken THEN 'malformed' END AS reason FROM s""",
    "settings_documents": """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN repeat('[', 200) || repeat(']', 200)
               WHEN p_partkey % 7 = 0 THEN '{"fps":1,"fps":2}' WHEN p_partkey % 5 = 0 THEN '[1]'
               WHEN p_partkey % 3 = 0 THEN '{"fps":' ELSE '{"fps":' || p_size || '}' END AS document,
               CASE WHEN p_partkey % 11 = 0 THEN 'depth' WHEN p_partkey % 7 = 0 THEN 'duplicate_key'
               WHEN p_partkey % 5 = 0 THEN 'not_object' WHEN p_partkey % 3 = 0 THEN 'malformed' END AS reason
        FROM part""",
    "presets": f"""WITH base(p, section, color, style) AS (VALUES {_PRESET_ROWS}),
    req AS (
        SELECT o_orderkey AS request_id, o_custkey % 10 AS p,
               CASE WHEN o_custkey % 4 <> 0
                    THEN ['background', 'motion', 'sound'][o_custkey % 3 + 1] END AS over_section,
               '#' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS over_color,
               CASE WHEN o_custkey % 10 > 7 THEN 'unknown_preset'
                    WHEN o_custkey % 4 <> 0 AND o_custkey % 3 = 2 THEN 'unknown_section' END
                    AS reason FROM orders)
    SELECT request_id, section, CASE WHEN section = over_section THEN over_color ELSE color END
               AS color, style, reason
    FROM req JOIN base USING (p) WHERE reason IS NULL
    UNION ALL SELECT request_id, over_section, over_color, NULL, NULL FROM req
    WHERE reason IS NULL AND over_section = 'motion'
    UNION ALL SELECT request_id, NULL, NULL, NULL, reason FROM req WHERE reason IS NOT NULL""",
    "capability_check": """WITH o AS (
        SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag,
               ['crop', 'blend', 'upscale', 'teleport', 'warp', ''][l_partkey % 6 + 1]
               AS capability_id FROM lineitem)
    SELECT l_orderkey, capability_id, CASE WHEN capability_id = '' THEN 'no_capability'
           WHEN capability_id = 'teleport' THEN 'unknown_capability'
           WHEN capability_id = 'upscale' THEN 'planned'
           WHEN l_linestatus <> 'O' THEN 'input_domain' WHEN l_returnflag = 'R' THEN 'output_domain'
           WHEN l_linenumber % 5 <> 1 THEN 'version' END AS reason FROM o""",
    "capability_table_check": """WITH o AS (
        SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey % 11 = 0 AS other, l_linestatus, l_returnflag,
               CASE WHEN l_partkey % 11 <> 0 THEN 'cap' || l_suppkey ELSE 'other' END AS capability_id
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, capability_id, CASE WHEN other OR s_suppkey IS NULL THEN 'unknown_capability'
           WHEN s_suppkey % 3 = 0 THEN 'planned' WHEN l_linestatus <> 'O' THEN 'input_domain'
           WHEN l_returnflag = 'R' THEN 'output_domain'
           WHEN l_linenumber % 3 <> s_suppkey % 2 + 1 THEN 'version' END AS reason
    FROM o LEFT JOIN supplier ON s_suppkey = l_suppkey""",
    "frame_rates": """WITH r AS (
        SELECT l_orderkey, l_linenumber, l_partkey % 5 AS shape,
               CAST(trunc(l_quantity) AS INTEGER) AS n, l_suppkey % 4 AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber,
           CASE shape WHEN 0 THEN '' || n WHEN 1 THEN n || '/x' WHEN 2 THEN n || '/' || d || '/2'
                ELSE n || '/' || d END AS rate,
           CASE WHEN shape >= 3 AND d > 0 THEN round(CAST(n AS DOUBLE) / d, 6)
                ELSE CAST(0 AS DOUBLE) END AS fps FROM r""",
    "media_preflight": """WITH p AS (
        SELECT o_orderkey, o_orderkey AS k, o_custkey AS o,
               CAST(floor(o_totalprice - 20000) AS BIGINT) AS size,
               CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 6 * 10 ELSE o_orderkey % 4 END
                   AS n FROM orders),
    r AS (
        SELECT *, CASE WHEN k % 19 = 0 OR k % 43 = 0 THEN 'missing'
               WHEN size <= 0 OR k % 29 = 0 THEN 'empty'
               WHEN size > 400000 THEN 'too_large' WHEN k % 23 = 0 THEN 'not_probed'
               WHEN k % 13 = 0 THEN 'no_video' WHEN o % 8 = 0 THEN 'dimensions'
               WHEN n = 0 THEN 'no_frames' WHEN o % 5 = 0 THEN 'frame_rate' END AS reason FROM p)
    SELECT o_orderkey, reason, CASE WHEN reason IS NULL THEN o % 8 * 100 END AS width,
           CASE WHEN reason IS NULL THEN CAST(360 AS BIGINT) END AS height,
           CASE WHEN reason IS NULL THEN CASE WHEN k % 5 = 0 THEN CAST(7.5 AS DOUBLE)
                ELSE CAST(k % 5 AS DOUBLE) * 1.5 END END AS duration_s,
           CASE WHEN reason IS NULL THEN CAST(o % 5 * 6 AS DOUBLE) END AS fps,
           CASE WHEN reason IS NULL THEN n END AS frames FROM r""",
    "workflow_documents": """WITH r AS (
        SELECT *, CASE WHEN conv_id % 9 = 0 THEN 'malformed' WHEN conv_id % 5 = 0 THEN 'fields'
                       WHEN conv_id % 7 = 0 THEN 'version' END AS reason FROM conversations)
    SELECT conv_id, CAST(turn AS INTEGER) AS idx, 'cap' || turn AS capability_id,
           CASE WHEN turn <> 3 THEN 1 END AS capability_version, '{}' AS metadata,
           '{"role":"' || role || '"}' AS payload, 'w' || conv_id AS workflow_id,
           CASE WHEN turn = 3 THEN 'item_fields' END AS reason FROM r WHERE reason IS NULL
    UNION ALL SELECT DISTINCT conv_id, CAST(NULL AS INTEGER), NULL, CAST(NULL AS INTEGER), NULL,
           NULL, CASE WHEN conv_id % 9 <> 0 THEN 'w' || conv_id END, CASE WHEN reason = 'malformed' AND conv_id % 9 = 0 THEN 'brackets_or_malformed'
           ELSE reason END FROM r WHERE reason IS NOT NULL""".replace(
        "'brackets_or_malformed'", "'malformed'"
    ),
    "gif_headers": """WITH c AS (
        SELECT url AS path, page_id, encode(['GIF89a', 'GIF87a', 'PNG89a'][page_id % 3 + 1])
               || unhex(lpad(hex(page_id * 7 % 700 % 256), 2, '0')
                        || lpad(hex(page_id * 7 % 700 // 256), 2, '0')
                        || lpad(hex(page_id * 3 % 500 % 256), 2, '0')
                        || lpad(hex(page_id * 3 % 500 // 256), 2, '0'))
               || encode(html) AS content FROM pages)
    SELECT path, octet_length(content) AS size_bytes, sha256(content) AS sha256,
           page_id % 3 <> 2 AS signature_ok,
           CASE WHEN page_id % 3 <> 2 THEN CAST(page_id * 7 % 700 AS INTEGER) END AS canvas_width,
           CASE WHEN page_id % 3 <> 2 THEN CAST(page_id * 3 % 500 AS INTEGER) END AS canvas_height,
           CASE WHEN page_id % 3 = 2 THEN 'header'
                WHEN page_id * 7 % 700 = 0 OR page_id * 3 % 500 = 0 THEN 'dimensions'
                WHEN page_id * 7 % 700 > 640 OR page_id * 3 % 500 > 480 THEN 'canvas_limit' END
                AS reason FROM c""",
    "inverted_frames": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,"
    " 255 - r AS r, 255 - g AS g, 255 - b AS b, a FROM pixels8",
}
