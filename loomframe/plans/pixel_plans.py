"""Registered pixel, mask, layer and palette queries and their cross-check SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions import color
from loomframe.operators import blending, clips, geometry, masks, palette, pixels
from loomframe.plans.common import six
from loomframe.sources import benchdata as data
from loomframe.sources.benchdata import with_views

GRADE = pixels.Grade(
    brightness=0.05,
    contrast=1.2,
    saturation=1.4,
    temperature=0.3,
    tint=-0.2,
    black_point=0.1,
    white_point=0.9,
    gamma=1.5,
)
MATRIX = ((0.9, 0.2, -0.1, 0.02), (0.1, 0.8, 0.1, 0.0), (-0.6, 0.3, 0.9, 0.01))
RED_CURVE = ((0.3, 0.2), (0.5, 0.55), (0.6, 0.9))
CORNERS = [(0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0)]
TARGET = [(0.0, 0.5), (3.0, 0.0), (2.5, 3.0), (0.5, 2.5)]
GREEN_CURVE = ((0.4, 0.1), (0.6, 0.8))


def _px8(spark: SparkSession, folder: str) -> DataFrame:
    return clips.to_pixels(data.frames(spark, folder))


def _px(spark: SparkSession, folder: str) -> DataFrame:
    return clips.to_linear(_px8(spark, folder))


def _on_u8(fn: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: fn(_px8(spark, folder))


def _on_linear(fn: Callable[[DataFrame], DataFrame]):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        done = fn(_px(spark, folder))
        return six(done, *[c for c, t in done.dtypes if t == "double"])

    return query


def _second(frames: DataFrame) -> DataFrame:
    """The frames of the next clip under this clip's id."""
    return frames.withColumn("clip_id", (F.col("clip_id") + 9) % 10)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    return blending.align_frames(frames, _second(frames))


def srgb_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    linear = pixels.linearize(_px8(spark, folder))
    back = {f"{c}_code": color.encode_srgb(F.col(c)) for c in "rgb"}
    return six(linear.withColumns(back), *"rgba")


def srgb_export(spark: SparkSession, folder: str) -> DataFrame:
    bright = pixels.exposure(_px(spark, folder), 1.0)
    return pixels.export_srgb(bright, (0.1, 0.2, 0.3), "reinhard")


def layer_align(spark: SparkSession, folder: str) -> DataFrame:
    px = _px8(spark, folder)
    joined = blending.align(px, _second(px))
    return joined.select(
        *blending.CELL,
        F.col("dst.r").alias("dst_r"),
        F.col("src.r").alias("src_r"),
        F.col("reason"),
    )


def _mode(index: Column) -> Column:
    modes = F.array(*[F.lit(m) for m in ("normal", "multiply", "screen", "overlay")])
    return F.get(modes, (index % 4).cast("int"))


def layer_blend(spark: SparkSession, folder: str) -> DataFrame:
    pairs = blending.scaled_pair(_pairs(spark, folder))
    mask = (F.col("x") + F.col("y")) / 6.0
    return six(blending.blend(pairs, _mode(F.col("frame_idx")), mask), *"rgba")


def layer_blend_u8(spark: SparkSession, folder: str) -> DataFrame:
    mask = (F.col("x") * 60 + F.col("y") * 15).cast("int")
    return blending.blend_u8(_pairs(spark, folder), "add", mask)


def layer_composite(spark: SparkSession, folder: str) -> DataFrame:
    layers = _px(spark, folder).withColumns(
        {"z_index": F.col("clip_id"), "mode": _mode(F.col("clip_id"))}
    )
    return six(blending.composite(layers), *"rgba")


def _masks(spark: SparkSession, folder: str) -> DataFrame:
    return _px(spark, folder).select(
        (F.col("clip_id") * 1_000_000 + F.col("frame_idx")).alias("mask_id"),
        "y",
        "x",
        F.col("a").alias("m"),
    )


def processed_masks(spark: SparkSession, folder: str) -> DataFrame:
    ids = data.frames(spark, folder).select(
        (F.col("clip_id") * 1_000_000 + F.col("frame_idx")).alias("mask_id")
    )
    k = F.col("mask_id")
    states = ids.select(
        "mask_id",
        (k % 7 != 0).alias("enabled"),
        (k % 2 == 0).alias("inverted"),
        (k % 5 / 4.0).alias("opacity"),
        (k % 3 * 0.8).alias("feather_radius"),
        (k % 4 * 2.0).alias("blur_radius"),
        (k % 3 * 0.2).alias("levels_low"),
        F.lit(0.75).alias("levels_high"),
        F.when(k % 6 == 0, 0.3).alias("threshold"),
    )
    return six(masks.process_mask(_masks(spark, folder), states), "m")


def derived_masks(spark: SparkSession, folder: str) -> DataFrame:
    px = _px(spark, folder)
    alpha = masks.mask_from_alpha(px).withColumn("kind", F.lit("alpha"))
    luma = masks.mask_from_luminance(px).withColumn("kind", F.lit("luminance"))
    return six(alpha.unionByName(luma), "m")


def selective_region(spark: SparkSession, folder: str) -> DataFrame:
    px = _px(spark, folder)
    other = masks.mask_from_luminance(_second(px))
    return six(masks.selective(px, lambda d: pixels.exposure(d, 1.0), other), *"rgba")


def temporal_fade(spark: SparkSession, folder: str) -> DataFrame:
    timed = _px(spark, folder).withColumn("t", F.col("frame_idx") * 0.05)
    faded = pixels.fade(timed, 0.5, 1.5, 0.9, 0.2)
    return six(faded, *"rgbat")


def crossfade(spark: SparkSession, folder: str) -> DataFrame:
    pairs = blending.scaled_pair(_pairs(spark, folder)).withColumn("t", F.col("frame_idx") * 0.05)
    return six(blending.crossfade(pairs, 0.5, 1.5), *"rgba")


def effect_stack(spark: SparkSession, folder: str) -> DataFrame:
    steps = [
        lambda d: pixels.exposure(d, 0.5),
        lambda d: pixels.gain(d, 0.9, 1.1, 0.5),
        lambda d: pixels.gamma(d, 2.0),
        lambda d: pixels.flip_horizontal(d, 4),
    ]
    return six(pixels.effect_stack(_px(spark, folder), steps), *"rgba")


def temporal_stack(spark: SparkSession, folder: str) -> DataFrame:
    timed = _px(spark, folder).withColumn("t", F.col("frame_idx") * 0.05)
    steps = [
        lambda d, t: pixels.fade(d, 0.0, 1.0, 0.5, 1.0),
        lambda d, t: d.withColumn("r", F.col("r") * (1.0 + F.col(t))),
        lambda d, t: pixels.fade(d, 1.0, 2.0, 1.0, 0.0),
    ]
    return six(pixels.temporal_stack(timed, steps), *"rgbat")


def pixel_violations(spark: SparkSession, folder: str) -> DataFrame:
    mixed = pixels.color_matrix(_px(spark, folder), MATRIX).withColumn("a", F.col("a") * 1.5)
    return pixels.pixel_violations(mixed)


def bound_layers(spark: SparkSession, folder: str) -> DataFrame:
    li = data.table(spark, folder, "lineitem")
    layer = F.struct(
        F.col("l_linenumber").cast("bigint").alias("layer_id"),
        F.col("l_partkey").alias("source_id"),
        (F.lit(1.0) - F.col("l_discount")).alias("opacity"),
        (F.col("l_returnflag") != "R").alias("visible"),
        F.lit("normal").alias("blend_mode"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("mask_id"),
    )
    # A stack has at most 256 layers by contract; orders have far fewer lines.
    # Lists do not shrink before the shuffle, so the lines are sorted behind it only.
    lines = li.select(F.col("l_orderkey").alias("stack_id"), layer.alias("layer"))
    stacks = lines.repartition("stack_id").groupBy("stack_id").agg(
        F.array_sort(F.collect_list("layer")).alias("layers")
    )
    side = F.lit(100)
    # Some sources and masks are listed under another id, so layers miss them.
    part, mask = F.col("p_partkey"), F.col("s_suppkey")
    sources = data.table(spark, folder, "part").select(
        F.when(part % 17 != 0, part).otherwise(-1 - part).alias("id"),
        side.alias("width"),
        (side + F.col("p_partkey") % 2).alias("height"),
    )
    shapes = data.table(spark, folder, "supplier").select(
        F.when(mask % 13 != 0, mask).otherwise(-1 - mask).alias("id"),
        side.alias("width"),
        (side + F.lit(0).cast("bigint")).alias("height"),
    )
    bound = blending.bind_layers(stacks, sources, shapes)
    return six(bound.drop("z_index", "blend_mode"), "mask_factor")


# --- palettes ----------------------------------------------------------------------------


def _coarse(px8: DataFrame) -> DataFrame:
    """Two bits per channel, so that a clip has at most 64 colours."""
    return px8.withColumns({c: F.col(c).bitwiseAND(F.lit(192)) for c in "rgb"})


def exact_palette(spark: SparkSession, folder: str) -> DataFrame:
    return palette.global_palette(_coarse(_px8(spark, folder)), 64)


def median_cut_palette(spark: SparkSession, folder: str) -> DataFrame:
    return palette.global_palette(_px8(spark, folder), 32)


def nearest_palette(spark: SparkSession, folder: str) -> DataFrame:
    px8 = _px8(spark, folder)
    firsts = px8.filter(F.col("frame_idx") == 0).select(
        "clip_id", (F.col("y") * 4 + F.col("x")).alias("idx"), "r", "g", "b"
    )
    return palette.quantize(px8, firsts).select(*blending.CELL, "palette_idx")


def nearest_palette_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder)
    firsts = clips.to_pixels(frames.filter(F.col("frame_idx") == 0)).select(
        "clip_id", (F.col("y") * 4 + F.col("x")).alias("idx"), "r", "g", "b"
    )
    mapped = palette.quantize_frames(frames, firsts)
    return mapped.select("clip_id", "frame_idx", F.posexplode("indices")).select(
        "clip_id",
        "frame_idx",
        F.floor(F.col("pos") / 4).cast("int").alias("y"),
        (F.col("pos") % 4).alias("x"),
        F.col("col").alias("palette_idx"),
    )


# --- packed frames -------------------------------------------------------------------------


def _unpacked(frames: DataFrame) -> DataFrame:
    return clips.to_pixels(frames.withColumn("rgba", F.col("rgba")))


def blurred_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _unpacked(geometry.blur(data.frames(spark, folder), 3))


def sharpened_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _unpacked(geometry.sharpen(data.frames(spark, folder), 1.5))


def pixelated_frames(spark: SparkSession, folder: str) -> DataFrame:
    return _unpacked(geometry.pixelate(data.frames(spark, folder), 3))


def fitted_frames(spark: SparkSession, folder: str) -> DataFrame:
    return six(_unpacked(geometry.frame_fit(data.frames(spark, folder), 3, 2)), *"rgba")


def filled_frames(spark: SparkSession, folder: str) -> DataFrame:
    filled = geometry.frame_fill(data.frames(spark, folder), 6, 4, (0.25, 1.0))
    lifted = _unpacked(filled).withColumns({c: F.col(c) + 1e-9 for c in "rgba"})
    return six(lifted, *"rgba")


def _matrix() -> Column:
    """Affine matrix that turns and shifts with the clip and the frame."""
    k = (F.col("clip_id") + F.col("frame_idx")) % 5
    return F.array(
        F.lit(1.0) - k * 0.1, F.lit(0.25), k * 0.5 - 1.0, F.lit(-0.25), F.lit(1.0), F.lit(0.5)
    )


def warped_frames(spark: SparkSession, folder: str) -> DataFrame:
    moved = geometry.warp(data.frames(spark, folder).withColumn("matrix", _matrix()))
    return six(_unpacked(moved), *"rgba")


def premultiplied_warp(spark: SparkSession, folder: str) -> DataFrame:
    frames = data.frames(spark, folder).withColumns(
        {
            "matrix": _matrix(),
            "rgba": F.transform("rgba", lambda v: v.cast("double") / 255.0),
        }
    )
    moved = _unpacked(geometry.warp(frames, premultiplied=True))
    # Some exact results end in half of the last place; both engines lift them the same way.
    return six(moved.withColumns({c: F.col(c) + 1e-9 for c in "rgba"}), *"rgba")


def perspective_frames(spark: SparkSession, folder: str) -> DataFrame:
    moved = geometry.warp_perspective(data.frames(spark, folder), CORNERS, TARGET, 4, 4)
    return six(_unpacked(moved), *"rgba")


def transform_states(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("frame_idx") % 3
    state = F.struct(
        (k * 0.5).alias("x"),
        F.lit(0.0).alias("y"),
        (F.lit(1.0) + k * 0.5).alias("scale"),
        (k * 30.0).alias("rotation"),
        F.array(F.lit(1), F.lit(0), F.lit(3), F.lit(4)).alias("crop"),
    )
    frames = data.frames(spark, folder).withColumn("state", state)
    return six(_unpacked(geometry.apply_transform_state(frames)), *"rgba")


def ratio_crop(spark: SparkSession, folder: str) -> DataFrame:
    cut = geometry.crop_to_ratio(data.frames(spark, folder), 200, 100, (0.5, 0.75))
    return six(_unpacked(cut), *"rgba")


def mask_violations(spark: SparkSession, folder: str) -> DataFrame:
    stretched = _masks(spark, folder).withColumn("m", F.col("m") * 2 - 0.7)
    return pixels.mask_violations(stretched)


QUERIES = {
    "ratio_crop": ratio_crop,
    "mask_violations": mask_violations,
    "srgb_round_trip": srgb_round_trip,
    "srgb_export": srgb_export,
    "exposure": _on_linear(lambda d: pixels.exposure(d, 1.5)),
    "gamma": _on_linear(lambda d: pixels.gamma(d, 2.2)),
    "gain": _on_linear(lambda d: pixels.gain(d, 0.5, 1.25, 2.0)),
    "color_matrix": _on_linear(lambda d: pixels.color_matrix(d, MATRIX)),
    "tone_curve": _on_linear(lambda d: pixels.tone_curve(d, RED_CURVE, GREEN_CURVE)),
    "color_grade": _on_u8(lambda d: pixels.color_grade(d, GRADE)),
    "brightness_contrast": _on_u8(lambda d: pixels.brightness_contrast(d, 12.5, 1.3)),
    "sepia": _on_u8(pixels.sepia),
    "posterize": _on_u8(lambda d: pixels.posterize(d, 5)),
    "vignette": _on_u8(lambda d: pixels.vignette(d, 0.7, 4, 4)),
    "grayscale": _on_u8(pixels.grayscale),
    "saturation": _on_u8(lambda d: pixels.saturation(d, 1.6)),
    "flip_horizontal": _on_u8(lambda d: pixels.flip_horizontal(d, 4)),
    "flip_vertical": _on_u8(lambda d: pixels.flip_vertical(d, 4)),
    "rot90": _on_u8(lambda d: pixels.rot90(d, 4, 4, 3)),
    "focus_crop": _on_u8(lambda d: pixels.focus_crop(d, (4, 4), (2, 3), (1.0, 0.0))),
    "pixelate": _on_u8(lambda d: pixels.pixelate(d, 2)),
    "layer_align": layer_align,
    "layer_blend": layer_blend,
    "layer_blend_u8": layer_blend_u8,
    "layer_composite": layer_composite,
    "processed_masks": processed_masks,
    "derived_masks": derived_masks,
    "selective_region": selective_region,
    "temporal_fade": temporal_fade,
    "crossfade": crossfade,
    "effect_stack": effect_stack,
    "temporal_stack": temporal_stack,
    "pixel_violations": pixel_violations,
    "bound_layers": bound_layers,
    "exact_palette": exact_palette,
    "median_cut_palette": median_cut_palette,
    "nearest_palette": nearest_palette,
    "nearest_palette_frames": nearest_palette_frames,
    "blurred_frames": blurred_frames,
    "sharpened_frames": sharpened_frames,
    "pixelated_frames": pixelated_frames,
    "fitted_frames": fitted_frames,
    "filled_frames": filled_frames,
    "warped_frames": warped_frames,
    "premultiplied_warp": premultiplied_warp,
    "perspective_frames": perspective_frames,
    "transform_states": transform_states,
}

# --- cross-check SQL -------------------------------------------------------------------------

_CELL = "clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x"


def _d(number: float) -> str:
    return f"CAST({number!r} AS DOUBLE)"


def _linear(*exprs: str, more: str = "") -> str:
    """Linear pixels with one expression per colour channel."""
    cols = ", ".join(f"round({e}, 6) + 0.0 AS {c}" for c, e in zip("rgb", exprs))
    return with_views("pixels") + f" SELECT {_CELL}, {cols}, round(a, 6) AS a{more} FROM pixels"


def _u8(*exprs: str) -> str:
    cols = ", ".join(f"CAST({e} AS INTEGER) AS {c}" for c, e in zip("rgb", exprs))
    return with_views("pixels8") + f" SELECT {_CELL}, {cols}, a FROM pixels8"


def _trunc(e: str) -> str:
    return f"floor(greatest(0, least(255, {e})))"


def _rint(e: str) -> str:
    return f"greatest(0, least(255, round_even({e}, 0)))"


def _lin(c: str) -> str:
    u = f"(CAST({c} AS DOUBLE) / 255)"
    return (
        f"CASE WHEN {u} <= {_d(0.04045)} THEN {u} / {_d(12.92)} "
        f"ELSE pow(({u} + {_d(0.055)}) / {_d(1.055)}, {_d(2.4)}) END"
    )


def _enc(x: str) -> str:
    u = f"greatest({_d(0.0)}, least({_d(1.0)}, {x}))"
    return (
        f"CAST(floor(CASE WHEN {u} <= {_d(0.0031308)} THEN {_d(12.92)} * {u} "
        f"ELSE {_d(1.055)} * pow({u}, 1 / {_d(2.4)}) - {_d(0.055)} END * 255 + 0.5) AS INTEGER)"
    )


def _tone(c: str, points) -> str:
    parts, segments = [], list(zip(points, points[1:]))
    for i, ((x0, y0), (x1, y1)) in enumerate(segments):
        line = f"{_d(y0)} + ({c} - {_d(x0)}) * {_d((y1 - y0) / (x1 - x0))}"
        parts.append(f"WHEN {c} < {_d(x1)} THEN {line}" if i < len(segments) - 1 else f"ELSE {line}")
    return f"CASE {' '.join(parts)} END" if len(segments) > 1 else parts[0][5:]


def _grade_sql() -> str:
    g = GRADE
    luma = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"
    unit = ", ".join(f"CAST({c} AS DOUBLE) / 255 AS {c}" for c in "rgb")
    luma = f"({_d(0.2126)} * r + {_d(0.7152)} * g + {_d(0.0722)} * b)"
    index = ", ".join(
        f"{_rint(f'({luma} + ({c} - {luma}) * {_d(g.saturation)}) * 255')} / {_d(255.0)} AS {c}"
        for c in "rgb"
    )
    shift = {
        "r": f"+ {_d(g.temperature * 0.12)} + {_d(g.tint * 0.04)}",
        "g": f"+ {_d(-g.tint * 0.08)} + {_d(0.0)}",
        "b": f"+ {_d(-g.temperature * 0.12)} + {_d(g.tint * 0.04)}",
    }
    unit_clip = lambda e: f"greatest({_d(0.0)}, least({_d(1.0)}, {e}))"

    def final(c: str) -> str:
        x = unit_clip(f"({c} - {_d(g.black_point)}) / {_d(g.white_point - g.black_point)}")
        x = f"pow({x}, {_d(1.0 / g.gamma)})"
        x = unit_clip(f"({x} - 0.5) * {_d(g.contrast)} + 0.5 + {_d(g.brightness)}")
        return f"CAST({_rint(f'{unit_clip(x + shift[c])} * 255')} AS INTEGER) AS {c}"

    return (
        with_views("pixels8")
        + f", u AS (SELECT clip_id, frame_idx, y, x, a, {unit} FROM pixels8),"
        + f" i AS (SELECT clip_id, frame_idx, y, x, a, {index} FROM u)"
        + f" SELECT {_CELL}, {', '.join(final(c) for c in 'rgb')}, a FROM i"
    )


_PAIRS = """pairs AS (
    SELECT coalesce(p.clip_id, q.c) AS clip_id, coalesce(p.frame_idx, q.frame_idx) AS frame_idx,
           coalesce(p.y, q.y) AS y, coalesce(p.x, q.x) AS x,
           p.r AS dr, p.g AS dg, p.b AS db, p.a AS da,
           q.r AS sr, q.g AS sg, q.b AS sb, q.a AS sa,
           CASE WHEN p.clip_id IS NULL OR q.c IS NULL THEN 'shape' END AS reason
    FROM {src} p FULL JOIN (SELECT *, (clip_id + 9) % 10 AS c FROM {src}) q
        ON q.c = p.clip_id AND q.frame_idx = p.frame_idx AND q.y = p.y AND q.x = p.x)"""


def _mix(mode: str, d: str, s: str) -> str:
    return (
        f"CASE {mode} WHEN 1 THEN {d} * {s} WHEN 2 THEN 1 - (1 - {d}) * (1 - {s}) "
        f"WHEN 3 THEN CASE WHEN {d} <= 0.5 THEN 2 * {d} * {s} "
        f"ELSE 1 - 2 * (1 - {d}) * (1 - {s}) END ELSE {s} END"
    )


def _median_cut_sql(colors: int) -> str:
    """The rounds of the cut, one common table expression per step."""
    parts = [
        "b0 AS (SELECT clip_id, r, g, b, count(*) AS n, CAST(0 AS BIGINT) AS box FROM pixels8 GROUP BY ALL)"
    ]
    rounds = math.ceil(math.log2(colors))
    for i in range(rounds):
        parts.append(
            f"""f{i} AS (
        SELECT clip_id, box, max(r) - min(r) AS sr, max(g) - min(g) AS sg, max(b) - min(b) AS sb,
               sum(n) AS w FROM b{i} GROUP BY ALL),
    k{i} AS (
        SELECT clip_id, box, w, greatest(sr, sg, sb) AS span,
               CASE greatest(sr, sg, sb) WHEN sg THEN 'g' WHEN sr THEN 'r' ELSE 'b' END AS axis,
               row_number() OVER (PARTITION BY clip_id ORDER BY -(greatest(sr, sg, sb) * w), box) AS place,
               count(*) OVER (PARTITION BY clip_id) AS boxes FROM f{i}),
    v{i} AS (
        SELECT b.*, k.w, CASE k.axis WHEN 'g' THEN g WHEN 'r' THEN r WHEN 'b' THEN b.b END AS v
        FROM b{i} b LEFT JOIN k{i} k ON k.clip_id = b.clip_id AND k.box = b.box
            AND k.span > 0 AND k.place <= {colors} - k.boxes),
    a{i} AS (SELECT clip_id, box, v, sum(n) AS n, any_value(w) AS w FROM v{i} WHERE v IS NOT NULL GROUP BY ALL),
    c{i} AS (
        SELECT clip_id, box, coalesce(min(v) FILTER (before * 2 >= w), max(v)) AS cut
        FROM (SELECT *, sum(n) OVER (PARTITION BY clip_id, box ORDER BY v
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a{i})
        GROUP BY ALL),
    b{i + 1} AS (
        SELECT clip_id, r, g, v.b, n, box * 2 + coalesce(v >= cut, FALSE)::INTEGER AS box
        FROM v{i} v LEFT JOIN c{i} USING (clip_id, box))"""
        )
    mean = lambda c: f"CAST(round_even(CAST(sum({c} * n) AS DOUBLE) / sum(n), 0) AS INTEGER) AS {c}"
    return (
        with_views("pixels8")
        + ",\n"
        + ",\n".join(parts)
        + f""", means AS (SELECT DISTINCT clip_id, r, g, b FROM (
            SELECT clip_id, box, {', '.join(map(mean, 'rgb'))} FROM b{rounds} GROUP BY clip_id, box))
    SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY r, g, b) - 1 AS INTEGER) AS idx,
           r, g, b FROM means"""
    )


def _saturation_sql() -> str:
    def pick(c: str) -> str:
        order = {"r": "vqpptv", "g": "tvvqpp", "b": "pptvvq"}[c]
        cases = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(order))
        return f"CAST({_rint(f'CASE whole {cases} END')} AS INTEGER) AS {c}"

    return (
        with_views("pixels8")
        + f""", m AS (SELECT *, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS d
                FROM pixels8),
        h AS (SELECT *, CASE WHEN d = 0 THEN CAST(0 AS DOUBLE)
                  WHEN r = top THEN CAST(60 AS DOUBLE) * (g - b) / d
                  WHEN g = top THEN 120 + CAST(60 AS DOUBLE) * (b - r) / d
                  ELSE 240 + CAST(60 AS DOUBLE) * (r - g) / d END AS deg,
                  CASE WHEN top > 0 THEN round_even(CAST(255 AS DOUBLE) * d / top, 0) ELSE 0 END AS s0
              FROM m),
        n AS (SELECT *, round_even(((deg % 360 + 360) % 360) / 2, 0) % 180 / CAST(30 AS DOUBLE)
                  AS sector, floor(greatest(0, least(255, s0 * {_d(1.6)}))) / {_d(255.0)} AS s FROM h),
        w AS (SELECT *, CAST(floor(sector) AS INTEGER) AS whole, sector - floor(sector) AS f,
                  CAST(top AS DOUBLE) AS v FROM n),
        z AS (SELECT *, v * (1 - s) AS p, v * (1 - s * f) AS q, v * (1 - s * (1 - f)) AS t FROM w)
        SELECT {_CELL}, {', '.join(pick(c) for c in 'rgb')}, a FROM z"""
    )


def _blur_sql(kernel: list[float], final: str) -> str:
    reach = len(kernel) // 2
    weights = "[" + ", ".join(_d(k) for k in kernel) + "]"

    def mirror(e: str) -> str:
        return f"least((({e}) % 6 + 6) % 6, 6 - (({e}) % 6 + 6) % 6)"

    def one_pass(source: str, axis: str) -> str:
        moved = mirror(f"p.{axis} + k - {reach}")
        other = "y" if axis == "x" else "x"
        sums = ", ".join(f"sum(q.{c} * ({weights})[k + 1]) AS {c}" for c in "rgba")
        return f"""SELECT p.clip_id, p.frame_idx, p.y, p.x, {sums}
            FROM {source} p CROSS JOIN (SELECT unnest(range({len(kernel)})) AS k) t
            JOIN {source} q ON q.clip_id = p.clip_id AND q.frame_idx = p.frame_idx
                AND q.{axis} = {moved} AND q.{other} = p.{other}
            GROUP BY p.clip_id, p.frame_idx, p.y, p.x"""

    return (
        with_views("pixels8")
        + f", h AS ({one_pass('pixels8', 'x')}), v AS ({one_pass('h', 'y')}) {final}"
    )


_AFFINE = (
    f"1 - k * {_d(0.1)}",
    _d(0.25),
    "k * 0.5 - 1",
    _d(-0.25),
    _d(1.0),
    _d(0.5),
)
_TURN = "CAST((clip_id + frame_idx) % 5 AS DOUBLE)"


def warp_sql(source: str, matrix: tuple = _AFFINE, param: str = _TURN) -> str:
    """Bilinear warp: four taps joined to the source pixels; missing taps count as zero.

    ``matrix`` has 6 terms (affine, to be inverted) or 9 (projective, inverse already).
    """
    taps = ", ".join(
        f"sum(q.{c} * CASE dx WHEN 0 THEN 1 - fx ELSE fx END"
        f" * CASE dy WHEN 0 THEN 1 - fy ELSE fy END) AS {c}"
        for c in "rgba"
    )
    terms = ", ".join(f"{e} AS m{i}" for i, e in enumerate(matrix))
    if len(matrix) == 6:
        sx = "(m4 * (tx - m2) - m1 * (ty - m5)) / (m0 * m4 - m1 * m3)"
        sy = "(m0 * (ty - m5) - m3 * (tx - m2)) / (m0 * m4 - m1 * m3)"
    else:
        sx = "(m0 * tx + m1 * ty + m2) / (m6 * tx + m7 * ty + m8)"
        sy = "(m3 * tx + m4 * ty + m5) / (m6 * tx + m7 * ty + m8)"
    return f"""grid AS (
        SELECT clip_id, frame_idx, CAST(y AS DOUBLE) AS ty, CAST(x AS DOUBLE) AS tx, y, x,
               {param} AS k FROM {source}),
    inv AS (SELECT *, {terms} FROM grid),
    src AS (
        SELECT clip_id, frame_idx, y, x, floor({sx} * 32 + 0.5) / 32 AS sx,
               floor({sy} * 32 + 0.5) / 32 AS sy FROM inv),
    taps AS (
        SELECT s.*, floor(sx) AS x0, floor(sy) AS y0, sx - floor(sx) AS fx, sy - floor(sy) AS fy,
               dx, dy
        FROM src s CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dx, dy)),
    warped AS (
        SELECT t.clip_id, t.frame_idx, t.y, t.x, {taps}
        FROM taps t LEFT JOIN {source} q ON q.clip_id = t.clip_id AND q.frame_idx = t.frame_idx
            AND q.x = t.x0 + t.dx AND q.y = t.y0 + t.dy
        GROUP BY t.clip_id, t.frame_idx, t.y, t.x)"""


def _perspective_terms() -> tuple:
    back = np.linalg.inv(np.array(geometry.homography(CORNERS, TARGET)).reshape(3, 3)).ravel()
    return tuple(_d(float(v)) for v in back)


def _cubic_sql() -> str:
    """Each target pixel from sixteen taps; positions beyond the edge repeat it."""
    a = -0.75
    far = lambda d: f"((({d} - 5) * {d} + 8) * {d} * {_d(a)} - {_d(4 * a)})"
    near = lambda d: f"(({_d(a + 2)} * {d} - {_d(a + 3)}) * {d} * {d} + 1)"
    weight = lambda f, i: (
        f"CASE {i} WHEN -1 THEN {far(f'({f} + 1)')} WHEN 0 THEN {near(f)}"
        f" WHEN 1 THEN {near(f'(1 - {f})')} ELSE {far(f'(2 - {f})')} END"
    )
    sums = ", ".join(
        f"round(sum(q.{c} * ({weight('fx', 'i')}) * ({weight('fy', 'j')})) + {_d(1e-9)}, 6) AS {c}"
        for c in "rgba"
    )
    # The target is 6 x 4 out of 6 x 6 pixels, the lower part.
    return f"""spots AS (
        SELECT f.clip_id, f.frame_idx, ty, tx, floor(sx) AS x0, floor(sy) AS y0,
               sx - floor(sx) AS fx, sy - floor(sy) AS fy
        FROM frames f CROSS JOIN (
            SELECT ty, tx, (tx + 0.5) * CAST(4 AS DOUBLE) / 6 - 0.5 AS sx,
                   (ty + 2 + 0.5) * CAST(4 AS DOUBLE) / 6 - 0.5 AS sy
            FROM (SELECT unnest(range(4)) AS ty) CROSS JOIN (SELECT unnest(range(6)) AS tx)))
    SELECT s.clip_id, s.frame_idx, CAST(ty AS INTEGER) AS y, CAST(tx AS INTEGER) AS x, {sums}
    FROM spots s CROSS JOIN (SELECT unnest(range(-1, 3)) AS i) CROSS JOIN
        (SELECT unnest(range(-1, 3)) AS j)
    JOIN pixels8 q ON q.clip_id = s.clip_id AND q.frame_idx = s.frame_idx
        AND q.x = greatest(0, least(3, x0 + i)) AND q.y = greatest(0, least(3, y0 + j))
    GROUP BY ALL"""


_WARPED = ", ".join(f"round(coalesce({c}, 0), 6) + 0.0 AS {c}" for c in "rgba")
_FADE = "greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (t - {a}) / {b}))"
_STATE_SCALE = f"(1 + k * {_d(0.5)})"
_STATE_TURN = f"(k * 30 * {_d(math.pi / 180.0)})"
_TIME = f"frame_idx * {_d(0.05)}"

ORACLES = {
    # Four by two pixels; row 0.75 * 2 = 1.5 rounds half to even, to 2.
    "ratio_crop": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(y - 2 AS INTEGER) AS y, CAST(x AS INTEGER) AS x, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in "rgba")
    + " FROM pixels8 WHERE y >= 2",
    "mask_violations": with_views("pixels")
    + f" SELECT clip_id * 1000000 + frame_idx AS mask_id,"
    f" count(*) FILTER (a * 2 - {_d(0.7)} < 0 OR a * 2 - {_d(0.7)} > 1) AS mask_range"
    " FROM pixels GROUP BY 1",
    "srgb_round_trip": with_views("pixels8")
    + f", l AS (SELECT clip_id, frame_idx, y, x, CAST(a AS DOUBLE) / 255 AS a, "
    + ", ".join(f"{_lin(c)} AS {c}" for c in "rgb")
    + f" FROM pixels8) SELECT {_CELL}, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in "rgba")
    + ", "
    + ", ".join(f"{_enc(c)} AS {c}_code" for c in "rgb")
    + " FROM l",
    "srgb_export": with_views("pixels")
    + ", flat AS (SELECT clip_id, frame_idx, y, x, "
    + ", ".join(
        f"{c} * 2 * a + {_d(bg)} * (1 - a) AS {c}" for c, bg in zip("rgb", (0.1, 0.2, 0.3))
    )
    + f" FROM pixels) SELECT {_CELL}, "
    + ", ".join(f"{_enc(f'({c} / (1 + {c}))')} AS {c}" for c in "rgb")
    + " FROM flat",
    "exposure": _linear(*[f"{c} * {_d(2.0**1.5)}" for c in "rgb"]),
    "gamma": _linear(*[f"pow({c}, {_d(2.2)})" for c in "rgb"]),
    "gain": _linear("r * 0.5", "g * 1.25", "b * 2"),
    "color_matrix": _linear(
        *[
            f"(r * {_d(m[0])} + g * {_d(m[1])} + b * {_d(m[2])} + {_d(m[3])})"
            for m in MATRIX
        ],
        more=", CASE WHEN "
        + " OR ".join(
            f"r * {_d(m[0])} + g * {_d(m[1])} + b * {_d(m[2])} + {_d(m[3])} < 0" for m in MATRIX
        )
        + " THEN 'negative_rgb' END AS reason",
    ),
    "tone_curve": _linear(
        _tone("r", RED_CURVE), _tone("g", GREEN_CURVE), _tone("b", GREEN_CURVE)
    ),
    "color_grade": _grade_sql(),
    "brightness_contrast": _u8(
        *[_trunc(f"({c} - {_d(127.5)}) * {_d(1.3)} + {_d(127.5)} + {_d(12.5)}") for c in "rgb"]
    ),
    "sepia": _u8(
        *[_trunc(f"r * {_d(w[0])} + g * {_d(w[1])} + b * {_d(w[2])}") for w in pixels.SEPIA]
    ),
    "posterize": _u8(*[_trunc(f"round_even({c} / {_d(63.75)}, 0) * {_d(63.75)}") for c in "rgb"]),
    "vignette": _u8(
        *[
            _trunc(
                f"{c} * greatest(0, least(1, 1 - {_d(0.7)} * greatest(sqrt("
                f"((x - {_d(1.5)}) / 2) * ((x - {_d(1.5)}) / 2)"
                f" + ((y - {_d(1.5)}) / 2) * ((y - {_d(1.5)}) / 2))"
                f" - {_d(0.25)}, 0) / {_d(0.75)}))"
            )
            for c in "rgb"
        ]
    ),
    "grayscale": _u8(*["(r * 9798 + g * 19235 + b * 3735 + 16384) // 32768"] * 3),
    "saturation": _saturation_sql(),
    "flip_horizontal": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(3 - x AS INTEGER) AS x,"
    " r, g, b, a FROM pixels8",
    "flip_vertical": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(3 - y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,"
    " r, g, b, a FROM pixels8",
    "rot90": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(x AS INTEGER) AS y, CAST(3 - y AS INTEGER) AS x,"
    " r, g, b, a FROM pixels8",
    "focus_crop": with_views("pixels8")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x,"
    " r, g, b, a FROM pixels8 WHERE x >= 2 AND y <= 2",
    "pixelate": with_views("pixels8")
    + f" SELECT {_CELL}, "
    + ", ".join(
        f"CAST(round_even(avg({c}) OVER w, 0) AS INTEGER) AS {c}" for c in "rgba"
    )
    + " FROM pixels8 WINDOW w AS (PARTITION BY clip_id, frame_idx, y // 2, x // 2)",
    "layer_align": with_views("pixels8")
    + """, other AS (SELECT (clip_id + 9) % 10 AS clip_id, frame_idx, y, x, r FROM pixels8)
    SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, p.r AS dst_r,
           q.r AS src_r, CASE WHEN p.r IS NULL OR q.r IS NULL THEN 'shape' END AS reason
    FROM pixels8 p FULL JOIN other q USING (clip_id, frame_idx, y, x)""",
    "layer_blend": with_views("pixels")
    + f", {_PAIRS.format(src='pixels')}, m AS ("
    + "SELECT *, sa * (CAST(x + y AS DOUBLE) / 6) AS s, frame_idx % 4 AS mode FROM pairs),"
    + " c AS (SELECT *, s + da * (1 - s) AS alpha FROM m)"
    + f" SELECT {_CELL}, "
    + ", ".join(
        f"CASE WHEN reason IS NULL THEN round(CASE WHEN alpha > 0 THEN"
        f" ({_mix('mode', 'd' + c, 's' + c)} * 1.0 * s"
        f" + d{c} * da * (1 - s)) / alpha ELSE 0 END, 6) + 0.0 END AS {c}"
        for c in "rgb"
    ).replace("* 1.0 * s", "* s")
    + ", round(alpha, 6) AS a, reason FROM c",
    "layer_blend_u8": with_views("pixels8")
    + f", {_PAIRS.format(src='pixels8')}, m AS ("
    + "SELECT *, CAST(x * 60 + y * 15 AS DOUBLE) / 255 AS k FROM pairs)"
    + f" SELECT {_CELL}, "
    + ", ".join(
        "CASE WHEN reason IS NULL THEN CAST("
        + _trunc(
            f"(CAST(d{c} AS DOUBLE) / 255 * (1 - k) + least(1, CAST(d{c} AS DOUBLE) / 255"
            f" + CAST(s{c} AS DOUBLE) / 255) * k) * 255"
        )
        + f" AS INTEGER) END AS {c}"
        for c in "rgb"
    )
    + ", CAST(round_even((CAST(sa AS DOUBLE) / 255 * k + CAST(da AS DOUBLE) / 255"
    " * (1 - CAST(sa AS DOUBLE) / 255 * k)) * 255, 0) AS INTEGER) AS a, reason FROM m",
    "layer_composite": with_views("pixels", recursive=True)
    + """, ranked AS (
        SELECT *, row_number() OVER (PARTITION BY frame_idx, y, x ORDER BY clip_id) AS z
        FROM pixels),
    fold AS (
        SELECT frame_idx, y, x, z, r, g, b, a FROM ranked WHERE z = 1
        UNION ALL
        SELECT n.frame_idx, n.y, n.x, n.z, """
    + ", ".join(
        f"CASE WHEN n.a + f.a * (1 - n.a) > 0 THEN ({_mix('n.clip_id % 4', 'f.' + c, 'n.' + c)}"
        f" * n.a + f.{c} * f.a * (1 - n.a)) / (n.a + f.a * (1 - n.a)) ELSE 0 END"
        for c in "rgb"
    )
    + """, n.a + f.a * (1 - n.a)
        FROM fold f JOIN ranked n ON n.frame_idx = f.frame_idx AND n.y = f.y AND n.x = f.x
            AND n.z = f.z + 1)
    SELECT frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
           round(r, 6) + 0.0 AS r, round(g, 6) + 0.0 AS g, round(b, 6) + 0.0 AS b, round(a, 6) AS a
    FROM fold QUALIFY row_number() OVER (PARTITION BY frame_idx, y, x ORDER BY z DESC) = 1""",
    "processed_masks": with_views("pixels")
    + """, masks AS (SELECT clip_id * 1000000 + frame_idx AS k, y, x, a AS m FROM pixels),
    states AS (
        SELECT *, CAST(least(ceil(CAST(k % 3 AS DOUBLE) * CAST(0.8 AS DOUBLE)), 3) AS INTEGER) AS r1,
               CAST(least(k % 4 * 2, 3) AS INTEGER) AS r2 FROM masks),
    fx AS (SELECT p.k, p.y, p.x, p.r1, p.r2, avg(q.m) AS m FROM states p
           CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) t JOIN masks q ON q.k = p.k AND q.y = p.y
               AND q.x = greatest(0, least(3, p.x + d)) WHERE abs(d) <= p.r1 GROUP BY ALL),
    fy AS (SELECT p.k, p.y, p.x, p.r2, avg(q.m) AS m FROM fx p
           CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) t JOIN fx q ON q.k = p.k AND q.x = p.x
               AND q.y = greatest(0, least(3, p.y + d)) WHERE abs(d) <= p.r1 GROUP BY ALL),
    bx AS (SELECT p.k, p.y, p.x, p.r2, avg(q.m) AS m FROM fy p
           CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) t JOIN fy q ON q.k = p.k AND q.y = p.y
               AND q.x = greatest(0, least(3, p.x + d)) WHERE abs(d) <= p.r2 GROUP BY ALL),
    bl AS (SELECT p.k, p.y, p.x, avg(q.m) AS m FROM bx p
           CROSS JOIN (SELECT unnest(range(-3, 4)) AS d) t JOIN bx q ON q.k = p.k AND q.x = p.x
               AND q.y = greatest(0, least(3, p.y + d)) WHERE abs(d) <= p.r2 GROUP BY ALL),
    lv AS (SELECT *, greatest(0, least(1, (m - CAST(k % 3 AS DOUBLE) * CAST(0.2 AS DOUBLE))
               / (CAST(0.75 AS DOUBLE) - CAST(k % 3 AS DOUBLE) * CAST(0.2 AS DOUBLE)))) AS v FROM bl),
    th AS (SELECT *, CASE WHEN k % 6 = 0 THEN CASE WHEN v < CAST(0.3 AS DOUBLE)
               THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END ELSE v END AS w FROM lv)
    SELECT k AS mask_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
           round(CASE WHEN k % 7 = 0 THEN CAST(1 AS DOUBLE)
               ELSE CASE WHEN k % 2 = 0 THEN 1 - w ELSE w END * (CAST(k % 5 AS DOUBLE) / 4) END, 6)
               + 0.0 AS m
    FROM th""",
    "derived_masks": with_views("pixels")
    + f" SELECT {_CELL}, round(a, 6) AS m, 'alpha' AS kind FROM pixels UNION ALL"
    f" SELECT {_CELL}, round(greatest(0, least(1, {_d(0.2126)} * r + {_d(0.7152)} * g"
    f" + {_d(0.0722)} * b)), 6), 'luminance' FROM pixels",
    "selective_region": with_views("pixels")
    + f""", luma AS (SELECT (clip_id + 9) % 10 AS clip_id, frame_idx, y, x, greatest(0, least(1,
        {_d(0.2126)} * r + {_d(0.7152)} * g + {_d(0.0722)} * b)) AS m FROM pixels)
    SELECT {_CELL}, """
    + ", ".join(f"round({c} * (1 - m) + {c} * 2 * m, 6) AS {c}" for c in "rgb")
    + """, round(a * (1 - m) + a * m, 6) AS a, CASE WHEN m IS NULL THEN 'mask_shape' END AS reason
    FROM pixels LEFT JOIN luma USING (clip_id, frame_idx, y, x)""",
    "temporal_fade": with_views("pixels")
    + f", timed AS (SELECT *, {_TIME} AS t FROM pixels)"
    + f" SELECT {_CELL}, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b,"
    + f" round(a * ({_d(0.9)} + {_d(0.2 - 0.9)} * {_FADE.format(a=0.5, b=1)}), 6) AS a,"
    + " round(t, 6) AS t FROM timed",
    "crossfade": with_views("pixels")
    + f", {_PAIRS.format(src='pixels')}, timed AS (SELECT *, {_TIME} AS t FROM pairs),"
    + f" prog AS (SELECT *, {_FADE.format(a=0.5, b=1)} AS p FROM timed),"
    + " mix AS (SELECT *, da + (sa - da) * p AS alpha FROM prog)"
    + f" SELECT {_CELL}, "
    + ", ".join(
        f"CASE WHEN reason IS NULL THEN round(CASE WHEN p = 0 THEN d{c} WHEN p = 1 THEN s{c}"
        f" WHEN alpha > 0 THEN (d{c} * da + (s{c} * sa - d{c} * da) * p) / alpha ELSE 0 END, 6)"
        f" END AS {c}"
        for c in "rgb"
    )
    + ", round(alpha, 6) AS a, reason FROM mix",
    "effect_stack": with_views("pixels")
    + " SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(3 - x AS INTEGER) AS x, "
    + ", ".join(
        f"round(pow({c} * {_d(2.0**0.5)} * {_d(g)}, 2), 6) AS {c}"
        for c, g in zip("rgb", (0.9, 1.1, 0.5))
    )
    + ", round(a, 6) AS a FROM pixels",
    "temporal_stack": with_views("pixels")
    + f", timed AS (SELECT *, {_TIME} AS t FROM pixels)"
    + f" SELECT {_CELL}, round(r * (1 + t), 6) AS r, round(g, 6) AS g, round(b, 6) AS b,"
    + f" round(a * (0.5 + 0.5 * {_FADE.format(a=0, b=1)}) * (1 - {_FADE.format(a=1, b=1)}), 6)"
    + " + 0.0 AS a, round(t, 6) AS t FROM timed",
    "pixel_violations": with_views("pixels")
    + " SELECT clip_id, CAST(0 AS BIGINT) AS not_finite, count(*) FILTER ("
    + " OR ".join(
        f"r * {_d(m[0])} + g * {_d(m[1])} + b * {_d(m[2])} + {_d(m[3])} < 0" for m in MATRIX
    )
    + f") AS negative_rgb, count(*) FILTER (a * {_d(1.5)} > 1) AS alpha_range"
    " FROM pixels GROUP BY clip_id",
    "bound_layers": """WITH shown AS (
        SELECT l_orderkey AS stack_id, CAST(l_linenumber AS BIGINT) AS layer_id,
               l_partkey AS source_id, 1 - l_discount AS opacity,
               CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS mask_id
        FROM lineitem WHERE l_returnflag <> 'R')
    SELECT stack_id, layer_id, source_id, mask_id,
           CASE WHEN mask_id IS NOT NULL OR opacity <> 1 THEN round(opacity, 6) END AS mask_factor,
           CASE WHEN p_partkey IS NULL THEN 'missing_source'
                WHEN mask_id IS NOT NULL AND s_suppkey IS NULL THEN 'missing_mask'
                WHEN mask_id IS NOT NULL AND p_partkey % 2 = 1 THEN 'mask_size' END AS reason
    FROM shown LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 17 <> 0)
        ON p_partkey = source_id
    LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 13 <> 0) ON s_suppkey = mask_id""",
    "exact_palette": with_views("pixels8")
    + """ SELECT clip_id, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY r, g, b) - 1
              AS INTEGER) AS idx, r, g, b
          FROM (SELECT DISTINCT clip_id, r & 192 AS r, g & 192 AS g, b & 192 AS b FROM pixels8)""",
    "median_cut_palette": _median_cut_sql(32),
    "nearest_palette": with_views("pixels8")
    + """, pal AS (SELECT clip_id, y * 4 + x AS idx, r, g, b FROM pixels8 WHERE frame_idx = 0)
    SELECT p.clip_id, p.frame_idx, CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x,
           CAST(arg_min(idx, ((p.r - q.r) ** 2 + (p.g - q.g) ** 2 + (p.b - q.b) ** 2, idx))
               AS INTEGER) AS palette_idx
    FROM pixels8 p JOIN pal q USING (clip_id) GROUP BY ALL""",
    "blurred_frames": _blur_sql(
        geometry.gaussian_kernel(3),
        f"SELECT {_CELL}, "
        + ", ".join(f"CAST({_rint(c)} AS INTEGER) AS {c}" for c in "rgba")
        + " FROM v",
    ),
    "sharpened_frames": _blur_sql(
        geometry.gaussian_kernel(7, 1.0),
        "SELECT p.clip_id, p.frame_idx, CAST(p.y AS INTEGER) AS y, CAST(p.x AS INTEGER) AS x, "
        + ", ".join(
            f"CAST({_rint(f'p.{c} * 2.5 - {_rint(f'v.{c}')} * 1.5')} AS INTEGER) AS {c}"
            for c in "rgba"
        )
        + " FROM pixels8 p JOIN v USING (clip_id, frame_idx, y, x)",
    ),
    "warped_frames": with_views("pixels8")
    + f", {warp_sql('pixels8')} SELECT {_CELL}, {_WARPED} FROM warped",
    "premultiplied_warp": with_views("pixels")
    + ", pm AS (SELECT clip_id, frame_idx, y, x, r * a AS r, g * a AS g, b * a AS b, a FROM pixels),"
    + f" {warp_sql('pm')}, un AS (SELECT clip_id, frame_idx, y, x, coalesce(a, 0) AS a, "
    + ", ".join(
        f"CASE WHEN coalesce(a, 0) > {_d(1e-8)} THEN greatest(0, least(1, {c} / least(1, a)))"
        f" ELSE CAST(0 AS DOUBLE) END AS {c}"
        for c in "rgb"
    )
    + f" FROM warped) SELECT {_CELL}, "
    + ", ".join(f"round({c} + {_d(1e-9)}, 6) AS {c}" for c in "rgba")
    + " FROM un",
    "perspective_frames": with_views("pixels8")
    + f", {warp_sql('pixels8', _perspective_terms())} SELECT {_CELL}, {_WARPED} FROM warped",
    "transform_states": with_views("pixels8")
    + ", cut AS (SELECT clip_id, frame_idx, y, x - 1 AS x, r, g, b, a FROM pixels8 WHERE x >= 1),"
    + f" s AS (SELECT *, frame_idx % 3 AS k FROM cut), "
    + warp_sql(
        "s",
        (
            f"({_STATE_SCALE} * cos({_STATE_TURN}))",
            f"({_STATE_SCALE} * sin({_STATE_TURN}))",
            f"((1 - {_STATE_SCALE} * cos({_STATE_TURN})) * 1.5"
            f" - {_STATE_SCALE} * sin({_STATE_TURN}) * 2 + k * {_d(0.5)})",
            f"(0 - {_STATE_SCALE} * sin({_STATE_TURN}))",
            f"({_STATE_SCALE} * cos({_STATE_TURN}))",
            f"({_STATE_SCALE} * sin({_STATE_TURN}) * 1.5"
            f" + (1 - {_STATE_SCALE} * cos({_STATE_TURN})) * 2)",
        ),
        "CAST(frame_idx % 3 AS DOUBLE)",
    )
    + f" SELECT {_CELL}, {_WARPED} FROM warped",
    "fitted_frames": with_views("pixels8")
    + """, small AS (SELECT clip_id, frame_idx, y // 2 AS y, x // 2 AS x, avg(r) AS r, avg(g) AS g,
                     avg(b) AS b, avg(a) AS a FROM pixels8 GROUP BY ALL),
    grid AS (SELECT clip_id, frame_idx, unnest(range(2)) AS y FROM frames),
    cells AS (SELECT *, unnest(range(3)) AS x FROM grid)
    SELECT clip_id, frame_idx, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, """
    + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in "rgba")
    + " FROM cells LEFT JOIN small USING (clip_id, frame_idx, y, x)",
    "filled_frames": with_views("pixels8") + f", {_cubic_sql()}",
    "pixelated_frames": with_views("pixels8")
    + f" SELECT {_CELL}, "
    + ", ".join(
        f"CAST(round_even(avg({c}) OVER w, 0) AS INTEGER) AS {c}" for c in "rgba"
    )
    + " FROM pixels8 WINDOW w AS (PARTITION BY clip_id, frame_idx)",
}
ORACLES["nearest_palette_frames"] = ORACLES["nearest_palette"]
