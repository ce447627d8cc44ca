"""Per-pixel transforms: column expressions on ``(clip_id, frame_idx, y, x, r, g, b, a)``.

None of them shuffles; a chain of them collapses into one projection.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import color
from loomframe.functions.numeric import clamp, rint_u8, truncate_u8, violations
from loomframe.operators.ordered import attach

RGB = ("r", "g", "b")
CHANNELS = (*RGB, "a")
MAX_STEPS = 32
# Sepia weights, one row per output channel.
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))

Transform = Callable[[DataFrame], DataFrame]


def _each(px: DataFrame, fn: Callable[[Column], Column]) -> DataFrame:
    return px.withColumns({c: fn(F.col(c)) for c in RGB})


# --- value contract ----------------------------------------------------------------------


def pixel_violations(px: DataFrame) -> DataFrame:
    """Pixels per clip that break the value contract of linear frames."""

    def unusable(c: str) -> Column:
        value = F.col(c)
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    infinite = unusable("r") | unusable("g") | unusable("b") | unusable("a")
    negative = (F.col("r") < 0) | (F.col("g") < 0) | (F.col("b") < 0)
    alpha = (F.col("a") < 0) | (F.col("a") > 1)
    return px.groupBy("clip_id").agg(
        F.count_if(infinite).alias("not_finite"),
        F.count_if(negative).alias("negative_rgb"),
        F.count_if(alpha).alias("alpha_range"),
    )


def mask_violations(masks: DataFrame) -> DataFrame:
    broken = F.col("m").isNull() | F.isnan("m") | (F.col("m") < 0) | (F.col("m") > 1)
    return masks.groupBy("mask_id").agg(F.count_if(broken).alias("mask_range"))


# --- linear light ------------------------------------------------------------------------


def linearize(px8: DataFrame) -> DataFrame:
    """8-bit sRGB pixels to linear light; alpha is only scaled."""
    scaled = px8.withColumn("a", F.col("a") / 255.0)
    return _each(scaled, lambda c: color.linearize(c / 255.0))


def export_srgb(
    px: DataFrame, background: Sequence[float] = (0.0, 0.0, 0.0), mode: str = "clamp"
) -> DataFrame:
    return px.withColumns(
        {
            c: color.export_channel(F.col(c), F.col("a"), background[i], mode)
            for i, c in enumerate(RGB)
        }
    ).drop("a")


def exposure(px: DataFrame, stops: float) -> DataFrame:
    return _each(px, lambda c: c * 2.0**stops)


def gamma(px: DataFrame, power: float) -> DataFrame:
    return _each(px, lambda c: F.pow(c, F.lit(float(power))))


def gain(px: DataFrame, red: float, green: float, blue: float) -> DataFrame:
    gains = dict(zip(RGB, (red, green, blue)))
    return px.withColumns({c: F.col(c) * float(g) for c, g in gains.items()})


def color_matrix(px: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    """3x4 affine matrix; a negative result is reported by ``reason``, not clamped."""

    def row(weights: Sequence[float]) -> Column:
        return (
            F.col("r") * float(weights[0])
            + F.col("g") * float(weights[1])
            + F.col("b") * float(weights[2])
            + float(weights[3])
        )

    mixed = px.withColumns({c: row(w) for c, w in zip(RGB, matrix)})
    negative = (F.col("r") < 0) | (F.col("g") < 0) | (F.col("b") < 0)
    return mixed.withColumn("reason", F.when(negative, "negative_rgb"))


def tone_curve(
    px: DataFrame,
    red: Sequence[tuple[float, float]],
    green: Sequence[tuple[float, float]] | None = None,
    blue: Sequence[tuple[float, float]] | None = None,
) -> DataFrame:
    if green is None and blue is not None:
        raise ValueError("a blue curve needs a green curve")
    green = green or red
    blue = blue or green
    curves = dict(zip(RGB, (red, green, blue)))
    return px.withColumns({c: color.piecewise(F.col(c), p) for c, p in curves.items()})


# --- 8-bit -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Grade:
    brightness: float = 0.0
    contrast: float = 1.0
    saturation: float = 1.0
    temperature: float = 0.0
    tint: float = 0.0
    black_point: float = 0.0
    white_point: float = 1.0
    gamma: float = 1.0


def color_grade(px8: DataFrame, grade: Grade = Grade()) -> DataFrame:
    """Saturation around luminance, then levels, gamma, contrast and colour balance."""
    if grade == Grade():
        return px8
    unit = {c: F.col(c) / 255.0 for c in RGB}
    luma = color.luminance(*unit.values())
    indexed = px8.withColumns(
        {
            f"_{c}": clamp(
                F.rint((luma + (u - luma) * grade.saturation) * 255.0), 0.0, 255.0
            )
            for c, u in unit.items()
        }
    )
    warm, tint = grade.temperature * 0.12, grade.tint
    shifts = {"r": (warm, tint * 0.04), "g": (-tint * 0.08, 0.0), "b": (-warm, tint * 0.04)}

    def graded(c: str) -> Column:
        x = F.col(f"_{c}") / 255.0
        x = clamp((x - grade.black_point) / (grade.white_point - grade.black_point), 0.0, 1.0)
        if grade.gamma != 1.0:
            x = F.pow(x, F.lit(1.0 / grade.gamma))
        x = clamp((x - 0.5) * grade.contrast + 0.5 + grade.brightness, 0.0, 1.0)
        first, second = shifts[c]
        return rint_u8(clamp(x + first + second, 0.0, 1.0) * 255.0)

    return indexed.withColumns({c: graded(c) for c in RGB}).drop("_r", "_g", "_b")


def brightness_contrast(px8: DataFrame, brightness: float = 0.0, contrast: float = 1.0) -> DataFrame:
    return _each(px8, lambda c: truncate_u8((c - 127.5) * contrast + 127.5 + brightness))


def sepia(px8: DataFrame) -> DataFrame:
    row = lambda w: F.col("r") * w[0] + F.col("g") * w[1] + F.col("b") * w[2]
    return px8.withColumns({c: truncate_u8(row(w)) for c, w in zip(RGB, SEPIA)})


def posterize(px8: DataFrame, levels: int = 4) -> DataFrame:
    if not 2 <= levels <= 32:
        raise ValueError("levels must be between 2 and 32")
    step = 255.0 / (levels - 1)
    return _each(px8, lambda c: truncate_u8(F.rint(c / step) * step))


def vignette(px8: DataFrame, strength: float, width: int, height: int) -> DataFrame:
    dx = (F.col("x") - (width - 1) / 2) / max(1.0, width / 2)
    dy = (F.col("y") - (height - 1) / 2) / max(1.0, height / 2)
    radius = F.sqrt(dx * dx + dy * dy)
    light = clamp(
        1.0 - float(strength) * F.greatest(radius - 0.25, F.lit(0.0)) / 0.75, 0.0, 1.0
    )
    return _each(px8, lambda c: truncate_u8(c * light))


def grayscale(px8: DataFrame) -> DataFrame:
    """Fixed-point luma with 15 fraction bits, as image libraries compute it."""
    total = F.col("r") * 9798 + F.col("g") * 19235 + F.col("b") * 3735 + (1 << 14)
    gray = F.floor(total / F.lit(1 << 15)).cast("int")
    return px8.withColumns({c: gray for c in RGB})


def saturation(px8: DataFrame, factor: float) -> DataFrame:
    """Scale HSV saturation with 8-bit hue (0-179) and saturation steps.

    Image libraries use integer tables here; results agree within one step per channel.
    """
    top, low = F.greatest(*RGB), F.least(*RGB)
    spread = top - low
    has = spread > 0
    safe = F.when(has, spread)
    degrees = (
        F.when(~has, F.lit(0.0))
        .when(F.col("r") == top, 60.0 * (F.col("g") - F.col("b")) / safe)
        .when(F.col("g") == top, 120.0 + 60.0 * (F.col("b") - F.col("r")) / safe)
        .otherwise(240.0 + 60.0 * (F.col("r") - F.col("g")) / safe)
    )
    hsv = px8.withColumns(
        {
            "_h": F.pmod(F.rint(F.pmod(degrees, F.lit(360.0)) / 2.0), F.lit(180.0)),
            "_s": F.when(top > 0, F.rint(255.0 * spread / F.when(top > 0, top))).otherwise(0.0),
            "_v": top.cast("double"),
        }
    ).withColumn("_s", F.floor(clamp(F.col("_s") * float(factor), 0.0, 255.0)) / 255.0)
    sector = F.col("_h") / 30.0
    whole = F.floor(sector)
    part = sector - whole
    v, s = F.col("_v"), F.col("_s")
    p, q, t = v * (1 - s), v * (1 - s * part), v * (1 - s * (1 - part))
    table = {"r": (v, q, p, p, t, v), "g": (t, v, v, q, p, p), "b": (p, p, t, v, v, q)}

    def pick(options: Sequence[Column]) -> Column:
        result = options[5]
        for i in range(4, -1, -1):
            result = F.when(whole == i, options[i]).otherwise(result)
        return rint_u8(result)

    return hsv.withColumns({c: pick(o) for c, o in table.items()}).drop("_h", "_s", "_v")


# --- coordinates -------------------------------------------------------------------------


def flip_horizontal(px: DataFrame, width: int) -> DataFrame:
    return px.withColumn("x", F.lit(width - 1) - F.col("x"))


def flip_vertical(px: DataFrame, height: int) -> DataFrame:
    return px.withColumn("y", F.lit(height - 1) - F.col("y"))


def rot90(px: DataFrame, width: int, height: int, turns: int = 1) -> DataFrame:
    """Quarter turns counter-clockwise."""
    for _ in range(turns % 4):
        px = px.withColumns({"y": F.lit(width - 1) - F.col("x"), "x": F.col("y")})
        width, height = height, width
    return px


def crop(px: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(
        top, top + height - 1
    )
    return px.filter(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def focus_offset(available: int, focus: float) -> int:
    return min(available, max(0, round(available * focus)))


def focus_crop(
    px: DataFrame,
    source: tuple[int, int],
    target: tuple[int, int],
    focus: tuple[float, float] = (0.5, 0.5),
) -> DataFrame:
    """Crop to ``target`` (width, height) around a focus point in [0, 1]."""
    if target[0] > source[0] or target[1] > source[1]:
        raise ValueError("the crop target is larger than the source")
    left = focus_offset(source[0] - target[0], focus[0])
    top = focus_offset(source[1] - target[1], focus[1])
    return crop(px, left, top, *target)


def _overlaps(place: Column, size: Column, cells: Column) -> Column:
    """Cells of a resized axis that a pixel lies in, with the length it has in each."""
    low = F.floor(place * cells / size).cast("int")
    high = F.ceil((place + 1) * cells / size).cast("int") - 1
    width = size / cells
    return F.transform(
        F.sequence(low, high),
        lambda i: F.struct(i.alias("cell"), (F.least((i + 1) * width, place + 1) - F.greatest(i * width, place)).alias("part")),
    )


def pixelate(px8: DataFrame, block: int) -> DataFrame:
    """Shrink each frame by area to one cell per whole block, then repeat; any block size.

    Where blocks do not divide the frame, cells are a little larger and a pixel on a border
    counts in both by its parts. Frames are whole; their size is that of their pixels.
    """
    if not 2 <= block <= 128:
        raise ValueError("block must be between 2 and 128")
    frame = ["clip_id", "frame_idx"]
    sizes = px8.groupBy(*frame).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    count = lambda size: F.greatest(F.lit(1), F.floor(F.col(size) / block).cast("int"))
    sized = attach(px8, sizes, frame, F.struct("y", "x")).withColumns({"_nx": count("_w"), "_ny": count("_h")})
    own = {
        "_cx": F.floor(F.col("x") * F.col("_nx") / F.col("_w")).cast("int"),
        "_cy": F.floor(F.col("y") * F.col("_ny") / F.col("_h")).cast("int"),
    }
    parts = sized.withColumn("_x", F.explode(_overlaps(F.col("x"), F.col("_w"), F.col("_nx")))).withColumn(
        "_y", F.explode(_overlaps(F.col("y"), F.col("_h"), F.col("_ny")))
    )
    area = F.max((F.col("_w") / F.col("_nx")) * (F.col("_h") / F.col("_ny")))
    means = parts.groupBy(*frame, F.col("_x.cell").alias("_cx"), F.col("_y.cell").alias("_cy")).agg(
        *[rint_u8(F.sum(F.col(c) * F.col("_x.part") * F.col("_y.part")) / area).alias(f"_{c}") for c in "rgba"]
    )
    joined = sized.withColumns(own).join(means, [*frame, "_cx", "_cy"])
    return joined.select(*[F.col(f"_{c}").alias(c) if c in CHANNELS else F.col(c) for c in px8.columns])


# --- alpha over time ---------------------------------------------------------------------


def fade(
    px: DataFrame, start: float, end: float, start_alpha: float = 1.0, end_alpha: float = 0.0
) -> DataFrame:
    """Alpha times a linear ramp over the time column ``t``."""
    if end <= start:
        raise ValueError("end must be after start")
    progress = clamp((F.col("t") - float(start)) / (float(end) - float(start)), 0.0, 1.0)
    level = float(start_alpha) + (float(end_alpha) - float(start_alpha)) * progress
    return px.withColumn("a", F.col("a") * level)


# --- stacks of user transforms -------------------------------------------------------------


def effect_stack(px: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    """Apply up to 32 transforms in order."""
    if len(steps) > MAX_STEPS:
        raise ValueError(f"at most {MAX_STEPS} steps")
    for step in steps:
        px = px.transform(step)
    return px


def temporal_stack(
    px: DataFrame, steps: Sequence[Callable[[DataFrame, str], DataFrame]], time_column: str = "t"
) -> DataFrame:
    """Apply up to 32 time-aware transforms in order; each gets the time column's name."""
    if len(steps) > MAX_STEPS:
        raise ValueError(f"at most {MAX_STEPS} steps")
    for step in steps:
        px = step(px, time_column)
    return px


def state_violations(df: DataFrame) -> DataFrame:
    """Broken rules of transform states: x, y, scale, rotation, crop ARRAY<INT>."""
    out = lambda c, lo, hi: F.coalesce(~F.col(c).between(lo, hi), F.lit(True)) | F.isnan(c)
    cx, cy, cw, ch = (F.get("crop", i) for i in range(4))
    bad_shape = F.coalesce(F.size("crop") != 4, F.lit(True)) | F.exists(
        "crop", lambda v: v.isNull()
    )
    return df.withColumn(
        "violations",
        violations(
            x=out("x", -320.0, 320.0),
            y=out("y", -320.0, 320.0),
            scale=out("scale", 0.01, 64.0),
            rotation=out("rotation", -360.0, 360.0),
            crop_shape=bad_shape,
            crop_origin=~bad_shape & ~(cx.between(0, 320) & cy.between(0, 320)),
            crop_fit=~bad_shape & ((cw < 1) | (ch < 1) | (cx + cw > 320) | (cy + ch > 320)),
        ),
    )


def rotation_matrix(width: Column, height: Column, state: Column) -> Column:
    """2x3 matrix of a transform state: scale and turn about the centre, then move."""
    turn = state["rotation"] * (math.pi / 180.0)
    p, q = state["scale"] * F.cos(turn), state["scale"] * F.sin(turn)
    cx, cy = width / 2.0, height / 2.0
    return F.array(
        p,
        q,
        (1.0 - p) * cx - q * cy + state["x"],
        -q,
        p,
        q * cx + (1.0 - p) * cy + state["y"],
    )
