"""Colour arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions.numeric import clamp, truncate_u8

# Rec.709 luminance weights.
LUMA = (0.2126, 0.7152, 0.0722)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def linearize(value: Column) -> Column:
    """sRGB in [0, 1] to linear light."""
    return F.when(value <= 0.04045, value / 12.92).otherwise(
        F.pow((value + 0.055) / 1.055, F.lit(2.4))
    )


def encode_srgb(value: Column) -> Column:
    """Linear light to an 8-bit sRGB code; the half is added before truncation."""
    x = clamp(value, 0.0, 1.0)
    coded = F.when(x <= 0.0031308, 12.92 * x).otherwise(
        1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055
    )
    return F.floor(coded * 255.0 + 0.5).cast("int")


def tone_map(value: Column) -> Column:
    """Compress non-negative linear light into [0, 1)."""
    x = F.greatest(value, F.lit(0.0))
    return x / (1.0 + x)


def export_channel(value: Column, alpha: Column, background: float, mode: str) -> Column:
    """Flatten over a background, map the tones and encode."""
    flat = value * alpha + F.lit(float(background)) * (1.0 - alpha)
    return encode_srgb(tone_map(flat) if mode == "reinhard" else flat)


def piecewise(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise-linear curve; the end segments go on beyond the ends."""
    segments = list(zip(points, points[1:]))

    def line(segment) -> Column:
        (x0, y0), (x1, y1) = segment
        return F.lit(float(y0)) + (value - float(x0)) * ((y1 - y0) / (x1 - x0))

    result = line(segments[-1])
    for segment in reversed(segments[:-1]):
        result = F.when(value < float(segment[1][0]), line(segment)).otherwise(result)
    return result


def blend_formula(mode: Column, dst: Column, src: Column) -> Column:
    """Unassociated blend of one linear channel; ``mode`` may differ per row."""
    overlay = F.when(dst <= 0.5, 2.0 * dst * src).otherwise(
        1.0 - 2.0 * (1.0 - dst) * (1.0 - src)
    )
    return (
        F.when(mode == "multiply", dst * src)
        .when(mode == "screen", 1.0 - (1.0 - dst) * (1.0 - src))
        .when(mode == "overlay", overlay)
        .otherwise(src)
    )


def over(dst: Column, src: Column, mode: Column, coverage: Column) -> Column:
    """Blend struct ``src`` over struct ``dst`` (fields r, g, b, a, straight alpha)."""
    sa = src["a"] * coverage
    alpha = sa + dst["a"] * (1.0 - sa)

    def channel(c: str) -> Column:
        mixed = blend_formula(mode, dst[c], src[c]) * sa + dst[c] * dst["a"] * (1.0 - sa)
        return F.when(alpha > 0, mixed / F.when(alpha > 0, alpha)).otherwise(F.lit(0.0))

    return F.struct(*[channel(c).alias(c) for c in "rgb"], alpha.alias("a"))


def blend_u8_channel(mode: str, base: Column, top: Column, coverage: Column) -> Column:
    """8-bit blend of one colour channel; ``coverage`` in [0, 1]."""
    p, q = base / 255.0, top / 255.0
    mixed = {
        "normal": q,
        "multiply": p * q,
        "screen": 1.0 - (1.0 - p) * (1.0 - q),
        "add": clamp(p + q, 0.0, 1.0),
    }[mode]
    return truncate_u8((p * (1.0 - coverage) + mixed * coverage) * 255.0)
