"""Joining and compositing layers of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import color
from loomframe.functions.numeric import clamp, first_reason, safe_ratio
from loomframe.operators.ordered import attach

CELL = ["clip_id", "frame_idx", "y", "x"]
CHANNELS = ("r", "g", "b", "a")
MAX_LAYERS = 256


def align(first: DataFrame, second: DataFrame, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    """Pair the cells of two pixel tables; a cell of only one side is a shape mismatch."""
    side = lambda df, name: df.select(*keys, F.struct(*CHANNELS).alias(name))
    joined = side(first, "dst").join(side(second, "src"), list(keys), "full")
    mismatch = F.col("dst").isNull() | F.col("src").isNull()
    return joined.withColumn("reason", F.when(mismatch, "shape"))


def align_frames(first: DataFrame, second: DataFrame) -> DataFrame:
    """The same pairing on packed frames: one row per frame is shuffled, not per pixel.

    A frame without partner, and the cells by which one frame exceeds the other, have only
    one side and the reason ``shape``.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("clip_id", "frame_idx", F.struct("width", "height", "rgba").alias(name))

    joined = side(first, "_a").join(side(second, "_b"), ["clip_id", "frame_idx"], "full")
    size = lambda part: F.greatest(
        F.coalesce(F.col(f"_a.{part}"), F.lit(0)), F.coalesce(F.col(f"_b.{part}"), F.lit(0))
    )
    grid = joined.withColumns({"_w": size("width"), "_h": size("height")}).filter("_w > 0 AND _h > 0")
    cells = grid.withColumn(
        "_p", F.explode(F.sequence(F.lit(0), F.col("_w") * F.col("_h") - 1))
    ).withColumns({"y": F.floor(F.col("_p") / F.col("_w")).cast("int"), "x": F.col("_p") % F.col("_w")})

    def pick(name: str) -> Column:
        frame = F.col(name)
        at = (F.col("y") * frame["width"] + F.col("x")) * 4
        inside = (F.col("y") < frame["height"]) & (F.col("x") < frame["width"])
        values = F.struct(*[F.get(frame["rgba"], at + i).alias(c) for i, c in enumerate(CHANNELS)])
        return F.when(inside, values)

    paired = cells.select(*CELL, pick("_a").alias("dst"), pick("_b").alias("src"))
    return paired.withColumn("reason", F.when(F.col("dst").isNull() | F.col("src").isNull(), "shape"))


def _cells(pairs: DataFrame, channels: dict[str, Column]) -> DataFrame:
    """Results of paired cells; cells with a reason keep it and have none."""
    if "reason" not in pairs.columns:
        return pairs.select(*CELL, *[c.alias(n) for n, c in channels.items()])
    sound = F.col("reason").isNull()
    return pairs.select(*CELL, *[F.when(sound, c).alias(n) for n, c in channels.items()], "reason")


def scaled_pair(pairs: DataFrame) -> DataFrame:
    """8-bit pairs to channels in [0, 1]."""
    unit = lambda s: F.when(
        F.col(s).isNotNull(), F.struct(*[(F.col(s)[c] / 255.0).alias(c) for c in CHANNELS])
    )
    return pairs.withColumns({s: unit(s) for s in ("dst", "src")})


def blend(pairs: DataFrame, mode: Column | str, mask: Column | float = 1.0) -> DataFrame:
    """Blend ``src`` over ``dst``; the mask scales the source alpha."""
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    coverage = mask if isinstance(mask, Column) else F.lit(float(mask))
    mixed = color.over(F.col("dst"), F.col("src"), mode, coverage)
    return _cells(pairs.withColumn("_o", mixed), {c: F.col(f"_o.{c}") for c in CHANNELS})


def blend_u8(pairs: DataFrame, mode: str, mask: Column | None = None) -> DataFrame:
    """8-bit blend with an 8-bit mask column."""
    coverage = F.lit(1.0) if mask is None else mask / 255.0
    top = F.col("src")["a"] / 255.0 * coverage
    alpha = top + F.col("dst")["a"] / 255.0 * (1.0 - top)
    mixed = {c: color.blend_u8_channel(mode, F.col("dst")[c], F.col("src")[c], coverage) for c in "rgb"}
    return _cells(pairs, {**mixed, "a": F.rint(alpha * 255.0).cast("int")})


def composite(
    layers: DataFrame, keys: Sequence[str] = ("frame_idx", "y", "x"), report: bool = False
) -> DataFrame:
    """Composite layers back to front, with one shuffle for any number of layers.

    Rows: ``keys, z_index, r, g, b, a`` and optionally ``mode`` and ``m``. A cell with more
    than ``MAX_LAYERS`` layers has no colour; with ``report`` it has the reason ``layer_limit``.
    """
    columns = set(layers.columns)
    mode = F.col("mode") if "mode" in columns else F.lit("normal")
    cover = F.col("m") if "m" in columns else F.lit(1.0)
    layer = F.struct(
        F.col("z_index"),
        F.struct(*CHANNELS).alias("px"),
        mode.alias("mode"),
        cover.alias("m"),
    )
    stacked = layers.groupBy(*keys).agg(F.array_sort(F.collect_list(layer)).alias("_z"))
    result = F.aggregate(
        F.slice("_z", F.lit(2), F.greatest(F.size("_z") - 1, F.lit(0))),
        F.get("_z", F.lit(0))["px"],
        lambda dst, top: color.over(dst, top["px"], top["mode"], top["m"]),
    )
    fits = F.size("_z") <= MAX_LAYERS
    reason = [F.when(F.col("_o").isNull(), "layer_limit").alias("reason")] if report else []
    return stacked.withColumn("_o", F.when(fits, result)).select(
        *keys, *[F.col(f"_o.{c}").alias(c) for c in CHANNELS], *reason
    )


def crossfade(pairs: DataFrame, start: float, end: float) -> DataFrame:
    """Premultiplied crossfade over the time column ``t``; exact copies at both ends."""
    if end <= start:
        raise ValueError("end must be after start")
    p = clamp((F.col("t") - float(start)) / (float(end) - float(start)), 0.0, 1.0)
    d, s = F.col("dst"), F.col("src")
    alpha = d["a"] + (s["a"] - d["a"]) * F.col("_p")

    def channel(c: str) -> Column:
        first, second = d[c] * d["a"], s[c] * s["a"]
        mixed = safe_ratio(first + (second - first) * F.col("_p"), alpha)
        return F.when(F.col("_p") == 0, d[c]).when(F.col("_p") == 1, s[c]).otherwise(mixed)

    return _cells(pairs.withColumn("_p", p), {**{c: channel(c) for c in "rgb"}, "a": alpha})


def bind_layers(stacks: DataFrame, sources: DataFrame, masks: DataFrame) -> DataFrame:
    """Visible layers of each stack in order, with their source and mask facts.

    ``stacks``: ``stack_id, layers ARRAY<STRUCT<layer_id, source_id, opacity, visible,
    blend_mode, mask_id>>``; ``sources`` and ``masks``: ``id, width, height``. Hidden
    layers are dropped before any lookup.
    """
    shown = F.filter("layers", lambda v: v["visible"])
    rows = stacks.select("stack_id", F.posexplode(shown).alias("z_index", "layer")).select(
        "stack_id", "z_index", "layer.*"
    )

    def facts(df: DataFrame, key: str, tag: str) -> DataFrame:
        return df.select(
            F.col("id").alias(key),
            F.struct("width", "height").alias(tag),
        )

    # Assets are shared between stacks, so a popular one is looked up over many tasks.

    spread = F.struct("stack_id", "z_index")
    bound = attach(rows, facts(sources, "source_id", "_source"), ["source_id"], spread)
    bound = attach(bound, facts(masks, "mask_id", "_mask"), ["mask_id"], spread)
    masked = F.col("mask_id").isNotNull()
    return bound.select(
        "stack_id",
        "z_index",
        "layer_id",
        "source_id",
        "mask_id",
        "blend_mode",
        F.when(masked | (F.col("opacity") != 1.0), F.col("opacity")).alias("mask_factor"),
        first_reason(
            missing_source=F.col("_source").isNull(),
            missing_mask=masked & F.col("_mask").isNull(),
            mask_size=masked & (F.col("_mask") != F.col("_source")),
        ).alias("reason"),
    )
