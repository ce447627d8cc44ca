"""Palettes of whole clips: exact or median cut, and nearest-colour mapping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomframe.functions.numeric import half_even
from loomframe.operators.ordered import attach
from loomframe.session import cut_lineage

RGB = ("r", "g", "b")


def quantize(pixels8: DataFrame, palette: DataFrame) -> DataFrame:
    """Index of the nearest palette colour of each pixel, the first one on ties.

    ``palette``: ``clip_id, idx, r, g, b``, at most 256 rows per clip. Distances are
    computed once per distinct colour of a frame, so that even a plain background is no
    key of more pixels than a frame has.
    """
    packed = palette.groupBy("clip_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", *RGB))).alias("_palette")
    )
    color = ["clip_id", "frame_idx", *RGB]
    colors = pixels8.select(*color).distinct()
    known = attach(colors, packed, ["clip_id"], F.struct("frame_idx", *RGB))

    def distance(entry: Column) -> Column:
        gaps = [F.col(c) - entry[c] for c in RGB]
        return sum((g * g for g in gaps), F.lit(0)).cast("bigint")

    best = F.array_min(
        F.transform("_palette", lambda e: F.struct(distance(e).alias("d"), e["idx"].alias("idx")))
    )
    mapped = known.select(*color, best["idx"].alias("palette_idx"))
    # Facts per colour can be as many as pixels, so they are not repeated over salts.
    return pixels8.join(mapped, color)


def quantize_frames(frames: DataFrame, palette: DataFrame) -> DataFrame:
    """The same on packed frames: ``indices`` holds one palette index per pixel.

    Only the palette of the clip travels to its frames; the pixels are not shuffled, and
    distances are computed once per distinct colour of a frame.
    """
    packed = palette.groupBy("clip_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("idx", *RGB))),
            lambda e: F.array(e["idx"], e["r"], e["g"], e["b"]),
        ).alias("_palette")
    )

    def nearest(rgba: pd.Series, tables: pd.Series) -> pd.Series:
        def one(values: np.ndarray, table: np.ndarray | None) -> np.ndarray | None:
            if table is None:
                return None
            known = np.stack([np.asarray(row, np.int64) for row in table])
            px = np.asarray(values, np.int64).reshape(-1, 4)[:, :3]
            colors, where = np.unique(px, axis=0, return_inverse=True)
            distance = (colors * colors).sum(1)[:, None] - 2 * colors @ known[:, 1:].T
            distance += (known[:, 1:] ** 2).sum(1)[None, :]
            return known[distance.argmin(1), 0][where.ravel()].astype(np.int32)

        return pd.Series([one(v, t) for v, t in zip(rgba, tables)], dtype=object)

    kernel = F.pandas_udf(nearest, ArrayType(IntegerType()))
    known = attach(frames, packed, ["clip_id"], F.col("frame_idx"))
    return known.withColumn("indices", kernel("rgba", "_palette")).drop("_palette")


def color_histogram(pixels8: DataFrame) -> DataFrame:
    return pixels8.groupBy("clip_id", *RGB).agg(F.count("*").alias("n"))


def median_cut(histogram: DataFrame, colors: int) -> DataFrame:
    """Split the widest boxes near their weighted middle until there are ``colors``.

    ``histogram`` has all colours of a clip with their counts. Per round, box facts and the
    sums along a box's longest axis (at most 256 values) are aggregated, the cut is found in
    those, and each colour moves by comparing its own value with the cut. So only rows per
    box or per box and value meet in one place, never the colours of a clip.
    """
    boxed = cut_lineage(histogram.withColumn("box", F.lit(0).cast("bigint")))
    box = ["clip_id", "box"]
    for _ in range(math.ceil(math.log2(colors)) if colors > 1 else 0):
        spans = [(F.max(c) - F.min(c)).alias(f"_s{c}") for c in RGB]
        facts = boxed.groupBy(*box).agg(*spans, F.sum("n").alias("_weight"))
        span = F.greatest("_sr", "_sg", "_sb")
        axis = F.when(F.col("_sg") == span, "g").when(F.col("_sr") == span, "r").otherwise("b")
        # Boxes are ranked per clip; only as many are split as colours are missing.
        clip = Window.partitionBy("clip_id")
        score = F.struct(-(F.col("_span") * F.col("_weight")), F.col("box"))
        ranked = facts.withColumns({"_span": span, "_axis": axis}).withColumns(
            {
                "_rank": F.row_number().over(clip.orderBy(score)),
                "_boxes": F.count("*").over(clip),
            }
        )
        split = (F.col("_span") > 0) & (F.col("_rank") <= colors - F.col("_boxes"))
        chosen = ranked.filter(split).select(*box, "_axis", "_weight")
        # Few boxes, many colours: the colours of a box are spread over salts.
        wide = attach(boxed, chosen, box, F.struct(*RGB))
        value = F.when(F.col("_axis") == "g", F.col("g")).when(F.col("_axis") == "r", F.col("r"))
        wide = wide.withColumn("_value", F.when(F.col("_axis").isNotNull(), F.coalesce(value, "b")))
        along = (
            wide.filter(F.col("_axis").isNotNull())
            .groupBy(*box, "_value")
            .agg(F.sum("n").alias("_n"), F.first("_weight").alias("_weight"))
        )
        order = Window.partitionBy(*box).orderBy("_value")
        before = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        # The last value always goes up, so that a heavy first one still splits off.
        cuts = (
            along.withColumn("_upper", F.when(before * 2 >= F.col("_weight"), F.col("_value")))
            .groupBy(*box)
            .agg(F.coalesce(F.min("_upper"), F.max("_value")).alias("_cut"))
        )
        above = F.coalesce((F.col("_value") >= F.col("_cut")).cast("int"), F.lit(0))
        moved = attach(wide, cuts, box, F.struct(*RGB))
        boxed = cut_lineage(moved.select("clip_id", *RGB, "n", (F.col("box") * 2 + above).alias("box")))
    mean = lambda c: half_even(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int")
    return boxed.groupBy(*box).agg(*[mean(c).alias(c) for c in RGB])


def global_palette(pixels8: DataFrame, colors: int = 256) -> DataFrame:
    """Palette per clip: all its colours when they fit, else a median cut of all of them."""
    if not 1 <= colors <= 256:
        raise ValueError("colors must be between 1 and 256")
    histogram = cut_lineage(color_histogram(pixels8))
    sizes = histogram.groupBy("clip_id").agg(F.count("*").alias("_size"))
    large = cut_lineage(sizes.filter(F.col("_size") > colors).select("clip_id", F.lit(True).alias("_large")))
    marked = attach(histogram, large, ["clip_id"], F.struct(*RGB))
    exact = marked.filter(F.col("_large").isNull()).select("clip_id", *RGB)
    if not large.isEmpty():
        rest = marked.filter(F.col("_large").isNotNull()).select("clip_id", *RGB, "n")
        exact = exact.unionByName(median_cut(rest, colors).select("clip_id", *RGB).distinct())
    order = Window.partitionBy("clip_id").orderBy(*RGB)
    return exact.select(
        "clip_id", (F.row_number().over(order) - 1).alias("idx"), *RGB
    )
