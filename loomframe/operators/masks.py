"""Mask tables ``(mask_id, y, x, m)``: blur, state processing and selective application."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import color
from loomframe.functions.numeric import clamp
from loomframe.operators.ordered import attach

CELL = ["clip_id", "frame_idx", "y", "x"]
# Defaults of a mask state.
STATE_FIELDS = (
    "enabled BOOLEAN, inverted BOOLEAN, opacity DOUBLE, feather_radius DOUBLE, "
    "blur_radius DOUBLE, levels_low DOUBLE, levels_high DOUBLE, threshold DOUBLE"
)


def mask_from_alpha(px: DataFrame) -> DataFrame:
    return px.select(*CELL, F.col("a").alias("m"))


def mask_from_luminance(px: DataFrame) -> DataFrame:
    luma = color.luminance(F.col("r"), F.col("g"), F.col("b"))
    return px.select(*CELL, clamp(luma, 0.0, 1.0).alias("m"))


def _blur_axis(rows: DataFrame, line: str, along: str, radius: str) -> DataFrame:
    """Edge-padded mean of ``2 * radius + 1`` cells along one axis, with a radius per row.

    A running sum per line is packed once, so each cell costs two lookups whatever the
    radius is. A line is at most one canvas side long.
    """
    line_window = (
        Window.partitionBy("mask_id", line)
        .orderBy(along)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    summed = rows.withColumn("_sum", F.sum("m").over(line_window))
    others = [c for c in rows.columns if c not in ("mask_id", line, along, "m")]
    packed = summed.groupBy("mask_id", line).agg(
        F.array_sort(F.collect_list(F.struct(along, "_sum", "m", *others))).alias("_line")
    )
    n = F.size("_line")
    edge = lambda i: F.least(F.greatest(i, F.lit(0)), n - 1)
    at = lambda i: F.get("_line", i)

    def mean(cell: Column) -> Column:
        low, high = cell[along] - cell[radius], cell[along] + cell[radius]
        inner = at(edge(high))["_sum"] - F.when(low > 0, at(edge(low - 1))["_sum"]).otherwise(
            F.lit(0.0)
        )
        left = F.greatest(-low, F.lit(0)) * at(F.lit(0))["m"]
        right = F.greatest(high - (n - 1), F.lit(0)) * at(n - 1)["m"]
        return (inner + left + right) / (2 * cell[radius] + 1)

    blurred = F.transform(
        "_line",
        lambda cell: F.struct(
            cell[along].alias(along),
            F.when(cell[radius] > 0, mean(cell)).otherwise(cell["m"]).alias("m"),
            *[cell[c].alias(c) for c in others],
        ),
    )
    return packed.select("mask_id", line, F.inline(blurred)).select(*rows.columns)


def _limits(masks: DataFrame) -> DataFrame:
    """Longest side of each mask, less one; no blur reaches farther."""
    return masks.groupBy("mask_id").agg(F.greatest(F.max("x"), F.max("y")).cast("bigint").alias("_limit"))


def _blurred(cells: DataFrame, radii: Sequence[Column]) -> DataFrame:
    """Blurs of several radii, one after the other; ``cells`` have their mask's ``_limit``.

    Passes along x and along y may change places, so all passes along x are done on
    the lines of x and then all others: the cells are dealt out twice in all, by lines,
    and a mask is spread over as many tasks as it has lines.
    """
    names = [f"_r{i}" for i in range(len(radii))]
    reach = lambda r: F.least(F.ceil(r), F.col("_limit")).cast("int")
    rows = cells.withColumns({n: reach(r) for n, r in zip(names, radii)}).drop("_limit")
    for line, along in (("y", "x"), ("x", "y")):
        rows = rows.repartition("mask_id", line)
        for name in names:
            rows = _blur_axis(rows, line, along, name)
    return rows.drop(*names)


def box_blur(masks: DataFrame, *radii: Column) -> DataFrame:
    """Box blur along x and y; each radius is rounded up and kept inside the mask."""
    cells = attach(masks, _limits(masks), ["mask_id"], F.struct("y", "x"))
    return _blurred(cells, radii)


def process_mask(masks: DataFrame, states: DataFrame) -> DataFrame:
    """Apply one state per mask: feather, blur, levels, threshold, invert, opacity.

    A disabled state gives a mask of ones.
    """
    names = [field.split()[0] for field in STATE_FIELDS.split(", ")]
    known = states.select("mask_id", *names).join(_limits(masks), "mask_id")
    joined = attach(masks, known, ["mask_id"], F.struct("y", "x"), how="inner")
    soft = _blurred(joined, [F.col("feather_radius"), F.col("blur_radius")])
    level = clamp(
        (F.col("m") - F.col("levels_low")) / (F.col("levels_high") - F.col("levels_low")), 0.0, 1.0
    )
    value = F.when(F.col("threshold").isNull(), level).otherwise(
        F.when(level < F.col("threshold"), F.lit(0.0)).otherwise(F.lit(1.0))
    )
    value = F.when(F.col("inverted"), 1.0 - value).otherwise(value) * F.col("opacity")
    return soft.select(
        "mask_id", "y", "x", F.when(F.col("enabled"), value).otherwise(F.lit(1.0)).alias("m")
    )


def selective(
    px: DataFrame, transform: Callable[[DataFrame], DataFrame], masks: DataFrame
) -> DataFrame:
    """Mix the original and the transformed pixels by a mask of the same cells.

    The transform must keep the cells; it sees its own channels and the originals ride
    along in the same row, so nothing is joined but the mask.
    """
    kept = px.withColumn("_original", F.struct("r", "g", "b", "a"))
    done = transform(kept)
    masked = done.join(masks.select(*CELL, F.col("m").alias("_m")), CELL, "left")
    mixed = {
        c: F.col(f"_original.{c}") * (1.0 - F.col("_m")) + F.col(c) * F.col("_m") for c in "rgba"
    }
    return masked.select(
        *CELL,
        *[v.alias(c) for c, v in mixed.items()],
        F.when(F.col("_m").isNull(), "mask_shape").alias("reason"),
    )
