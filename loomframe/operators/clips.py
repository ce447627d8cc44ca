"""Clip reports over packed frame tables.

A frame row is ``(clip_id, frame_idx, width, height, duration_ms, rgba ARRAY<INT>)``
with ``frame_idx`` from 0 in every clip; a frame's predecessor is the one before it in
the clip, over gaps too. Work on single frames stays in the row;
only the step from one frame to the next needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from loomframe.functions.numeric import first_reason, half_even, required
from loomframe.operators.ordered import earliest_rows, exact_quantiles, id_block, running_sums
from loomframe.session import cut_lineage

FRAME_BLOCK = 256
#: Gaps at block edges whose frames are found without a shuffle.
FEW_GAPS = 100_000
#: Clips whose last frames are found without a shuffle.
FEW_CLIPS = 100_000
MOTION_PERCENTILES = {
    "motion_p25": 0.25,
    "motion_p50": 0.50,
    "motion_p75": 0.75,
    "motion_p90": 0.90,
    "motion_p95": 0.95,
    "motion_p99": 0.99,
}


# --- frames and pixels -----------------------------------------------------------------


def to_pixels(frames: DataFrame) -> DataFrame:
    """One row per pixel, row by row; channels keep the type of the packed values."""
    rows = frames.select(
        "clip_id",
        "frame_idx",
        "width",
        "rgba",
        F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("_p"),
    )
    return rows.select(
        "clip_id",
        "frame_idx",
        F.floor(F.col("_p") / F.col("width")).cast("int").alias("y"),
        (F.col("_p") % F.col("width")).alias("x"),
        *[F.get("rgba", F.col("_p") * 4 + i).alias(c) for i, c in enumerate("rgba")],
    )


def to_linear(pixels8: DataFrame) -> DataFrame:
    """Pixel table with channels in [0, 1]."""
    return pixels8.withColumns({c: F.col(c).cast("double") / 255.0 for c in "rgba"})


def to_frames(pixels: DataFrame) -> DataFrame:
    """Pack a pixel table into one row per frame, pixels in row order."""
    channels = F.array("r", "g", "b", "a")
    packed = pixels.groupBy("clip_id", "frame_idx").agg(
        (F.max("x") + 1).alias("width"),
        (F.max("y") + 1).alias("height"),
        F.array_sort(F.collect_list(F.struct("y", "x", channels.alias("c")))).alias("_p"),
    )
    return packed.select(
        "clip_id",
        "frame_idx",
        "width",
        "height",
        F.flatten(F.transform("_p", lambda p: p["c"])).alias("rgba"),
    )


# --- timing ----------------------------------------------------------------------------


def clip_timing(frames: DataFrame) -> DataFrame:
    summary = frames.groupBy("clip_id").agg(
        F.count("*").alias("frame_count"),
        F.sum(F.col("duration_ms").cast("bigint")).alias("total_ms"),
        F.min("duration_ms").alias("duration_min_ms"),
        F.max("duration_ms").alias("duration_max_ms"),
    )
    return summary.withColumns(
        {
            "effective_fps": F.lit(1000.0) / (F.col("total_ms") / F.col("frame_count")),
            "timing_is_uniform": F.col("duration_min_ms") == F.col("duration_max_ms"),
        }
    )


def duration_counts(frames: DataFrame) -> DataFrame:
    """Exact histogram as rows."""
    return frames.groupBy("clip_id", "duration_ms").agg(F.count("*").alias("n"))


def duration_histogram(frames: DataFrame) -> DataFrame:
    """Exact histogram as one sorted array per clip, built from the counted values."""
    return (
        duration_counts(frames)
        .groupBy("clip_id")
        .agg(
            F.array_sort(F.collect_list(F.struct(F.col("duration_ms").alias("ms"), "n"))).alias(
                "duration_histogram"
            )
        )
    )


def frame_timings(clips: DataFrame) -> DataFrame:
    """Frame start times and centisecond delays that add up to the clip exactly.

    Clips too short to give each frame one centisecond come back as one row with a
    ``reason``.
    """
    n = F.greatest(F.lit(1), half_even(F.col("total_s") * F.col("fps")).cast("bigint"))
    total_cs = half_even(F.col("total_s") * 100.0).cast("bigint")
    sized = clips.withColumns({"_n": n, "_cs": total_cs}).withColumn(
        "reason", F.when(F.col("_cs") < F.col("_n"), "too_short")
    )
    rows = sized.withColumn(
        "frame_idx",
        F.explode(
            F.when(
                F.col("reason").isNull(), F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
            ).otherwise(F.array(F.lit(None).cast("bigint")))
        ),
    )
    edge = lambda i: half_even(i * F.col("_cs") / F.col("_n")).cast("bigint")
    delay = edge(F.col("frame_idx") + 1) - edge(F.col("frame_idx"))
    return rows.select(
        *clips.columns,
        "frame_idx",
        (F.col("frame_idx") * F.col("total_s") / F.col("_n")).alias("timestamp_s"),
        (delay / 100.0).alias("duration_s"),
        delay.alias("delay_cs"),
        "reason",
    )


# --- motion ----------------------------------------------------------------------------


def _fits(rgba: np.ndarray) -> bool:
    """Whether an array can be the pixels of a frame."""
    return len(rgba) > 0 and len(rgba) % 4 == 0


def _channel_difference(current: Column, before: Column, channels: int) -> Column:
    """Mean absolute difference of two packed RGBA frames over the first channels.

    Null for a missing frame and for frames of different sizes.

    The dense arrays are compared in Arrow batches, which is faster than array functions
    that visit every element on its own.
    """

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        def gap(p: np.ndarray | None, q: np.ndarray | None) -> float | None:
            if p is None or q is None or len(p) != len(q) or not _fits(p):
                return None
            apart = np.asarray(p, np.int64) - np.asarray(q, np.int64)
            seen = np.abs(apart.reshape(-1, 4)[:, :channels])
            return int(seen.sum()) / seen.size

        return pd.Series([gap(p, q) for p, q in zip(left, right)], dtype="float64")

    return F.pandas_udf(run, DoubleType())(current, before)


def _block() -> Column:
    return F.floor(F.col("frame_idx") / F.lit(FRAME_BLOCK))


def _edges_over_gaps(frames: DataFrame) -> DataFrame:
    """Last frames of blocks that are not at the block's edge, and the next block with frames.

    Only ``clip_id`` and ``frame_idx`` are read; without gaps at block edges there are none.
    """
    lasts = frames.groupBy("clip_id", _block().alias("_block")).agg(F.max("frame_idx").alias("frame_idx"))
    by_clip = Window.partitionBy("clip_id").orderBy("_block")
    return lasts.select(
        "clip_id", "frame_idx", F.lead("_block").over(by_clip).alias("_next")
    ).filter(F.col("_next").isNotNull() & (F.col("frame_idx") != F.col("_next") * FRAME_BLOCK - 1))


def _with_halo(frames: DataFrame) -> DataFrame:
    """Frames by blocks of ``FRAME_BLOCK`` positions; the last frame of each block is
    sent to the next block that has frames too."""
    is_edge = F.col("frame_idx") % FRAME_BLOCK == FRAME_BLOCK - 1
    blocks = F.when(is_edge, F.array(_block(), _block() + 1)).otherwise(F.array(_block()))
    halo = frames.withColumn("_block", F.explode(blocks))
    gaps = cut_lineage(_edges_over_gaps(frames))
    count = gaps.count()
    if not count:
        return halo
    few = F.broadcast(gaps) if count <= FEW_GAPS else gaps
    sent = frames.join(few, ["clip_id", "frame_idx"]).withColumnRenamed("_next", "_block")
    return halo.unionByName(sent)


def with_previous_frame(frames: DataFrame) -> DataFrame:
    """Add the frame before, in one shuffle and without one task per clip."""
    return _paired(frames).drop("_block", "_follows")


def _paired(frames: DataFrame) -> DataFrame:
    window = Window.partitionBy("clip_id", "_block").orderBy("frame_idx")
    return (
        _with_halo(frames)
        .withColumns(
            {
                "previous_rgba": F.lag("rgba").over(window),
                "_follows": F.lag(F.lit(True)).over(window),
            }
        )
        .filter(F.col("_block") == _block())
    )


def frame_motion(frames: DataFrame, channels: int = 3) -> DataFrame:
    """Mean absolute channel difference to the previous frame, from frame 1 on.

    Frames without pixels or of another size than the one before have the reason
    ``frame_shape`` and no figure.

    The pixels are visited by an explode and a sum in the same stage as the pairing;
    its grouping follows the partitioning, so there is no second shuffle.
    """
    pairs = _paired(frames.select("clip_id", "frame_idx", "rgba")).filter("_follows")
    count = F.floor(F.array_size("rgba") / F.lit(4)).cast("int")
    whole = (F.array_size("rgba") % 4 == 0) & (count > 0)
    fits = F.coalesce((F.array_size("rgba") == F.array_size("previous_rgba")) & whole, F.lit(False))
    # A pair that does not fit stays as one row without pixels.
    places = F.when(fits, F.sequence(F.lit(0), count - 1)).otherwise(F.array(F.lit(None).cast("int")))
    pixels = pairs.withColumn("_p", F.explode(places))
    gap = F.lit(0)
    for c in range(channels):
        at = F.col("_p") * 4 + c
        gap = gap + F.abs(F.get("rgba", at) - F.get("previous_rgba", at))
    sums = pixels.groupBy("clip_id", "_block", "frame_idx").agg(
        F.sum(gap).alias("_gap"), F.count("*").alias("_n")
    )
    motion = F.col("_gap") / (F.col("_n") * float(channels))
    return sums.select(
        "clip_id",
        "frame_idx",
        motion.alias("motion"),
        F.when(motion.isNull(), "frame_shape").alias("reason"),
    )


def motion_stats(motion: DataFrame, clips: DataFrame) -> DataFrame:
    """Mean, maximum and exact percentiles per clip; 0.0 for single-frame clips."""
    stats = exact_quantiles(
        motion,
        ["clip_id"],
        "motion",
        MOTION_PERCENTILES,
        1 / 16,
        mean="motion_mean",
        largest="motion_max",
    )
    names = ["motion_mean", "motion_max", *MOTION_PERCENTILES]
    joined = clips.select("clip_id").join(stats, "clip_id", "left")
    return joined.select("clip_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def first_last_difference(frames: DataFrame) -> DataFrame:
    """Difference of the first and the last frame (how well a loop closes).

    Null if one of them has no whole pixels or they differ in size.
    """
    ends = cut_lineage(frames.groupBy("clip_id").agg(F.max("frame_idx").alias("frame_idx")))
    narrow = frames.select("clip_id", "frame_idx", "rgba")
    # With few clips the frames stay where they are and only two of each move on.
    few = F.broadcast(ends) if ends.count() <= FEW_CLIPS else ends
    last = narrow.join(few, ["clip_id", "frame_idx"]).select(
        "clip_id", F.col("rgba").alias("last_rgba")
    )
    first = narrow.filter(F.col("frame_idx") == 0).select("clip_id", "rgba")
    return first.join(last, "clip_id").select(
        "clip_id",
        _channel_difference(F.col("rgba"), F.col("last_rgba"), 3).alias("first_last_difference"),
    )


def corner_color(frames: DataFrame) -> DataFrame:
    """Mean of the four corners of the first frame, half-even."""
    w, h = F.col("width"), F.col("height")
    spots = [F.lit(0), w - 1, (h - 1) * w, h * w - 1]

    def mean(channel: int) -> Column:
        total = sum((F.get("rgba", 4 * p + channel) for p in spots), F.lit(0))
        return half_even(total / F.lit(4)).cast("int")

    return frames.filter(F.col("frame_idx") == 0).select(
        "clip_id", *[mean(i).alias(f"corner_{c}") for i, c in enumerate("rgb")]
    )


def _palette_size() -> Column:
    """Number of distinct colours of a packed frame, alpha left out."""

    def run(frames: pd.Series) -> pd.Series:
        def count(rgba: np.ndarray | None) -> int | None:
            if rgba is None or not _fits(rgba):
                return None
            px = np.asarray(rgba, np.int64).reshape(-1, 4)
            return len(np.unique(px[:, 0] * 65536 + px[:, 1] * 256 + px[:, 2]))

        return pd.Series([count(v) for v in frames], dtype="Int64")

    return F.pandas_udf(run, LongType())("rgba")


def palette_cardinality(frames: DataFrame) -> DataFrame:
    """Number of distinct RGB colours per frame, counted inside the row.

    Null for frames whose array is missing, empty or not made of whole pixels.
    """
    return frames.select("clip_id", "frame_idx", _palette_size().alias("palette_colors"))


def max_palette(frames: DataFrame) -> DataFrame:
    return (
        palette_cardinality(frames)
        .groupBy("clip_id")
        .agg(F.max("palette_colors").alias("max_palette_colors"))
    )


def temporal_gate(frames: DataFrame, factor: float = 4.0, channels: int = 4) -> DataFrame:
    """Pass or fail for sudden jumps, with the first spike of failed clips."""
    # Two aggregates read the motion; the frames behind it should be shuffled once.
    motion = cut_lineage(frame_motion(frames, channels))
    peaks = motion.groupBy("clip_id").agg(
        F.max("motion").alias("max_diff"),
        F.max(F.struct("motion", -F.col("frame_idx"))).alias("_peak"),
    )
    medians = exact_quantiles(motion, ["clip_id"], "motion", {"median_diff": 0.5}, 1 / 16)
    clips = frames.select("clip_id").distinct()
    joined = clips.join(peaks, "clip_id", "left").join(medians, "clip_id", "left")
    top = F.coalesce("max_diff", F.lit(0.0))
    middle = F.coalesce("median_diff", F.lit(0.0))
    passed = top <= F.greatest(F.lit(1.0), middle * factor + 8.0)
    return joined.select(
        "clip_id",
        passed.alias("passed"),
        top.alias("max_diff"),
        middle.alias("median_diff"),
        F.when(~passed, -F.col("_peak").getField("col2")).alias("spike_index"),
    )


def alpha_bounds(pixels: DataFrame, threshold: float = 1e-3) -> DataFrame:
    """Half-open box of the visible pixels per frame; nulls when there are none."""
    seen = lambda c: F.when(F.col("a") > threshold, F.col(c))
    return pixels.groupBy("clip_id", "frame_idx").agg(
        F.min(seen("x")).alias("x0"),
        F.min(seen("y")).alias("y0"),
        (F.max(seen("x")) + 1).alias("x1"),
        (F.max(seen("y")) + 1).alias("y1"),
    )


# --- budgets and the full report ---------------------------------------------------------


@dataclass(frozen=True)
class DecodeLimits:
    max_input_bytes: int = 20 * 1024 * 1024
    max_canvas_pixels: int = 16_777_216
    max_frames: int = 1_000
    max_total_pixels: int = 100_000_000


def decode_budget(
    frames: DataFrame, files: DataFrame, limits: DecodeLimits = DecodeLimits()
) -> DataFrame:
    """First broken decode limit of each clip, and the frame that broke it."""
    area = F.col("width").cast("bigint") * F.col("height")
    narrow = frames.select("clip_id", "frame_idx", "duration_ms", area.alias("area"))
    totals = running_sums(
        narrow, ["clip_id"], ["frame_idx"], id_block("frame_idx", 4096), {"pixels": F.col("area")}
    )
    broken = totals.withColumn(
        "reason",
        first_reason(
            frame_limit=F.col("frame_idx") >= limits.max_frames,
            frame_duration=F.coalesce(F.col("duration_ms") <= 0, F.lit(True)),
            pixel_budget=F.col("pixels") > limits.max_total_pixels,
        ),
    ).filter(F.col("reason").isNotNull())
    breaches = earliest_rows(
        broken.select("clip_id", "frame_idx", "reason"), ["clip_id"], ["frame_idx"]
    )
    canvas = narrow.groupBy("clip_id").agg(F.max("area").alias("canvas"))
    verdict = files.join(canvas, "clip_id", "left").join(breaches, "clip_id", "left")
    at_open = first_reason(
        empty_input=required(F.col("size_bytes") <= 0),
        input_bytes=required(F.col("size_bytes") > limits.max_input_bytes),
        no_frames=F.col("canvas").isNull(),
        canvas_limit=F.col("canvas") > limits.max_canvas_pixels,
    )
    return verdict.select(
        "clip_id",
        F.coalesce(at_open, F.col("reason")).alias("reason"),
        F.when(at_open.isNull(), F.col("frame_idx")).alias("breach_frame"),
    )


def frame_facts(frames: DataFrame) -> DataFrame:
    """Everything the report needs from the pixels, in one shuffle of the frames.

    Pixels are kept only of the first frame and of the last frame of each block; all
    other columns are narrow.
    """
    window = Window.partitionBy("clip_id", "_block").orderBy("frame_idx")
    halo = _with_halo(frames)
    seen = halo.withColumns(
        {
            "_before": F.lag("rgba").over(window),
            "_last": F.lead("frame_idx").over(window).isNull(),
        }
    ).filter(F.col("_block") == _block())
    keep = F.col("_last") | (F.col("frame_idx") == 0)
    return seen.select(
        "clip_id",
        "frame_idx",
        "width",
        "height",
        "duration_ms",
        _channel_difference(F.col("rgba"), F.col("_before"), 3).alias("motion"),
        _palette_size().alias("palette_colors"),
        F.coalesce(
            F.array_size("rgba") == 4 * F.col("width") * F.col("height"), F.lit(False)
        ).alias("whole"),
        F.when(keep, F.col("rgba")).alias("rgba"),
    )


def _quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array; null if it is empty."""
    place = F.lit(float(p)) * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    at = lambda i: F.get(ordered, F.least(i, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, at(low) + (at(low + 1) - at(low)) * (place - low))


def _clip_facts(facts: DataFrame, limits: DecodeLimits) -> DataFrame:
    """All figures of a clip's frames from one aggregate.

    Frames behind the frame limit are counted only, so what is gathered per clip is as
    long as the limit allows; beyond it a clip has no figures anyway.
    """
    at, area = F.col("frame_idx"), F.col("width").cast("bigint") * F.col("height")
    first = at == 0
    entry = F.struct("frame_idx", "duration_ms", area.alias("area"), "motion", "palette_colors")
    grouped = facts.groupBy("clip_id").agg(
        F.count("*").alias("frame_count"),
        F.sum(F.col("duration_ms").cast("bigint")).alias("total_ms"),
        F.min("duration_ms").alias("duration_min_ms"),
        F.max("duration_ms").alias("duration_max_ms"),
        F.max("palette_colors").alias("max_palette_colors"),
        F.max(F.when(first, F.col("width"))).alias("width"),
        F.max(F.when(first, F.col("height"))).alias("height"),
        (
            F.bool_and("whole")
            & (F.min("width") == F.max("width"))
            & (F.min("height") == F.max("height"))
        ).alias("_whole"),
        F.max(area).alias("_canvas"),
        F.min(F.when(at >= limits.max_frames, at)).alias("_beyond"),
        F.min(F.when(F.coalesce(F.col("duration_ms") <= 0, F.lit(True)), at)).alias("_bad_duration"),
        F.sort_array(F.collect_list(F.when(at < limits.max_frames, entry))).alias("_series"),
        F.max_by("rgba", F.when(first, 1)).alias("_first"),
        F.max_by("rgba", "frame_idx").alias("_last"),
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast(facts.schema["frame_idx"].dataType).alias("at"))

    def add(state: Column, e: Column) -> Column:
        total = state["sum"] + F.coalesce(e["area"], F.lit(0))
        full = F.when(total > limits.max_total_pixels, e["frame_idx"])
        return F.struct(total.alias("sum"), F.coalesce(state["at"], full).alias("at"))

    motions = F.filter(F.transform("_series", lambda e: e["motion"]), lambda m: m.isNotNull())
    placed = grouped.withColumns(
        {
            "_full": F.aggregate("_series", zero, add)["at"],
            "frame_motion": motions,
            "frame_palette_colors": F.transform("_series", lambda e: e["palette_colors"]),
            "_durations": F.transform("_series", lambda e: e["duration_ms"]),
        }
    ).withColumn("_ordered", F.sort_array("frame_motion"))
    spots = [F.lit(0), F.col("width") - 1, (F.col("height") - 1) * F.col("width"), F.col("height") * F.col("width") - 1]
    corner = lambda c: half_even(sum((F.get("_first", 4 * p + c) for p in spots), F.lit(0)) / F.lit(4)).cast("int")
    count = lambda ms: F.size(F.filter("_durations", lambda d: d == ms)).cast("bigint")
    zero_if_none = lambda c: F.coalesce(c, F.lit(0.0))
    mean = F.aggregate("frame_motion", F.lit(0.0), lambda s, m: s + m) / F.nullif(F.size("frame_motion"), F.lit(0))
    return placed.withColumns(
        {
            "effective_fps": F.lit(1000.0) / (F.col("total_ms") / F.col("frame_count")),
            "timing_is_uniform": F.col("duration_min_ms") == F.col("duration_max_ms"),
            "motion_mean": zero_if_none(mean),
            "motion_max": zero_if_none(F.array_max("frame_motion")),
            **{n: zero_if_none(_quantile(F.col("_ordered"), p)) for n, p in MOTION_PERCENTILES.items()},
            "first_last_difference": _channel_difference(F.col("_first"), F.col("_last"), 3),
            **{f"corner_{c}": corner(i) for i, c in enumerate("rgb")},
            "duration_histogram": F.transform(
                F.array_sort(F.array_distinct(F.filter("_durations", lambda d: d.isNotNull()))),
                lambda ms: F.struct(ms.alias("ms"), count(ms).alias("n")),
            ),
        }
    ).drop("_series", "_first", "_last", "_durations", "_ordered")


def analyze_clips(
    frames: DataFrame, files: DataFrame, limits: DecodeLimits = DecodeLimits()
) -> DataFrame:
    """Full report per clip; clips over a limit get their reason and no figures.

    So do clips with a frame whose pixels do not fill it, or of another size than the
    first (``frame_shape``). ``files`` may have the header's ``loop_count``. The arrays of
    motion and palette sizes have at most as many entries as the frame limit allows.

    The frames are read and shuffled once, into narrow facts per frame; those are
    written to the checkpoint folder, and one aggregate per clip gives all figures.
    """
    facts = cut_lineage(frame_facts(frames))
    report = files.join(_clip_facts(facts, limits), "clip_id", "left")
    at_open = first_reason(
        empty_input=required(F.col("size_bytes") <= 0),
        input_bytes=required(F.col("size_bytes") > limits.max_input_bytes),
        no_frames=F.col("_canvas").isNull(),
        canvas_limit=F.col("_canvas") > limits.max_canvas_pixels,
    )
    # Of several limits broken by one frame the first one counts.
    breach = F.least("_beyond", "_bad_duration", "_full")
    broken = first_reason(
        frame_limit=F.col("_beyond") == breach,
        frame_duration=F.col("_bad_duration") == breach,
        pixel_budget=F.col("_full") == breach,
    )
    report = report.withColumns(
        {"reason": F.coalesce(at_open, broken), "breach_frame": F.when(at_open.isNull(), breach)}
    )
    if "loop_count" not in files.columns:
        report = report.withColumn("loop_count", F.lit(None).cast("int"))
    shape = F.when(~F.coalesce("_whole", F.lit(True)), "frame_shape")
    report = report.withColumn("reason", F.coalesce("reason", shape))
    figures = [
        "width",
        "height",
        "frame_count",
        "total_ms",
        "effective_fps",
        "loop_count",
        "frame_motion",
        "frame_palette_colors",
        "motion_mean",
        "motion_max",
        *MOTION_PERCENTILES,
        "first_last_difference",
        "corner_r",
        "corner_g",
        "corner_b",
        "max_palette_colors",
        "duration_min_ms",
        "duration_max_ms",
        "duration_histogram",
        "timing_is_uniform",
    ]
    keep = F.col("reason").isNull()
    return report.select(
        "clip_id",
        F.lit(1).alias("schema_version"),
        "size_bytes",
        "reason",
        "breach_frame",
        *[F.when(keep, F.col(c)).alias(c) for c in figures],
        F.when(keep, F.lit(True)).alias("corner_color_is_heuristic"),
    )


def frame_series(frames: DataFrame) -> DataFrame:
    """Per-frame motion and palette size, the two long arrays of the report as rows."""
    return palette_cardinality(frames).join(
        frame_motion(frames), ["clip_id", "frame_idx"], "left"
    )
