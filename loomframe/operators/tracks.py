"""Keyframe tracks sampled at many times, motion paths and smoothed crop tracks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomframe.functions import easing
from loomframe.functions.numeric import clamp
from loomframe.operators import blending, clips, geometry
from loomframe.operators.folds import sorted_runs
from loomframe.session import cut_lineage

MAX_OFFSET = 24.0


def key_violations(keys: DataFrame) -> DataFrame:
    """Tracks whose keys are too few, repeated in time or not finite."""
    bad = F.col("t").isNull() | F.isnan("t") | (F.abs("t") == float("inf"))
    per_time = keys.groupBy("track_id", "t").agg(
        F.count("*").alias("_n"), F.count_if(bad).alias("_bad")
    )
    return (
        per_time.groupBy("track_id")
        .agg(
            (F.sum("_n") < 2).alias("too_few"),
            (F.max("_n") > 1).alias("repeated_time"),
            (F.sum("_bad") > 0).alias("not_finite"),
        )
        .filter(F.col("too_few") | F.col("repeated_time") | F.col("not_finite"))
    )


def _nearest(kind: int, count: int):
    """Arrow pass over rows sorted by track: the latest key that the stream has met.

    Adds the key and how many keys of the track were met, both in this partition. Columns:
    the track first, the kind of row at ``kind``, the key behind it, then ``count`` in all.
    Of the rows before a batch only the last key and the number of keys are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, track, seen = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            is_key = batch.column(kind).to_numpy() == 1
            first = np.r_[True, ids[1:] != ids[:-1]]
            start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            at = np.maximum.accumulate(np.where(is_key, np.arange(n), -1))
            keys = np.cumsum(is_key)
            met = keys - (keys[start] - is_key[start])
            goes_on = (start == 0) & (ids[0] == track)
            met = met + np.where(goes_on, seen, 0)
            # Place 0 is the key held from earlier batches; the others follow.
            found = at >= start
            place = np.where(found, at + 1, 0)
            known = found | (goes_on & (held is not None))
            rows = batch.column(kind + 1)
            source = pa.concat_arrays([pa.array([held], rows.type), rows])
            nearest = source.take(pa.array(place, pa.int64(), mask=~known))
            held, track, seen = nearest[n - 1].as_py(), ids[-1], int(met[-1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, nearest, pa.array(met, pa.int64())],
                [f"c{i}" for i in range(count + 2)],
            )

    return run


def segment_lookup(
    samples: DataFrame, keys: DataFrame, block_width: float = 300.0
) -> DataFrame:
    """Neighbouring keys of each sample time.

    Adds ``before`` and ``after`` (structs of the key), ``u`` in [0, 1] and ``clamped``
    (the value to use unchanged, when the sample is at or beyond an end). A sample on an inner
    key belongs to the segment before it.

    Keys and samples are dealt out together in ranges of track and time, so a track spans as
    many tasks as it fills, and are merged in two local passes, one in each direction. Of
    what lies in other ranges only the tracks cut by a border matter: two per range at most,
    whose outer keys are sent to all. ``block_width`` is of no use any more.
    """
    key = F.struct(*[c for c in keys.columns if c != "track_id"])
    payload = F.struct(*[c for c in samples.columns if c != "track_id"])
    merged = samples.select(
        "track_id", "t", payload.alias("_sample"), F.lit(0).alias("_kind"),
    ).unionByName(
        keys.select("track_id", "t", F.lit(1).alias("_kind"), key.alias("_key")),
        allowMissingColumns=True,
    )
    order = [F.col(c) for c in ("track_id", "t", "_kind")]
    dealt = merged.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kinds = [f.dataType for f in dealt.select("track_id", "t", "_part", "_sample", "_kind", "_key").schema]

    def passed(rows: DataFrame, count: int) -> DataFrame:
        """``count`` columns, of which those behind the first six are an earlier pass's."""
        types = [*kinds, *[kinds[-1], LongType()] * 2][: count + 2]
        fields = [StructField(f"c{i}", t) for i, t in enumerate(types)]
        return rows.mapInArrow(_nearest(4, count), StructType(fields))

    ahead = dealt.sortWithinPartitions(*order).select("track_id", "t", "_part", "_sample", "_kind", "_key")
    once = passed(ahead, 6)
    back = passed(once.sortWithinPartitions(F.desc("c0"), F.desc("c1"), F.desc("c4")), 8)
    looked = cut_lineage(back.toDF("track_id", "t", "_part", "_sample", "_kind", "_key", "before", "_n", "after", "_later"))
    # First and last key of every track in every range, then of the ranges around it.
    when_key = F.when(F.col("_kind") == 1, F.struct("t", F.col("_key")))
    spans = looked.groupBy("track_id", "_part").agg(
        F.min_by("_key", F.when(F.col("_kind") == 1, F.col("t"))).alias("_first"),
        F.max_by("_key", F.when(F.col("_kind") == 1, F.col("t"))).alias("_last"),
        F.count(when_key).alias("_keys"),
    )
    by_track = Window.partitionBy("track_id").orderBy("_part")
    earlier = by_track.rowsBetween(Window.unboundedPreceding, -1)
    later = by_track.rowsBetween(1, Window.unboundedFollowing)
    cut = spans.select(
        "track_id",
        "_part",
        F.last("_last", ignorenulls=True).over(earlier).alias("_before"),
        F.first("_first", ignorenulls=True).over(later).alias("_after"),
        F.coalesce(F.sum("_keys").over(later), F.lit(0)).alias("_behind"),
    ).filter(F.col("_before").isNotNull() | F.col("_after").isNotNull())
    # Two rows per range at most.
    rows = looked.filter(F.col("_kind") == 0).join(F.broadcast(cut), ["track_id", "_part"], "left")
    b, a = F.coalesce("before", "_before"), F.coalesce("after", "_after")
    last_key = F.col("_later") + F.coalesce("_behind", F.lit(0)) <= 1
    placed = rows.select("track_id", "_sample.*", b.alias("before"), a.alias("after"), last_key.alias("_is_last"))
    b, a = F.col("before"), F.col("after")
    at_end = a.isNull() | (F.col("_is_last") & (F.col("t") >= a["t"]))
    clamped = F.when(b.isNull(), a["v"]).when(at_end, F.coalesce(a["v"], b["v"]))
    inside = b.isNotNull() & a.isNotNull()
    return placed.withColumns(
        {"clamped": clamped, "u": F.when(inside, (F.col("t") - b["t"]) / (a["t"] - b["t"]))}
    ).drop("_is_last")


def sample_curve(
    samples: DataFrame,
    keys: DataFrame,
    loop_mode: str = "loop",
    interpolator: str = "linear",
    rotation_mode: str = "shortest",
    turns: float = 0.0,
    block_width: float = 1.0 / 4096,
) -> DataFrame:
    """Scalar curve at many parameters ``t``; the result is in ``value``.

    ``keys``: ``track_id, t, v`` and, for the Bezier interpolator, ``controls``
    ARRAY<DOUBLE> of four (null falls back to linear).
    """
    mapped = samples.withColumns(
        {"_tau": F.col("t"), "t": easing.map_tau(F.col("t"), loop_mode)}
    )
    found = segment_lookup(mapped, keys, block_width)
    u, first, second = F.col("u"), F.col("before"), F.col("after")
    if interpolator == "harmonic":
        factor = easing.harmonic(u)
    elif interpolator == "cubic_bezier":
        c = [F.get(first["controls"], i) for i in range(4)]
        factor = F.when(first["controls"].isNull(), u).otherwise(easing.bezier_ease(u, *c))
    else:
        factor = u
    value = first["v"] + factor * easing.rotation_delta(
        first["v"], second["v"], rotation_mode, turns
    )
    if rotation_mode == "shortest":
        value = F.pmod(value, F.lit(360.0))
    kept = [c for c in samples.columns if c not in ("track_id", "t")]
    return found.select(
        "track_id",
        F.col("_tau").alias("t"),
        *kept,
        F.coalesce("clamped", value).alias("value"),
    )


def _sample_vectors(
    samples: DataFrame, keys: DataFrame, factor: Column, block_width: float
) -> DataFrame:
    found = segment_lookup(samples, keys, block_width)
    mixed = F.zip_with(
        F.col("before.v"), F.col("after.v"), lambda a, b: a + factor * (b - a)
    )
    return found.select(*samples.columns, F.coalesce("clamped", mixed).alias("value"))


def sample_affine(samples: DataFrame, keys: DataFrame, block_width: float = 300.0) -> DataFrame:
    """Affine matrices (ARRAY<DOUBLE>) between keys, element by element."""
    return _sample_vectors(samples, keys, F.col("u"), block_width)


def sample_motion(samples: DataFrame, keys: DataFrame, block_width: float = 300.0) -> DataFrame:
    """Position, target and roll vectors between keys, with eased ends."""
    return _sample_vectors(samples, keys, easing.smoothstep(F.col("u")), block_width)


def motion_path(timed: DataFrame, style: str, amount: float) -> DataFrame:
    """Offset per frame from ``t, duration_s, free_x, free_y`` (free room in pixels)."""
    if not 0.0 <= amount <= MAX_OFFSET:
        raise ValueError(f"amount must be between 0 and {MAX_OFFSET}")
    share = F.col("t") / F.greatest(F.col("duration_s"), F.lit(0.1))
    if style == "float":
        dx = F.col("free_x") / 2 + amount * F.sin(2.0 * math.pi * share)
        dy = F.col("free_y") / 2 + amount * F.cos(2.0 * math.pi * share)
    elif style == "pan":
        dx, dy = F.col("free_x") * share, F.col("free_y") * (1.0 - share)
    else:
        dx, dy = F.col("free_x") / 2, F.col("free_y") / 2
    return timed.withColumns({"offset_x": dx, "offset_y": dy})


# --- smoothed crop tracks ------------------------------------------------------------------


def _one_euro(
    min_cutoff: float, beta: float, d_cutoff: float
):
    """Fold of one partition sorted by track and time; state is one small tuple."""

    def weight(dt: float, cutoff: float) -> float:
        r = 2.0 * math.pi * cutoff * dt
        return r / (r + 1.0)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        track, last_t, pos, speed = None, 0.0, [0.0, 0.0], [0.0, 0.0]
        for batch in batches:
            smooth_x, smooth_y = [], []
            for key, t, x, y in zip(
                batch["track_id"], batch["t"], batch["target_x"], batch["target_y"]
            ):
                if key != track:
                    track, pos, speed = key, [x, y], [0.0, 0.0]
                else:
                    dt = max(1e-6, t - last_t)
                    for i, target in enumerate((x, y)):
                        gap = target - pos[i]
                        speed[i] += weight(dt, d_cutoff) * (gap / dt - speed[i])
                        pos[i] += weight(dt, min_cutoff + beta * abs(speed[i])) * gap
                last_t = t
                smooth_x.append(pos[0])
                smooth_y.append(pos[1])
            yield batch.assign(smooth_x=smooth_x, smooth_y=smooth_y)

    return fold


def smooth_track(
    points: DataFrame, min_cutoff: float = 0.5, beta: float = 0.05, order: Sequence[str] = ("t",)
) -> DataFrame:
    """Smoothed centre and square crop box per point of each track.

    ``points``: ``track_id, t, width, height, center_x, center_y, confidence`` and
    ``strategy``. The filter is recursive, so a track is read in time order; rows are
    streamed in sorted Arrow batches and only the last state is kept, however long a
    track is.
    """
    unsure = (F.col("strategy") == "center") | (F.col("confidence") < 0.2)
    aim = lambda c: clamp(F.when(unsure, F.lit(0.5)).otherwise(F.col(c)), 0.0, 1.0)
    aimed = points.withColumns({"target_x": aim("center_x"), "target_y": aim("center_y")})
    schema = aimed.schema.add("smooth_x", "double").add("smooth_y", "double")
    smoothed = sorted_runs(aimed, ["track_id"], order).mapInPandas(
        _one_euro(min_cutoff, beta, 1.0), schema
    )
    side = F.least("width", "height")

    def corner(center: str, size: str) -> Column:
        at = F.col(center) * F.col(size) - side / 2.0
        return F.bround(clamp(at, F.lit(0.0), (F.col(size) - side).cast("double"))).cast("int")

    return smoothed.select(
        *points.columns,
        "smooth_x",
        "smooth_y",
        corner("smooth_x", "width").alias("crop_x"),
        corner("smooth_y", "height").alias("crop_y"),
        side.cast("int").alias("crop_side"),
    )


# --- moving layers -------------------------------------------------------------------------


def composite_motion(base: DataFrame, layers: DataFrame, keys: DataFrame) -> DataFrame:
    """Warp each layer by its track at the frame's time, then composite over the base.

    ``base``: packed linear frames. ``layers``: packed linear frames with ``z_index``
    (above 0), ``track_id``, ``t``, ``mode``; ``keys``: affine tracks.
    """
    times = layers.select("clip_id", "frame_idx", "z_index", "track_id", "t")
    matrices = sample_affine(times, keys).select(
        "clip_id", "frame_idx", "z_index", F.col("value").alias("matrix")
    )
    moved = geometry.warp(layers.join(matrices, ["clip_id", "frame_idx", "z_index"]))

    def cells(frames: DataFrame, z: Column, mode: Column) -> DataFrame:
        # The pixel step keeps the frame keys; the stacking order rides in them.
        tagged = frames.withColumn("clip_id", F.struct("clip_id", z.alias("z"), mode.alias("m")))
        px = clips.to_pixels(tagged)
        return px.select(
            F.col("clip_id.clip_id").alias("clip_id"),
            "frame_idx",
            "y",
            "x",
            F.col("clip_id.z").alias("z_index"),
            F.col("clip_id.m").alias("mode"),
            *blending.CHANNELS,
        )

    stack = cells(base, F.lit(0), F.lit("normal")).unionByName(
        cells(moved, F.col("z_index"), F.col("mode"))
    )
    return blending.composite(stack, blending.CELL)
